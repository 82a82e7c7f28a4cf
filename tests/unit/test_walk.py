"""The walk over parents and children against a plain queue."""

import random
from collections import deque

import pytest

from lodestack.operators import graph


def plain(rows, start, depth, most):
    by = {r[0]: r for r in rows}
    if start not in by:
        return [], False
    queue, seen, out = deque([(start, 0)]), {start}, []
    while queue:
        x, d = queue.popleft()
        out.append((x, d))
        if len(out) >= most:
            return out, bool(queue)
        if d < depth:
            for y in [p for p in [by[x][3]] if p in by] + [r[0] for r in sorted((r for r in rows if r[3] == x), key=lambda r: (r[1], r[2], r[0]))]:
                if y not in seen:
                    seen.add(y)
                    queue.append((y, d + 1))
    return out, False


@pytest.mark.parametrize(("start", "depth", "most"), [("x0", 3, 2000), ("x7", 2, 9), ("x7", 4, 10), ("x0", 0, 5), ("x3", 4, 1), ("none", 2, 5)])
def test_walk(spark, start, depth, most):
    rnd = random.Random(5)
    rows = [(f"x{i}", rnd.choice(["closet", "drawer", "room"]), rnd.choice("abc"), None if i == 0 else "lost" if i % 9 == 8 else f"x{rnd.randrange(i)}") for i in range(30)]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, label string, parent_node_id string")
    for limit in {most, max(1, len(plain(rows, start, depth, 2000)[0]))}:
        got, cut = graph.walk(nodes, start, depth, limit)
        assert ([(r.node_id, r.depth) for r in got.collect()], cut) == plain(rows, start, depth, limit)
