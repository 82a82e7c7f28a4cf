"""Search-box queries against a plain evaluation of their alternatives."""

import re
from math import pi

import pytest

from lodestack.operators import websearch

TEXTS = {
    "a": "The cat sat on the mat. The end", "b": "cat dog", "c": "dog, cat: the mat", "d": "", "e": None, "f": "Über the-mat é_é cat", "g": "on the mat on the mat on the mat",
}


def brute(query):
    """entry -> rank; the query's parts are read off with split, not with the library's expression."""
    out = {}
    alternatives, quoted = [[]], query.split('"')
    for i, piece in enumerate(quoted):
        if i % 2 and i < len(quoted) - 1:  # between two quotes
            before = quoted[i - 1]
            negated = before.endswith("-")
            alternatives[-1].append((not negated, re.findall(r"[^\W_]+", piece.lower())))
            continue
        for w in piece.split():
            if w.lower() == "or":
                alternatives.append([])
            else:
                alternatives[-1].append((not w.startswith("-"), re.findall(r"[^\W_]+", w.lower())))
    alternatives = [[p for p in a if p[1]] for a in alternatives]
    alternatives = [a for a in alternatives if a]
    wanted = {t for a in alternatives for ok, ts in a if ok for t in ts}
    for k, text in TEXTS.items():
        tk = re.findall(r"[^\W_]+", (text or "").lower())
        hold = lambda ts: any(tk[i : i + len(ts)] == ts for i in range(len(tk)))  # noqa: E731, B023
        if any(all(hold(ts) == ok for ok, ts in a) for a in alternatives):
            out[k] = round(sum(sum(1 / j**2 for j in range(1, tk.count(t) + 1)) for t in wanted) * 0.1 * 6 / pi**2 / max(len(wanted), 1), 6)
    return out


@pytest.fixture(scope="module")
def diary(spark):
    rows = [(k, f"2024-01-0{i + 1}", i, "calm" if k == "d" else None, ["50%", k], t) for i, (k, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "entry_id string, entry_date string, updated_at int, mood string, tags array<string>, content string")


@pytest.mark.parametrize("query", [
    "cat", "CAT dog", '"the mat"', '"the mat" -sat', "cat -dog OR on", "-cat", 'or "on the mat" or', '"unclosed the mat', "the-mat", '-"the mat" cat', "Über É", "- cat", '"" cat', "cat or or dog", "zebra", "-zebra -cat",
])
def test_queries(diary, query):
    got = websearch.search(diary, query, digits=6).collect()
    assert {r["entry_id"]: r["rank"] for r in got} == brute(query)
    assert [r["rank"] for r in got] == sorted((r["rank"] for r in got), reverse=True)


def test_order_range_and_limit(diary):
    got = [r["entry_id"] for r in websearch.search(diary, "cat", "2024-01-02", "2024-01-06").collect()]
    assert got == ["f", "c", "b"]  # equal ranks: the latest date first
    assert [r["entry_id"] for r in websearch.search(diary, "mat", k=1).collect()] == ["g"]
    with pytest.raises(ValueError, match="start date"):
        websearch.search(diary, "cat", "2024-02-01", "2024-01-01")


def test_no_tokens_fall_back_to_the_text_as_written(diary):
    assert {r["entry_id"] for r in websearch.search(diary, "%").collect()} == set(TEXTS)  # every entry has a tag with it
    assert {r["entry_id"] for r in websearch.search(diary, ":").collect()} == {"c"}
    assert websearch.search(diary, "_ _").collect() == []
