"""Mixing sources to target weights by entropy balancing.

Rates r_d >= 0 closest in relative entropy to one copy of each document, under one token constraint per source
(sum of size_d * r_d = target), are exponentially tilted: r_d = exp(lambda_source). The convex dual
sum_s [ S_s * exp(lambda_s) - T_s * lambda_s ] has a diagonal Hessian, so each Newton step
lambda <- lambda - (S * exp(lambda) - T) / (S * exp(lambda)) runs on all sources at once, where the table of
sources lies; nothing is sent to the driver but the largest remaining error. S_s, the sufficient statistic, is summed over all
documents before they are shuffled.

Rates become copies: each document gets floor(r) copies and, of each source, those documents whose hash is below a
threshold get one more. The threshold is found by distributed bisection over sums in hash bins; the words that are then missing, or too
many with the document that crosses, are made up by documents whose sizes fit, found in counts by size and by a second bisection
over documents of those sizes. A source's taken words miss its target by less than the sizes at hand can fill. No document exceeds ``cap`` copies.

Sources rank by code point with null last; weights repeat (5, 2, 1). Null and blank texts have size 0 and are
never copied. Rows with equal ids and texts are told apart by nothing and share their fate; a null id is a value of its own. Columns other
than the named ones are ignored. Empty input: empty output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spent

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BINS, ROUNDS = 1024, 4


def word_count(text: str) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ (null: 0): the words' starts, split off and counted."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(F.trim(t)) == 0, F.lit(0)).otherwise(F.size(F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != ""))).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0, by code point, null last): ranges are sorted apart, and the ranges' sizes shift them."""
    spread = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("at")), "ranges")
    part = F.shiftright("at", 33)
    sizes = {r["p"]: r["n"] for r in spread.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    shift, before = {}, 0
    for p in sorted(sizes):
        shift[p], before = before, before + sizes[p]
    if not shift:
        return spread.select("source", "size", F.lit(0).cast("long").alias("rank"))
    offsets = F.create_map(*[F.lit(x) for p, n in shift.items() for x in (p, n)])
    return spread.select("source", "size", (offsets[part] + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """(source, size, target): shares of all sizes by weight, stopped at cap times the source's size, the excess
    reshared by weight until none is above."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = cut(ranked(sources).withColumn("weight", w), "sources")
    total = t.agg(F.sum("size")).first()[0] or 0
    level, ceiling = 0.0, F.col("size") * float(cap)
    full = F.lit(False)
    while True:  # each round stops at least one more source
        open_, stopped = t.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, ceiling))).first()
        level = (total - (stopped or 0.0)) / open_ if open_ else 0.0
        above = t.where(~full & (F.col("weight") * level > ceiling)).count()
        if not above:
            break
        full = full | (F.col("weight") * level > ceiling)
        t = cut(t.withColumn("stopped", full), "sources")
        full = F.col("stopped")
    return t.select("source", "size", F.when(full, ceiling).otherwise(F.col("weight") * level).alias("target"))


def tilts(t: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Newton's iterations on the dual, all sources at once, until the largest error is below the tolerance or falls no more; adds
    ``rate`` = exp(lambda)."""
    live = (F.col("size") > 0) & (F.col("target") > 0)
    now = t.withColumn("lam", F.lit(1.2))  # right of every root, as rates are at most the cap: the steps then fall monotonically
    before, step = float("inf"), 0
    while True:
        value = F.col("size") * F.exp("lam")
        now = now.withColumn("lam", F.when(live, F.col("lam") - (value - F.col("target")) / value).otherwise(F.lit(0.0)))
        if step % 8 == 7:
            now = cut(now, "tilts")
            off = now.where(live).agg(F.max(F.abs(F.col("size") * F.exp("lam") - F.col("target")) / F.col("target"))).first()[0]
            if off is None or off < tolerance or off >= before:
                break
            before = off
        step += 1
    return now.select("source", "size", "target", F.when(live, F.exp("lam")).otherwise(F.lit(0.0)).alias("rate"))


def _meet(keys: list[str]) -> Column:
    """Equal keys of two tables named l and r, null being a value."""
    return reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _bisect(docs: DataFrame, needs: DataFrame, keys: list[str]) -> DataFrame:
    """For (keys, need): ``low``, so that the key's documents with u < low hold at most ``need`` words and those with u <= low more; ``gap``,
    the words that are then missing, and ``over``, by how many those at u = low would go beyond. Both are 0 where all documents fit."""
    now = needs.select(*keys, "need", F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("over"))
    last = None
    for k in range(ROUNDS):
        width = BINS ** (ROUNDS - 1 - k)
        here = docs.alias("l").join(now.alias("r"), _meet(keys))
        inside = here.where((F.col("l.u") >= F.col("r.low")) & (F.col("l.u") < F.col("r.low") + BINS * width) & (F.col("r.need") > 0))
        bins = inside.groupBy(*[F.col(f"r.{c}") for c in keys], F.floor((F.col("l.u") - F.col("r.low")) / width).alias("bin")).agg(F.sum("l.size").alias("words"))
        per = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "words"))).alias("bins"))  # at most BINS entries
        # The first bin whose sum exceeds the need, and what the bins before it hold.
        start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("words"))
        walk = F.aggregate(
            "bins", start,
            lambda a, x: F.when(a["bin"].isNotNull(), a).when(a["held"] + x["words"] <= F.col("need"), F.struct((a["held"] + x["words"]).alias("held"), a["bin"].alias("bin"), a["words"].alias("words")))
            .otherwise(F.struct(a["held"].alias("held"), x["bin"].cast("long").alias("bin"), x["words"].alias("words"))),
        )
        joined = now.alias("l").join(per.alias("r"), _meet(keys), "left").select("l.*", "r.bins").withColumn("walk", walk)
        found, done = F.col("walk.bin").isNotNull(), F.col("need") <= 0
        low = F.when(done, F.col("low")).when(found, F.col("low") + F.col("walk.bin") * width).when(F.col("bins").isNull(), F.col("low")).otherwise(F.col("low") + BINS * width)
        gap = F.col("need") - F.col("walk.held")
        over = F.when(done, F.col("over")).when(found, F.col("walk.words") - gap).otherwise(F.lit(0.0))
        now = cut(joined.select(*keys, F.when(done, F.col("need")).when(found, gap).otherwise(F.lit(0.0)).alias("need"), low.cast("long").alias("low"), over.alias("over")), "bins")
        if last is not None:
            spent(last)
        last = now
    return now.withColumnRenamed("need", "gap")


def _packed(single: str, again: str, room: str) -> Column:
    """(left, picks): of (size, n, all) entries the largest first, each as often as it still fits into the room; what is then left takes
    entries a second time, with the n of ``again``."""
    pick = "struct<size:long,n:long,all:long,again:boolean>"
    start = F.struct(F.col(room).alias("left"), F.array().cast(f"array<{pick}>").alias("picks"))

    def step(a: Column, x: Column) -> Column:
        n = F.least(x["n"], F.floor(a["left"] / x["size"]))
        taken = F.struct(x["size"].alias("size"), n.cast("long").alias("n"), x["all"].alias("all"), x["again"].alias("again"))
        return F.when(n > 0, F.struct((a["left"] - n * x["size"]).alias("left"), F.concat(a["picks"], F.array(taken)).alias("picks"))).otherwise(a)

    def entries(n: str, again: bool) -> Column:
        return F.transform(F.reverse(F.array_sort("entries")), lambda x: F.struct(x["size"].alias("size"), x[n].alias("n"), x["all"].alias("all"), F.lit(again).alias("again")))

    return F.aggregate(F.concat(entries(single, False), entries(again, True)), start, step)


def thresholds(docs: DataFrame, rates: DataFrame, cap: int) -> DataFrame:
    """Adds ``cut_at``, ``swap`` and ``until``: of each source, documents with hash u (0 to BINS**ROUNDS - 1) below cut_at get one more copy. What
    this misses is made up by other documents of the sizes in ``until``. With swap 'fill' those of hash below until[size] get one more copy as
    well; where that leaves room, all of a size get ``level`` more and those below until[size] yet another one, up to the cap. With swap 'drop' those
    below until[size] get none more. Of fill and drop the one that leaves the smaller error is taken.

    Sizes are packed largest first from counts by size: all sizes below 4,096 and, beyond, the largest that fits of 2,048 classes a power of two."""
    whole = F.floor(F.col("rate") + 1e-9)
    needs = rates.select("source", (F.col("target") - whole * F.col("size")).alias("need"), whole.cast("long").alias("whole"))
    at = cut(_bisect(docs, needs, ["source"]).alias("l").join(needs.alias("r"), _meet(["source"])).select("l.*", "r.whole"), "at")
    near = docs.where("size > 0").alias("l").join(at.alias("r"), _meet(["source"])).where(F.col("l.size") <= F.greatest("r.gap", "r.over"))
    counted = near.groupBy("r.source", "r.gap", "r.over", "r.whole", "l.size").agg(F.count_if(F.col("l.u") < F.col("r.low")).alias("inside"), F.count("*").alias("all"))
    sides = F.explode(F.array(F.struct(F.lit("fill").alias("side"), F.col("gap").alias("room"), (F.col("all") - F.col("inside")).alias("n")), F.struct(F.lit("drop").alias("side"), F.col("over").alias("room"), F.col("inside").alias("n"))))
    sized = counted.select("source", "size", "all", "whole", sides.alias("x")).select("source", "size", "all", "whole", "x.*").where(F.col("size") <= F.col("room"))
    more = F.when(F.col("side") == "fill", F.col("all") * F.greatest(F.lit(0).cast("long"), cap - 1 - F.col("whole"))).otherwise(F.lit(0)).cast("long")
    kind = F.when(F.col("size") < 4096, F.col("size")).otherwise(F.floor(F.log2("size") * 2048))
    classes = sized.groupBy("source", "side", "room", kind.alias("kind")).agg(F.max(F.struct("size", "n", more.alias("m"), "all")).alias("best"))
    packs = classes.groupBy("source", "side", "room").agg(F.collect_list("best").alias("entries")).select("source", "side", _packed("n", "m", "room").alias("pack"))
    packs = packs.groupBy("source").agg(*[F.first(F.when(F.col("side") == s, F.col("pack")), ignorenulls=True).alias(s) for s in ("fill", "drop")])
    drops = F.coalesce("r.drop.left", "l.over") < F.coalesce("r.fill.left", "l.gap")
    chosen = at.alias("l").join(packs.alias("r"), _meet(["source"]), "left").select(
        "l.source", (F.col("l.low") + drops.cast("long")).alias("cut_at"), F.when(drops, "drop").otherwise("fill").alias("swap"), F.when(drops, F.col("r.drop.picks")).otherwise(F.col("r.fill.picks")).alias("picks")
    )
    chosen = cut(chosen, "chosen")
    # A size is taken again only when it was taken whole before.
    picks = chosen.select("source", "cut_at", "swap", F.explode("picks").alias("pick")).groupBy("source", "cut_at", "swap", "pick.size").agg(F.max(F.struct("pick.again", "pick.n", "pick.all")).alias("p"))
    level = F.when(F.col("p.again"), 1 + F.floor(F.col("p.n") / F.col("p.all"))).otherwise(F.lit(0)).cast("long")
    rest = F.when(F.col("p.again"), F.col("p.n") % F.col("p.all")).otherwise(F.col("p.n"))
    picks = cut(picks.select("source", "cut_at", "swap", "size", level.alias("level"), (rest * F.col("size")).cast("double").alias("need")), "picks")
    # The document that crosses (u = cut_at - 1 with 'drop') is none of those to be dropped.
    able = F.when(F.col("r.swap") == "drop", F.col("l.u") < F.col("r.cut_at") - 1).otherwise((F.col("l.u") >= F.col("r.cut_at")) | (F.col("r.level") > 0))
    these = cut(docs.alias("l").join(picks.alias("r"), _meet(["source", "size"])).where(able).select("l.source", "l.size", "l.u"), "able")
    ends = _bisect(these, picks, ["source", "size"]).alias("l").join(picks.alias("r"), _meet(["source", "size"])).select("l.source", "l.size", F.struct("r.level", "l.low").alias("end"))
    until = ends.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("size", "end"))).alias("until"))
    plain = chosen.alias("l").join(until.alias("r"), _meet(["source"]), "left").select("l.source", "l.cut_at", "l.swap", "r.until")
    return rates.alias("l").join(plain.alias("r"), _meet(["source"])).select("l.source", "l.size", "l.target", "l.rate", "r.cut_at", "r.swap", "r.until")


def uniform(*columns: str) -> Column:
    """A whole number below BINS**ROUNDS that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(BINS**ROUNDS))


def plan(sized: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """(source, size, target, rate, cut_at, swap, until) for rows (source, size, u)."""
    rates = tilts(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, cap))
    return cut(thresholds(sized, cut(rates, "rates"), cap), "plan")


def _copies(cap: int) -> Column:
    whole = F.floor(F.col("p.rate") + 1e-9)
    below = F.col("d.u") < F.col("p.cut_at")
    end = F.try_element_at("p.until", F.col("d.size"))
    swapped = F.coalesce(F.col("d.u") < end["low"], F.lit(False))
    # With 'drop' the document at cut_at - 1 is the one that crosses: it stays.
    once = F.when(F.col("p.swap") == "drop", below & (~swapped | (F.col("d.u") == F.col("p.cut_at") - 1))).otherwise(below | swapped)
    extra = F.when(end["level"] > 0, end["level"] + swapped.cast("long")).otherwise(once.cast("long"))
    return F.when(F.col("d.size") == 0, F.lit(0)).otherwise(F.least(F.lit(cap), whole + extra)).cast("long")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Of each document: doc_id, source, size, source_size, target, rate, copies (long).

    The texts are read once and never shuffled; what is written in between has a row per document without its text."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), uniform(doc_id, text).alias("u"))
    sized = cut(base, "sizes")
    p = plan(sized, weights, cap)
    return sized.alias("d").join(p.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.doc_id", "d.source", "d.size", F.col("p.size").alias("source_size"), "p.target", "p.rate", _copies(cap).alias("copies")
    )


def resample(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents as often as the mix takes them, columns unchanged and ``copy`` (from 1) behind them; ``copy_1`` or the next free name
    where the documents have a column of that name.

    The table of sources has a row per source; Spark broadcasts it while it is small and else joins by source, splitting hot ones."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    d = docs.select(row, F.col("source").alias("source"), word_count("text").alias("size"), uniform("doc_id", "text").alias("u"))
    p = plan(cut(d.select("source", "size", "u"), "sizes"), weights, cap)
    taken = d.alias("d").join(p.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.row", _copies(cap).alias("n")).where("n > 0")
    used = {c.lower() for c in names}
    name = next(c for c in ["copy", *[f"copy_{i}" for i in range(1, len(names) + 2)]] if c not in used)
    return taken.select(*[F.col(f"row.`{c}`") for c in names], F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias(name))


def digest(docs: DataFrame, **more: object) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return mix(docs, **more).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
