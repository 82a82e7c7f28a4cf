"""Retrieval quality: recall at k, mean reciprocal rank, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch


def hits(results: DataFrame, expected: str = "expected", content: str = "content", path: str = "source_path") -> DataFrame:
    """(query_id, rank of the first result that holds an expected text in its content or path; null without one)."""
    ok = F.exists(F.col(expected), lambda e: F.col(content).contains(e) | F.col(path).contains(e))
    return results.groupBy("query_id").agg(F.min(F.when(ok, F.col("rank"))).alias("rank"))


def quality(first: DataFrame, *by: str) -> DataFrame:
    """recall_1, recall_5 and mrr over the queries' first hits."""
    r = F.col("rank")
    return first.groupBy(*by).agg(F.count("*").alias("queries"), F.avg((F.coalesce(r, F.lit(0)) == 1).cast("double")).alias("recall_1"), F.avg((r.isNotNull() & (r <= 5)).cast("double")).alias("recall_5"), F.avg(F.when(r.isNotNull(), 1.0 / r).otherwise(0.0)).alias("mrr"))


#: Bins of a selection round, and how many rows of a percentile's range are ranked at the end.
BINS, RANKED = 1024, 10_000


def percentiles(rows: DataFrame, by: str, value: str, ps: Sequence[float], ranked: int = RANKED) -> DataFrame:
    """(by, p, value): the value at index round((n - 1) * p) of each group's sorted values, exact.

    Each group's range is cut into bins, of which only counts, least and largest values are gathered, and narrowed to the bin with the wanted
    index, until that holds at most ``ranked`` rows or a single value; so no group's values meet anywhere. Nulls and NaN take no part; a
    group without values has no row."""
    v = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    spark = rows.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "percentiles")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    whole = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    at = kept(whole.select("g", wanted, "n", "low", "high").withColumn("skip", F.round((F.col("n") - 1) * F.col("p")).cast("long")))
    while True:
        wide = (F.col("n") > ranked) & (F.col("low") < F.col("high"))
        if at.where(wide).isEmpty():
            break
        near = v.join(at.where(wide).withColumnRenamed("g", "k"), F.col("g").eqNullSafe(F.col("k")) & F.col("v").between(F.col("low"), F.col("high")))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: no overflow
        bins = near.groupBy("g", "p", "skip", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("g", "p").orderBy("bin")) - F.col("n")  # at most BINS rows
        hit = bins.withColumn("before", before).where((F.col("before") <= F.col("skip")) & (F.col("skip") < F.col("before") + F.col("n")))
        at = kept(at.where(~wide).unionByName(hit.select("g", "p", "n", "low", "high", (F.col("skip") - F.col("before")).alias("skip"))))
    one = at.where("low = high").select(F.col("g").alias(by), "p", F.col("low").alias("value"))
    rest = v.join(at.where("low < high").withColumnRenamed("g", "k"), F.col("g").eqNullSafe(F.col("k")) & F.col("v").between(F.col("low"), F.col("high")))
    place = F.row_number().over(Window.partitionBy("g", "p").orderBy("v")) - 1  # at most ``ranked`` rows
    return one.unionByName(rest.withColumn("i", place).where("i = skip").select(F.col("g").alias(by), "p", F.col("v").alias("value")))


def latency(calls: DataFrame, by: str, value: str) -> DataFrame:
    """p50 and p95 of each group."""
    found = percentiles(calls, by, value, (0.5, 0.95))
    return found.groupBy(by).agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95"))
