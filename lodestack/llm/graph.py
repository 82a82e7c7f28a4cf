"""Connected components over DataFrames: alternating large and small stars, cut in the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then small star. Neighbours' minima are aggregated before they are shuffled; the joins back to
    the edges are sort-merge joins whose hot keys Spark splits."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    small = down.join(least, F.col("a") == F.col("u"))
    return small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b); the root is the component's least vertex.

    Rounds go on until the edges stand still, which is when every component is a star around its least vertex; a round's table is
    deleted when the next one is written."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, last = state, e
        e = cut(_stars(e), "edges")
        spent(last)
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
