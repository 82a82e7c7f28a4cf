"""A training-data pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, documents
with benchmark passages go, and the sources are mixed to their target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it again as
the next stage's documents. All but the last return the columns of documents; the last one gives a row per copy taken and its number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from lodestack.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of an Arrow batch between an executor and its Python workers. The default of 10,000 rows is some 30 MB of whole texts, which both sides hold several times.
BATCH_BYTES = 8 << 20
#: Characters of a plan's text. The driver holds one for each of the last thousand jobs, and makes it anew each time a shuffle has ended.
PLAN_CHARS = 20_000


def _in_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@_in_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are alike to an earlier line, short ones too, leave the texts, and documents of which nothing else is left go."""
    out = line_dedup.dedup(docs, short=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@_in_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the least id stays."""
    return ngram_join.representatives(docs)


@_in_batches
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@_in_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.resample(docs)


STAGES = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixed),
]

#: The classifier and the mix are iterative, so no SQL gives these rows. tests/llm hold the line stage against brute force, and the documents each stage keeps
#: against planted cases; whole rows of run() are not held against brute force yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
