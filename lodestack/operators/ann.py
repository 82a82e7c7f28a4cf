"""Approximate nearest neighbours by inverted lists.

A spherical k-means on a bounded sample gives at most 4,096 centroids; every row of the table goes to the list of the centroid nearest to it, and
the lists are the partitions of the index's table. A search reads the lists of a query's ``probe`` nearest centroids and scores their rows
exactly. How many lists to probe is measured when the index is built: sample queries are answered exactly, and ``probe`` is the least number
that holds ``target`` of their true neighbours. The exact search (retrieval.dense_batch) stays as it is.

Rows with a null vector, a null or non-finite component or no direction (all zero) are not indexed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import TILE, Best, dense_batch, matrix, unit, usable
from .storage import Manifests, remove, scratch

#: Rows of the sample that the centroids are fitted on, queries that ``probe`` is measured with, queries sent to the tasks at a time.
SAMPLE, TRIALS, BLOCK, ROUNDS, MOST_LISTS = 20_000, 200, 4096, 8, 4096


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the centroid nearest to each row; a few rows are compared at a time."""
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(x[i : i + TILE[1]] @ c.T, 1) for i in range(0, len(x), TILE[1])]])


def centroids(sample: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a bounded sample (id, vector): tasks assign and sum, the driver takes means."""
    first = sample.orderBy(F.xxhash64("id"), "id").limit(lists).collect()
    c = unit(np.array([r["vector"] for r in first], float))
    sc = sample.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(c)

        def sums(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            at = sent.value
            total, n = np.zeros(at.shape), np.zeros(len(at), np.int64)
            for b in batches:
                x = unit(matrix(b.column(0)))
                own = nearest(x, at)
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=len(at))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(list(total[seen]), pa.list_(pa.float64()))], names=["list", "total"])

        total = np.zeros(c.shape)
        for r in sample.select("vector").mapInArrow(sums, "list long, total array<double>").toLocalIterator():  # lists x tasks of the sample
            total[r["list"]] += r["total"]
        hit = np.linalg.norm(total, axis=1) > 0
        new = np.where(hit[:, None], unit(total), c)
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return c


class Lists:
    """An index in a folder: centroids and numbers in a manifest, rows by list."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = Manifests(spark, f"{self.folder}/manifest")
        self.note = self.manifests.read()[1]
        self.centroids = np.array([json.loads(x) for x in self.note["centroids"]], float).reshape(len(self.note["centroids"]), self.note["dims"])

    @classmethod
    def ensure(cls, vectors: DataFrame, folder: str, **more: object) -> Lists:
        """The index in the folder, built from (id, vector) if there is none; one of other dimensions is an error."""
        spark = vectors.sparkSession
        if not Manifests(spark, f"{folder}/manifest").numbers():
            return cls.build(vectors, folder, **more)
        out = cls(spark, folder)
        first = vectors.where(usable("vector")).first()
        if first is not None and len(first["vector"]) != out.note["dims"]:
            raise ValueError(f"the index has {out.note['dims']} dimensions, the table {len(first['vector'])}")
        return out

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, lists: int | None = None, k: int = 10, target: float = 0.95, sample: int = SAMPLE) -> Lists:
        spark, rows = vectors.sparkSession, vectors.where(usable("vector")).select("id", "vector")
        n = rows.count()
        count = max(1, min(lists or round(n**0.5), MOST_LISTS, n or 1))
        some = scratch(spark, "sample")
        rows.where(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < sample).coalesce(8).write.parquet(some)
        part = spark.read.parquet(some)
        c = centroids(part, count) if n else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(c)
        types = {f.name: f.dataType.simpleString() for f in rows.schema}

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = nearest(unit(matrix(b.column(1))), sent.value) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32))], names=["id", "vector", "list"])

        remove(spark, f"{folder}/rows")
        spread = F.pmod(F.xxhash64("id"), F.lit(max(1, n // (len(c) * 100_000 or 1))))  # a hot list is written by several tasks
        rows.mapInArrow(assign, f"id {types['id']}, vector {types['vector']}, list int").repartition("list", spread).write.partitionBy("list").parquet(f"{folder}/rows")
        note = {"dims": c.shape[1] if len(c) else 0, "centroids": [json.dumps(x.tolist()) for x in c], "id": types["id"], "vector": types["vector"], "rows": n, "probe": len(c), "held": 1.0}
        manifests = Manifests(spark, f"{folder}/manifest")
        if n:
            note |= cls._measured(rows, part, c, folder, k, target)
        manifests.write(1, note)
        remove(spark, some)
        return cls(spark, folder)

    @staticmethod
    def _measured(rows: DataFrame, part: DataFrame, c: np.ndarray, folder: str, k: int, target: float) -> dict:
        """The least number of lists that holds ``target`` of the true neighbours of sample queries, and the share it holds."""
        trials = part.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIALS).select(F.col("id").alias("query_id"), "vector")
        true = dense_batch(rows, trials, k).select("query_id", "id")
        where = rows.sparkSession.read.parquet(f"{folder}/rows").select("id", "list")
        got = true.join(where, "id").collect()  # k rows a trial
        q = {r["query_id"]: np.argsort(-(c @ unit(np.array([r["vector"]], float))[0]), kind="stable") for r in trials.collect()}
        rank = {i: {int(x): p for p, x in enumerate(order)} for i, order in q.items()}
        at = np.sort([rank[r["query_id"]][r["list"]] for r in got])
        probe = int(at[min(len(at) - 1, int(np.ceil(target * len(at))))]) + 1
        return {"probe": probe, "held": float((at < probe).mean())}

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(f"id {self.note['id']}, vector {self.note['vector']}, list int").parquet(f"{self.folder}/rows")
        return df if lists is None else df.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probe: int | None = None, digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank): the k best by cosine of each query (query_id, vector) among the rows of its nearest lists."""
        queries = queries.where(usable("vector")).select("query_id", "vector")
        kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.note['id']}, score double"
        if not len(self.centroids):
            return self.spark.createDataFrame([], f"{kind}, rank int")
        n, probe, out = queries.count(), min(probe or self.note["probe"], len(self.centroids)), None
        rounds = max(1, -(-n // BLOCK))
        for r in range(rounds):
            block = (queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)).collect()  # about BLOCK rows
            names = np.array([x["query_id"] for x in block], object)
            q = unit(np.array([x["vector"] for x in block], float).reshape(len(block), self.note["dims"]))
            near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probe]
            order = np.argsort(near, axis=None, kind="stable")
            wanted, first = np.unique(near.ravel()[order], return_index=True)
            asked = dict(zip(wanted.tolist(), np.split((order // max(probe, 1)).astype(np.int32), first[1:]), strict=True)) if len(wanted) else {}
            sent = self.spark.sparkContext.broadcast((names, q, asked))

            def scored(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
                names, q, asked = sent.value
                best = Best(len(names), k)
                for b in batches:
                    x, ids, own = unit(matrix(b.column(1))), b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
                    for one in np.unique(own).tolist():
                        here, who = np.flatnonzero(own == one), asked[one]
                        best.products(who, q[who], ids[here], x[here], digits)
                yield best.batch(names, b_types)

            b_types = pa.schema([("query_id", _arrow(kind, 0)), ("id", _arrow(kind, 1)), ("score", pa.float64())])
            found = self.rows(sorted(asked)).select("id", "vector", "list").mapInArrow(scored, kind)
            out = found if out is None else out.unionByName(found)
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _arrow(kind: str, i: int) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(kind)[i].dataType)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(queries, recall): the share of the true (query_id, id) that is found, over all of them."""
    both = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
