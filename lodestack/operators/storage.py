"""Tables kept in a folder that all executors share: versions, hash buckets, and a manifest that names the files of each version.

A change writes the buckets it touches under a new version number and then one manifest; files of other buckets stay as they are. Readers
take the newest complete manifest, so they see one version, and a change that fails on the way leaves the last one in force. Two
writers of the same version meet at the manifest, which the second can't write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import delete, upsert


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it, or the context's checkpoint folder. On local masters, where driver and executors
    are one process, the warehouse stands in; on a cluster neither being set is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


class Manifests:
    """Numbered JSON notes in a folder; the newest one that was written to its end counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return [int(n) for n in children(self.spark, self.folder) if n.isdigit() and "_SUCCESS" in children(self.spark, f"{self.folder}/{n}")]

    def read(self, number: int | None = None) -> tuple[int, dict]:
        known = self.numbers()
        if not known:
            raise ValueError(f"no table in {self.folder}")
        n = max(known) if number is None else number
        return n, json.loads(self.spark.read.text(f"{self.folder}/{n:012d}", wholetext=True).first()[0])

    def write(self, number: int, note: dict) -> None:
        self.spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.text(f"{self.folder}/{number:012d}")


class Stored:
    """A table in hash buckets of its key."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifests = Manifests(spark, f"{self.folder}/manifest")

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: Sequence[str], buckets: int = 64, dealt: bool = False) -> Stored:
        """A new table of the rows. ``buckets`` should leave a bucket of the size of a task's input. Rows that are ``dealt`` by their key already
        are written by the tasks that have them, without a shuffle: a file for each task and bucket."""
        out = cls(rows.sparkSession, folder)
        out._write(rows, 1, {"key": list(key), "count": buckets, "schema": rows.schema.json(), "buckets": {}}, None, dealt)
        return out

    def _bucket(self, note: dict) -> Column:
        return F.pmod(F.xxhash64(*note["key"]), F.lit(note["count"])).cast("int")

    def _files(self, note: dict, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of the given buckets, or of all."""
        keep = None if only is None else set(only)
        paths = [f"{self.folder}/data/version={v}/_bucket={b}" for b, v in note["buckets"].items() if keep is None or int(b) in keep]
        schema = StructType.fromJson(json.loads(note["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, version: int, note: dict, touched: set[int] | None, dealt: bool = False) -> None:
        target = f"{self.folder}/data/version={version}"
        remove(self.spark, target)  # what a writer that failed has left
        rows = rows.withColumn("_bucket", self._bucket(note))
        (rows if dealt else rows.repartition("_bucket")).write.partitionBy("_bucket").parquet(target)
        written = {n.split("=")[1]: version for n in children(self.spark, target) if n.startswith("_bucket=")}
        kept = {b: v for b, v in note["buckets"].items() if touched is not None and int(b) not in touched}
        self.manifests.write(version, note | {"buckets": kept | written})

    def change(self, keys: DataFrame, rewrite: Callable[[DataFrame], DataFrame], dealt: bool = False) -> int:
        """Rewrites the buckets in which ``keys`` fall; the new version's number."""
        version, note = self.manifests.read()
        touched = {r[0] for r in keys.select(self._bucket(note)).distinct().collect()}  # at most the number of buckets
        if touched:
            version += 1
            self._write(rewrite(self._files(note, touched)), version, note, touched, dealt)
        return version

    def upsert(self, changes: DataFrame, updated: str = "updated_at", keep_first: Sequence[str] = ()) -> int:
        key = self.manifests.read()[1]["key"]
        return self.change(changes, lambda old: upsert(old, changes, key, updated, keep_first))

    def delete(self, gone: DataFrame, only: Column | None = None) -> int:
        key = self.manifests.read()[1]["key"]
        return self.change(gone, lambda old: delete(old, gone, key, only))

    def replace(self, keys: DataFrame, new: DataFrame, dealt: bool = False) -> int:
        """All rows of the given keys give way to ``new``, whose keys are among them: a file's chunks to those of its new content. If the
        touched buckets hold no other key, only the old rows' keys are read. With ``dealt`` the rows of a key should lie in few tasks."""
        key = self.manifests.read()[1]["key"]

        def rewrite(old: DataFrame) -> DataFrame:
            others = delete(old.select(*key).distinct(), keys, key)
            return new if others.isEmpty() else delete(old, keys, key).unionByName(new)

        return self.change(keys, rewrite, dealt)

    def read(self, version: int | None = None) -> DataFrame:
        return self._files(self.manifests.read(version)[1])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, from their buckets only."""
        note = self.manifests.read()[1]
        touched = [r[0] for r in keys.select(self._bucket(note)).distinct().collect()]
        return self._files(note, touched).join(keys.select(*note["key"]).distinct(), note["key"], "left_semi")

    def vacuum(self) -> int:
        """Deletes files and manifests of versions before the newest; readers of those must have ended. How many bucket folders went."""
        version, note = self.manifests.read()
        live, gone = {(int(v), int(b)) for b, v in note["buckets"].items()}, 0
        for n in self.manifests.numbers():
            if n < version:
                remove(self.spark, f"{self.folder}/manifest/{n:012d}")
        for name in children(self.spark, f"{self.folder}/data"):
            v = int(name.split("=")[1])
            for b in children(self.spark, f"{self.folder}/data/{name}"):
                if v <= version and b.startswith("_bucket=") and (v, int(b.split("=")[1])) not in live:
                    remove(self.spark, f"{self.folder}/data/{name}/{b}")
                    gone += 1
        return gone
