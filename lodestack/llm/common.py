"""Helpers shared by the corpus operators: byte-level words, durable cuts, blobs of numpy arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of [A-Za-z0-9] and all bytes of non-ASCII characters make words; A-Z is lowered.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered; null has none."""
    return text.translate(_WORD).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lowered; null has none."""
    return text.lower().split() if text else []


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a bound that keeps a worker's memory flat."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 byte strings."""
    return column.cast(pa.large_binary()).to_pylist()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """What freed arrays held goes back to the system. A Python worker keeps it else, while it waits for its next task beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most about ``most`` bytes of text (a longer text stays whole); memory is given back after each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))  # bytes, without a copy of the texts
        start, held = 0, 0
        for i, n in enumerate(x or 0 for x in sizes.to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                give_back()
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
            give_back()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; unpack() needs the dtypes."""
    raw = b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *dtypes: object) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    for d in dtypes:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        at += 8
        out.append(np.frombuffer(raw, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def press(*arrays: np.ndarray) -> bytes:
    """pack() with the first bytes of all entries before the second ones and so on: the upper bytes of small numbers shrink to next to nothing."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T for a in arrays]
    return pack(*[np.ascontiguousarray(x).reshape(-1) for x in planes])


def unpress(blob: bytes, *dtypes: object) -> list[np.ndarray]:
    planes = unpack(blob, *[np.uint8] * len(dtypes))
    return [np.ascontiguousarray(x.reshape(np.dtype(d).itemsize, -1).T).view(d).reshape(-1) for x, d in zip(planes, dtypes, strict=True)]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session has it, or the context's own checkpoint folder. On local[...]
    masters, where driver and executors are one process, the warehouse stands in where both are unset; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodestack-cuts"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes the folders of tables made by cut() that no plan reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def merged(partials: DataFrame, merge: Callable[[Iterator[bytes]], bytes], fan: int = 32) -> bytes | None:
    """One blob from a column of blobs, or None of none: tasks merge about ``fan`` blobs each into one, level by level, until at most
    ``fan`` are left for the driver. The blobs' size must not depend on the number of rows."""

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = (x for b in batches for x in b.column(0).to_pylist())
        first = next(blobs, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([merge(chain([first], blobs))], pa.binary())], names=["blob"])

    now = cut(partials.select("blob"), "partials")
    while (n := now.count()) > fan:
        last, now = now, cut(now.repartition(-(-n // fan)).mapInArrow(level, "blob binary"), "partials")
        spent(last)
    rest = (r["blob"] for r in now.toLocalIterator())
    first = next(rest, None)
    out = None if first is None else merge(chain([first], rest))
    spent(now)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
