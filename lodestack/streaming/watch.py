"""Watched files: changes of a path settle in state across batches, and a stored chunk table follows them.

A change log is a stream of (path, op, version, at): what happened to a file, when. A path's changes are held until none has followed for
``debounce_ms`` of event time; then the last one is passed on. What was passed on stays in state as a tombstone for ``keep_ms``, so that an
older change that comes late changes nothing; changes behind the watermark are dropped. State and timers live in the query's
checkpoint and outlast a restart."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import chunk
from ..operators.storage import Stored
from .flows import watched

DEBOUNCE_MS, KEEP_MS = 2000, 86_400_000
CHANGE = "path string, op string, version long, at timestamp"
SETTLED = "path string, op string, version long"
#: last change seen: what, its version and time; the version that was passed on
STATE = "op string, version long, at long, sent long"


def settled(changes: DataFrame, debounce_ms: int = DEBOUNCE_MS, delay: str = "10 seconds", keep_ms: int = KEEP_MS) -> DataFrame:
    """(path, op, version): the last change of each path once it has settled. ``delay`` is how late a change may come."""

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        op, version, at, sent = state.get if state.exists else ("", -1, 0, -1)
        if state.hasTimedOut:
            if version <= sent:  # a tombstone that has served
                state.remove()
                return
            state.update((op, version, at, version))
            state.setTimeoutTimestamp(max(at + keep_ms, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"path": [key[0]], "op": [op], "version": [version]})
            return
        for p in parts:
            for o, v, t in zip(p["op"], p["version"], p["at"], strict=True):
                if v > version or v == version and o == "remove" and version > sent:
                    op, version, at = o, int(v), max(at, int(t.timestamp() * 1000))
        state.update((op, version, at, sent))
        due = at + (debounce_ms if version > sent else keep_ms)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    keyed = changes.where(F.col("path").isNotNull() & F.col("version").isNotNull() & F.col("at").isNotNull()).withWatermark("at", delay)
    return keyed.groupBy("path").applyInPandasWithState(step, SETTLED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rechunk(batch: DataFrame, chunks: Stored, read: Callable[[DataFrame], DataFrame]) -> None:
    """Gives the chunks of the batch's paths way to those of their files as ``read`` (paths to (path, content)) finds them; a removed file, or
    one that isn't there any more, leaves none. The table's key is source_path. A batch that is replayed gives the same table."""
    paths = batch.select("path", "op").persist()
    try:
        if not paths.isEmpty():
            files = read(paths.where("op <> 'remove'").select("path"))
            chunks.replace(paths.select(F.col("path").alias("source_path")), chunk(files))
    finally:
        paths.unpersist()


def follow_files(changes: DataFrame, chunks: Stored, read: Callable[[DataFrame], DataFrame], checkpoint: str, **more: object) -> DataStreamWriter:
    """Keeps a chunk table up to date with the watched files of a change log."""
    last = settled(changes.where(watched("path")), **more)
    return last.writeStream.foreachBatch(lambda batch, _: rechunk(batch, chunks, read)).option("checkpointLocation", checkpoint)
