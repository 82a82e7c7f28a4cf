"""Change streams: debounced upserts and deletes, append logs with groups, time-series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.state import latest

WATCHED = ("md", "markdown", "txt", "json", "png", "jpg", "jpeg")
CHANGE = "op string, path string, content string, version long"


def watched(path: str = "path", kinds: tuple[str, ...] = WATCHED) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*kinds)


def change_log(spark: SparkSession, folder: str, schema: str = CHANGE) -> DataFrame:
    """A stream of changes; deletes are rows with op 'remove', as file sources report none."""
    return spark.readStream.schema(schema).json(folder)


def debounced(batch: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """The last change of each key within a batch."""
    return latest(batch, [key], F.col(version).desc())


def apply_changes(table: DataFrame, batch: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """The table after a batch: upserts replace, removals delete, older versions than the table's change nothing.

    Where the table has a boolean column ``deleted``, removed rows stay in it as tombstones with their version, so that an older upsert that
    comes in a later batch doesn't bring them back (``present`` leaves them out); without it removals are forgotten."""
    last = debounced(batch, key, version)
    kept = "deleted" in table.columns
    op = F.when(F.coalesce("deleted", F.lit(False)), "remove").otherwise("upsert") if kept else F.lit("upsert")
    rest = [c for c in table.columns if c != "deleted"]
    both = table.withColumn("op", op).select(*rest, "op").unionByName(last.select(*rest, "op"))
    now = latest(both, [key], F.col(version).desc(), (F.col("op") == "remove").desc())
    if kept:
        return now.withColumn("deleted", F.col("op") == "remove").select(table.columns)
    return now.where("op <> 'remove'").drop("op")


def present(table: DataFrame) -> DataFrame:
    """The rows of a table with tombstones that are not removed."""
    return table.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def follow(changes: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, key: str = "path") -> DataStreamWriter:
    """Keeps a table up to date with a stream; a batch that is replayed after a failure gives the same table."""

    def step(batch: DataFrame, _: int) -> None:
        save(apply_changes(load(), batch.where(watched(key)), key))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def upserted(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The latest value of each key of a stream, kept in state."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def tail(entries: DataFrame, since: str | None = None, n: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries of a log after an id, or the last n."""
    out = entries if since is None else entries.where(F.col("id") > since)
    out = out.orderBy(F.col("id").desc() if reverse else F.col("id"))
    return out if n is None else out.limit(n)


def trimmed(entries: DataFrame, most: int, stream: str = "stream") -> DataFrame:
    """The last ``most`` entries of each stream."""
    n = F.row_number().over(Window.partitionBy(stream).orderBy(F.col("id").desc()))
    return entries.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def group_read(entries: DataFrame, deliveries: DataFrame, group: str, n: int) -> DataFrame:
    """The next entries that a group has not been given. deliveries: (group, stream, id, consumer, delivered_ms, acked)."""
    mine = deliveries.where(F.col("group") == group).select("stream", "id")
    return entries.join(mine, ["stream", "id"], "left_anti").orderBy("id").limit(n)


def pending(deliveries: DataFrame, group: str) -> DataFrame:
    return deliveries.where((F.col("group") == group) & ~F.col("acked"))


def acked(deliveries: DataFrame, group: str, ids: list[str]) -> DataFrame:
    return deliveries.withColumn("acked", F.col("acked") | ((F.col("group") == group) & F.col("id").isin(ids)))


def claimed(deliveries: DataFrame, group: str, consumer: str, now_ms: int, idle_ms: int) -> DataFrame:
    """Pending entries idle for long enough pass to another consumer."""
    old = (F.col("group") == group) & ~F.col("acked") & (F.lit(now_ms) - F.col("delivered_ms") >= idle_ms)
    return deliveries.withColumns({"consumer": F.when(old, consumer).otherwise(F.col("consumer")), "delivered_ms": F.when(old, F.lit(now_ms)).otherwise(F.col("delivered_ms"))})


def subscribed(messages: DataFrame, channel: str | None = None, pattern: str | None = None) -> DataFrame:
    """Messages of a channel, or of channels that match a pattern with * and ?."""
    import re

    if channel is not None:
        return messages.where(F.col("channel") == channel)
    rx = "^" + re.escape(pattern or "*").replace(r"\*", ".*").replace(r"\?", ".") + "$"
    return messages.where(F.col("channel").rlike(rx))


def series(samples: DataFrame, key: str = "key", ts: str = "ts_ms", value: str = "value", arrival: str = "arrival") -> DataFrame:
    """One sample per key and time: the last that arrived."""
    return samples.groupBy(key, ts).agg(F.max_by(value, arrival).alias(value))


def series_range(samples: DataFrame, start_ms: int, end_ms: int, ts: str = "ts_ms") -> DataFrame:
    return samples.where(F.col(ts).between(start_ms, end_ms)).orderBy(ts)


def retained(samples: DataFrame, days: float = 7.0, key: str = "key", ts: str = "ts_ms") -> DataFrame:
    """Samples no older than the retention before each key's latest."""
    last = samples.groupBy(key).agg(F.max(ts).alias("_last"))
    return samples.join(last, key).where(F.col(ts) >= F.col("_last") - int(days * 86_400_000)).drop("_last")
