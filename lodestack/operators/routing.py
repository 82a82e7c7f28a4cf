"""Request routing, approvals, provider health and order, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COOLDOWN = (5, 15, 60)  # seconds after 1, 2, and 3 or more failures in a row
SAMPLES = 20


def rule_route(request: Column | str) -> Column:
    """retrieval for 'search' or 'docs'; execution for 'run' or 'execute'; else the default. By substring, regardless of case."""
    t = F.lower(F.col(request) if isinstance(request, str) else request)
    return F.when(t.contains("search") | t.contains("docs"), "retrieval").when(t.contains("run") | t.contains("execute"), "execution").otherwise("default")


def routed(requests: DataFrame, request: str = "request", intent: str | None = None) -> DataFrame:
    """Adds route, requires_memory_search, requires_approval. A classifier's intent, where it is known, overrides the rules."""
    rule = rule_route(request)
    route = rule if intent is None else F.when(F.col(intent).isin("search", "retrieval"), "retrieval").when(F.col(intent).isin("run", "execution"), "execution").otherwise(rule)
    return requests.withColumn("route", route).withColumns({"requires_memory_search": F.col("route") == "retrieval", "requires_approval": F.col("route") == "execution"})


def approved(actions: DataFrame, approvals: DataFrame, interactive: bool = False) -> DataFrame:
    """The decision on each action (project_id, action_key, risk_level): low risks pass; else an approval for the session or for good, else
    interactive sessions allow and headless ones deny."""
    seen = approvals.where("approved").groupBy("project_id", "action_key").agg(F.max((F.col("scope") == "session").cast("int")).alias("s"), F.max((F.col("scope") == "forever").cast("int")).alias("f"))
    j = actions.join(seen, ["project_id", "action_key"], "left")
    decision = F.when(F.lower("risk_level") != "high", "allow").when(F.col("s") == 1, "session").when(F.col("f") == 1, "forever").otherwise("allow" if interactive else "deny")
    return j.withColumn("decision", decision).drop("s", "f")


def p50(samples: DataFrame, key: str, value: str, order: Column, most: int = SAMPLES) -> DataFrame:
    """Upper median of the last ``most`` samples of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    last = samples.withColumn("_n", n).where(F.col("_n") <= most)
    sorted_ = last.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return sorted_.select(key, F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("p50"))


def failure_runs(calls: DataFrame, key: str, failed: Column, *order: Column) -> DataFrame:
    """Adds ``streak``, the failures in a row up to each call, and ``cooldown_s``, what the last one costs."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = calls.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("_f").over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cost = F.when(F.col("streak") == 0, 0).when(F.col("streak") == 1, COOLDOWN[0]).when(F.col("streak") == 2, COOLDOWN[1]).otherwise(COOLDOWN[2])
    return marked.withColumn("streak", streak).withColumn("cooldown_s", cost).drop("_f", "_island")


def availability(runs: DataFrame, key: str, at: str, now: Column, *order: str) -> DataFrame:
    """Of each provider whether it may be asked now: after its last call (failure_runs gives streak and cooldown_s) it is healthy, or its
    cooldown, counted from that call's time ``at``, has passed. One row per key by a partial aggregate."""
    last = runs.groupBy(key).agg(F.max_by(F.struct("streak", "cooldown_s", at), F.struct(*order)).alias("x")).select(key, "x.*")
    passed = F.unix_micros(now) >= F.unix_micros(at) + F.col("cooldown_s").cast("long") * 1_000_000
    return last.select(key, "streak", ((F.col("streak") == 0) | passed).alias("available"))


def provider_order(providers: DataFrame, policy: str, counter: int = 0, available: str | None = None) -> DataFrame:
    """Available providers (idx from 0, p50) in order, with their ``turn`` from 0: by priority, round robin from the counter, or latency."""
    p = providers if available is None else providers.where(available)
    if policy not in ("priority", "latency", "round_robin"):
        raise ValueError(f"unknown policy {policy!r}")
    order = [F.col("p50").asc_nulls_last(), F.col("idx")] if policy == "latency" else [F.col("idx")]
    turn = F.row_number().over(Window.orderBy(*order)) - 1  # a pool of providers is short
    n = p.count() if policy == "round_robin" else 0
    return p.withColumn("turn", F.pmod(turn - counter % n, F.lit(n)) if n else turn).orderBy("turn")


def metrics(calls: DataFrame, by: str, value: str) -> DataFrame:
    """Calls, total and whole-number average by operation; 0 without calls."""
    g = calls.groupBy(by).agg(F.count(value).alias("calls"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))
    return g.withColumn("average", F.when(F.col("calls") == 0, 0).otherwise(F.expr("total div calls")))


def clamp(value: int, low: int, high: int) -> int:
    """Limits are clamped, not refused."""
    return max(low, min(value, high))
