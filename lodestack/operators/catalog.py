"""Tool catalog: import, derived state, suggestions, full-text ranking, inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fts_tokens
from .retrieval import bm25, dense_search
from .state import upsert

TOOL = "id string, name string, type string, category array<string>, languages array<string>, description string, when_to_use string, what_it_finds string, install struct<command:string>, run struct<command:string>, risk_level string, tags array<string>, github string, trust_level string"
RISK = {"low": 1, "medium": 2, "high": 3}


def read_tools(spark: object, paths: list[str], source: str = "catalog") -> DataFrame:
    """Tool arrays of JSON files as catalog rows."""
    raw = spark.read.schema(TOOL).json(paths, multiLine=True)
    return raw.where("id is not null").select("id", "name", "type", "category", "languages", "description", "when_to_use", "what_it_finds", F.col("install.command").alias("install_command"), F.col("run.command").alias("run_command"), "risk_level", "tags", "github", "trust_level", F.lit(source).alias("source"))


def import_tools(catalog: DataFrame, tools: DataFrame, updated: str = "updated_at") -> DataFrame:
    return upsert(catalog, tools, ["id"], updated)


def risk_rank(c: str = "risk_level") -> F.Column:
    return F.coalesce(*[F.when(F.lower(c) == k, F.lit(v)) for k, v in RISK.items()], F.lit(3))


def with_state(tools: DataFrame, enabled: DataFrame, cli: str | None = None, root: str | None = None) -> DataFrame:
    """'enabled' for tools that the project enabled, else 'available'. The enabled rows are filtered before the join."""
    mine = enabled
    for c, v in (("cli", cli), ("project_root", root)):
        if v is not None:
            mine = mine.where(F.col(c) == v)
    on = mine.select(F.col("tool_id").alias("_tool")).distinct()
    joined = tools.join(on, tools["id"] == on["_tool"], "left")
    return joined.withColumn("state", F.when(F.col("_tool").isNotNull(), "enabled").otherwise("available")).drop("_tool")


def suggest(tools: DataFrame, enabled: DataFrame, k: int, languages: list[str] | None = None, category: str | None = None, tool_type: str | None = None, max_risk: str | None = None, cli: str | None = None, root: str | None = None) -> DataFrame:
    """Tools of any of the given languages, of a category, a type and a risk at most; enabled first, then by name."""
    t = tools
    if languages:
        t = t.where(F.arrays_overlap("languages", F.array(*[F.lit(x) for x in languages])))
    if category:
        t = t.where(F.array_contains("category", category))
    if tool_type:
        t = t.where(F.col("type") == tool_type)
    if max_risk:
        t = t.where(risk_rank() <= RISK[max_risk])
    out = with_state(t, enabled, cli, root)
    return out.withColumn("grouping", F.when(F.col("state") == "enabled", "enabled").otherwise("recommended")).orderBy(F.col("state").desc(), "name", "id").limit(k)


def enabled_ids(enabled: DataFrame, *roots: str) -> DataFrame:
    """The distinct tools that a project enabled under any of its root's spellings (the canonical and the given one), in order."""
    return enabled.where(F.col("project_root").isin(*roots)).select("tool_id").distinct().orderBy("tool_id")


def semantic(tools: DataFrame, enabled: DataFrame, vectors: DataFrame, query: Sequence[float], k: int, threshold: float = 0.3, digits: int | None = None) -> DataFrame:
    """The k tools whose vectors are nearest to the query's, with state; a hit that the catalog does not hold goes."""
    hits = dense_search(vectors, query, k, threshold, digits=digits).select("id", "score")
    found = tools.join(F.broadcast(hits), "id")  # k hits at most
    return with_state(found, enabled).orderBy(F.col("score").desc(), "id")


def search(tools: DataFrame, query: str, k: int) -> DataFrame:
    """Tools that hold every token of the query, best BM25 first."""
    text = F.concat_ws(" ", "name", "description", "when_to_use", "what_it_finds", F.array_join("tags", " "))
    return bm25(tools, query, k, fts_tokens(text)).join(tools, "id").orderBy(F.col("score").desc(), "id")


def embedding_text() -> F.Column:
    return F.trim(F.concat_ws(" ", "description", "when_to_use", "what_it_finds", F.array_join("tags", " ")))


def full_info(tools: DataFrame, inventory: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """Tools with what the inventory knows of their binaries."""
    inv = inventory.select(F.col("binary_name").alias("_bin"), F.col("path").alias("installed_path"), F.col("version").alias("installed_version"))
    out = tools.join(inv, tools["id"] == inv["_bin"], "left").drop("_bin")
    return out.withColumn("state", F.when(F.col("installed_path").isNotNull(), "installed").otherwise("available"))


def remove_user_tools(tools: DataFrame, ids: list[str]) -> DataFrame:
    """Only what users added can be removed."""
    return tools.where(~(F.col("id").isin(ids) & (F.col("source") == "user")))


def capabilities(caps: DataFrame, query: str | None = None, visibility: str | None = None, budget: str | None = None) -> DataFrame:
    """Capabilities by substring, visibility and risk budget; core ones when the text matches none."""
    out = caps
    if visibility:
        out = out.where(F.col("visibility_mode") == visibility)
    if budget:
        out = out.where(risk_rank() <= RISK[budget])
    if query:
        q = query.lower()
        hit = out.where(F.lower("id").contains(q) | F.lower("title").contains(q) | F.lower("description").contains(q))
        out = hit if not hit.isEmpty() else out.where(F.col("visibility_mode") == "core")
    return out.orderBy("id")


def tool_list(tools: DataFrame, enabled: DataFrame, state: str | None = None, most: int = 1000) -> DataFrame:
    out = with_state(tools, enabled)
    return (out if state is None else out.where(F.col("state") == state)).orderBy(F.col("state").desc(), "name", "id").limit(most)
