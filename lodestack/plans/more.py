"""More registered queries: pages, filters, validators, full-text search, graph upkeep, logs, composed search and ingest, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalog, chunking, graph, retrieval, routing, state, transcripts
from ..streaming import flows
from .queries import _CONV, _MOTIFS, _QV, _TREE, _audit, _entities, _first_vector, _messages, _motifs, _relations, _tree, _tunnels, register, table

# --- pages and filters --------------------------------------------------------------------------------------------------------


@register("SELECT event_id AS id, event_type FROM events WHERE user_id % 3 = 1 ORDER BY event_id DESC LIMIT 50 OFFSET 50")
def cursor_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page, by the first one's cursor."""
    mine = state.scoped(_audit(spark, sf), "p1")
    first = state.page(mine, "audit")
    return state.page(mine, "audit", cursor=first.next_cursor).rows.select("id", "event_type")


@register("SELECT event_id AS id FROM events WHERE user_id % 3 = 1 AND event_type = 'purchase'")
def equality_filters(spark: SparkSession, sf: str) -> DataFrame:
    return state.scoped(_audit(spark, sf), "p1", event_type="purchase", outcome=None).select("id")


@register(f"WITH {_TREE} SELECT node_id, kind, label FROM t ORDER BY kind, label, node_id LIMIT 100 OFFSET 10")
def nodes_page(spark: SparkSession, sf: str) -> DataFrame:
    return state.page_at(_tree(spark, sf), "nodes", state.page_size("nodes"), 10).select("node_id", "kind", "label")


@register("""
WITH o AS (SELECT 'n' || c_nationkey AS x, 'n' || ((c_nationkey * 7 + o_orderkey) % 25) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
u AS (SELECT DISTINCT least(x, y) AS from_node_id, greatest(x, y) AS to_node_id FROM o WHERE x <> y)
SELECT from_node_id, to_node_id FROM u ORDER BY from_node_id, to_node_id LIMIT 200""")
def tunnels_page(spark: SparkSession, sf: str) -> DataFrame:
    return state.page_at(_tunnels(spark, sf), "tunnels", state.page_size("tunnels"), 0).select("from_node_id", "to_node_id")


@register("SELECT CAST(conv_id AS VARCHAR) AS transcript_path, max(turn) AS updated_at FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def sources_page(spark: SparkSession, sf: str) -> DataFrame:
    s = _messages(spark, sf).groupBy(F.col("source_id").alias("transcript_path")).agg(F.max("turn_index").alias("updated_at"))
    return state.page_at(s, "sources", state.page_size("sources"), 0)


@register("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS source_path FROM conversations")
def source_paths(spark: SparkSession, sf: str) -> DataFrame:
    return state.source_paths(chunking.conversation(_messages(spark, sf)))


@register(f"SELECT CAST(conv_id AS VARCHAR) || ':0' AS id, {_CONV} AS content FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) QUALIFY row_number() OVER (ORDER BY turn) = 1")
def fetch_chunk(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    least = table(spark, sf, "conversations").agg(F.min("conv_id")).first()[0]
    return state.by_id(chunking.conversation(m), "id", f"{least}:0").select("id", "content")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as conversation chunks whose wing is the source and whose hall is the language."""
    d = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("conversation").alias("language"), none.alias("signature"), none.alias("symbol"), F.array(F.lit("conversation"), "source", "lang").alias("heading_hierarchy"))


@register("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents)")
def palace_filter(spark: SparkSession, sf: str) -> DataFrame:
    wing = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    return retrieval.palace(_places(spark, sf), wing=wing, hall="en").select("id")


@register(f"""SELECT vec_id AS id, n_chars, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings JOIN documents ON doc_id = vec_id
WHERE lang = 'en' ORDER BY score DESC, id LIMIT 25""")
def memory_search(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a place by their vectors: documents are the chunks of the vectors with their numbers."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.memory_search(_places(spark, sf), v, _first_vector(spark, sf), 25, digits=6, hall="en")
    return found.select("id", F.length("content").cast("long").alias("n_chars"), "score")


# --- names, ids, validators --------------------------------------------------------------------------------------------------

_SLUG = "regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@register(f"SELECT s_suppkey, 'room:' || {_SLUG.format(c='s_name')} || '-' || substr(sha256('v2:room:' || n_name || ':' || s_name), 1, 32) AS node_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", t.node_id(F.lit("room"), F.col("n_name"), F.col("s_name")).alias("node_id"))


@register("SELECT DISTINCT 'tunnel-' || substr(sha256('v2:' || least(c_mktsegment, n_name) || ':' || greatest(c_mktsegment, n_name)), 1, 32) AS tunnel_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def tunnel_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(t.tunnel_id("c_mktsegment", "n_name").alias("tunnel_id")).distinct()


@register("""SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS entry_date, 'diary-' || substr(sha256(user_id || ':' || strftime(ts, '%Y-%m-%d')), 1, 32) AS entry_id, ['a b', 'c'] AS tags FROM events""")
def diary_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.col("user_id").cast("string").alias("project_id"), F.date_format("ts", "yyyy-MM-dd").alias("entry_date")).distinct()
    e = e.withColumns({"mood": F.lit("  "), "tags": F.array(F.lit(" A b "), F.lit("c"), F.lit(""), F.lit("a B"))})
    return state.diary_entry(e).where("mood is null").select("user_id", "entry_date", "entry_id", "tags")


@register("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9 _.:/\\-]+$') AND length(p_name) <= 12 AND p_name NOT LIKE '%..%' AS ok FROM part")
def name_validity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", t.valid_name("p_name", 12).alias("ok"))


@register("SELECT page_id, regexp_matches(lower(url), '\\.(md|markdown|txt|json|png|jpg|jpeg)$') AS watched FROM pages")
def watched_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", flows.watched("url").alias("watched"))


# --- catalog -----------------------------------------------------------------------------------------------------------------


def _tools(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    risk = F.when(F.col("p_size") < 15, "low").when(F.col("p_size") < 35, "medium").otherwise("high")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.lit("").alias("when_to_use"), F.col("p_brand").alias("what_it_finds"),
        F.split("p_type", " ").alias("tags"), risk.alias("risk_level"), F.when(F.col("p_size") % 2 == 0, "core").otherwise("project").alias("visibility_mode"),
    )


@register("SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_size < 35 AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def capability_filter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.capabilities(_tools(spark, sf), "Ring", "core", "medium").select("id")


@register("""
WITH d AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || '  ' || p_brand || ' ' || p_type), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tk FROM part),
f AS (SELECT id, len(tk) AS n, len(list_filter(tk, lambda x: x = 'ring')) AS f0, len(list_filter(tk, lambda x: x = 'small')) AS f1 FROM d),
s AS (SELECT count(*) AS c, avg(n) AS a, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM f)
SELECT id FROM f, s WHERE f0 > 0 AND f1 > 0""")
def catalog_fts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(_tools(spark, sf), "Small ring", None).select("id")


@register("SELECT p_partkey AS id, trim(p_type || '  ' || p_brand || ' ' || p_type) AS embedding_text FROM part")
def tool_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return _tools(spark, sf).select("id", catalog.embedding_text().alias("embedding_text"))


@register("SELECT p_partkey AS id FROM part WHERE NOT (p_partkey IN (1, 2, 3, 4) AND p_partkey % 2 = 0)")
def user_tool_removal(spark: SparkSession, sf: str) -> DataFrame:
    tools = _tools(spark, sf).withColumn("source", F.when(F.col("id") % 2 == 0, "user").otherwise("catalog"))
    return catalog.remove_user_tools(tools, [1, 2, 3, 4]).select("id")


# --- transcripts and diary ---------------------------------------------------------------------------------------------------


def _diary(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), "turn").alias("entry_id"), F.lit("2024-01-05").alias("entry_date"), F.col("turn").alias("updated_at"), F.lit(None).cast("string").alias("mood"), F.array("role").alias("tags"), F.col("text").alias("content"))


_ENTRY = "lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || turn AS entry_id"


@register(f"SELECT {_ENTRY} FROM conversations WHERE list_has_all(list_filter(regexp_split_to_array(lower(role || ' ' || text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ['user', 'the'])")
def diary_fts(spark: SparkSession, sf: str) -> DataFrame:
    return state.diary_search(_diary(spark, sf), "the user").select("entry_id")


@register(f"SELECT {_ENTRY} FROM conversations WHERE lower(text) LIKE '%us_r%' OR lower(role) LIKE '%us_r%'")
def diary_like(spark: SparkSession, sf: str) -> DataFrame:
    return state.diary_search(_diary(spark, sf), "us_r", "2024-01-01", "2024-01-31", like=True).select("entry_id")


def _exports(spark: SparkSession, sf: str, form: str) -> DataFrame:
    """Each conversation as one export; its messages in the order of their turns."""
    m = _messages(spark, sf).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", "content"))).alias("m"))
    part = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text"))).alias("content")))
    payload = F.to_json(part) if form == "claude" else F.array_join(F.transform(part, lambda x: F.to_json(x)), "\n")
    return m.select("source_id", F.lit(form).alias("format"), payload.alias("payload"))


_PARSED = "SELECT CAST(conv_id AS VARCHAR) AS source_id, CASE WHEN lower(role) IN ('system', 'user', 'assistant', 'tool') THEN lower(role) ELSE 'unknown' END AS role, coalesce(text, '') AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn_index FROM conversations"


@register(_PARSED)
def parsed_messages(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.parsed(_exports(spark, sf, "claude"))


@register(_PARSED)
def parsed_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.parsed(_exports(spark, sf, "jsonl"))


@register(f"""WITH p AS ({_PARSED}), c AS (SELECT source_id, turn_index, '[turn:' || turn_index || '][role:' || role || ']' || chr(10) || content AS content FROM p)
SELECT source_id || ':' || turn_index AS id, source_id AS source_path, content FROM c UNION ALL SELECT 'kept:0', 'kept', 'other source'""")
def ingest_conversation(spark: SparkSession, sf: str) -> DataFrame:
    """Exports parsed, chunked and put in place of the chunks that their sources had."""
    new = chunking.conversation(transcripts.parsed(_exports(spark, sf, "claude"))).select("id", "source_path", "content")
    old = _messages(spark, sf).select(F.concat("source_id", F.lit(":old")).alias("id"), F.col("source_id").alias("source_path"), "content")
    kept = spark.range(1).select(F.lit("kept:0").alias("id"), F.lit("kept").alias("source_path"), F.lit("other source").alias("content"))
    return state.replace_source(old.unionByName(kept), new)


@register(f"WITH {_MOTIFS} SELECT CAST(coalesce(sum(confidence_percent) // count(*), 0) AS BIGINT) AS confidence FROM c")
def mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.mean_confidence(_motifs(spark, sf)).select(F.col("confidence").cast("long").alias("confidence"))


@register("SELECT event_id, 'p1' AS wing, 'hook:' || event_type AS hall, 'event:' || event_type AS room FROM events")
def captured_hooks(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("event"), none.alias("wing"), none.alias("hall"), none.alias("room"))
    return transcripts.captured(e, "p1").select("event_id", "wing", "hall", "room")


# --- graph -------------------------------------------------------------------------------------------------------------------


@register("""
WITH r AS (SELECT c_mktsegment AS source, n_name AS target, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT source, target, min(k) AS position FROM r GROUP BY source, target""")
def merged_relations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.select(F.col("c_mktsegment").alias("source"), F.col("n_name").alias("target"), F.lit("In").alias("relation_type"), F.col("c_custkey").alias("position"))
    return graph.merge_relations(r).select("source", "target", "position")


@register("""SELECT 'entity' AS kind, name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT s_name FROM supplier WHERE s_suppkey <> 1)
UNION ALL SELECT 'relation', c_name FROM customer UNION ALL SELECT 'relation', s_name FROM supplier""")
def chunk_removal(spark: SparkSession, sf: str) -> DataFrame:
    e, r = graph.remove_chunk(_entities(spark, sf), _relations(spark, sf), "s1")
    return e.select(F.lit("entity").alias("kind"), "name").union(r.select(F.lit("relation").alias("kind"), "source"))


@register("SELECT 's' || s_suppkey AS node_id FROM supplier UNION ALL SELECT 'r' || r_regionkey FROM region WHERE false")
def parent_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers are made closets within closets, which the rule forbids."""
    kind = F.when(F.col("kind") == "region", "drawer").otherwise("closet")
    return graph.parent_violations(_tree(spark, sf).withColumn("kind", kind)).select("node_id")


# --- routing and logs --------------------------------------------------------------------------------------------------------


@register("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'retrieval' WHEN contains(lower(text), 'search') OR contains(lower(text), 'docs') THEN 'retrieval' WHEN contains(lower(text), 'run') OR contains(lower(text), 'execute') THEN 'execution' ELSE 'default' END AS route FROM documents""")
def route_intent(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("intent", F.when(F.col("lang") == "en", "search"))
    return routing.routed(d, "text", "intent").select("doc_id", "route")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), "event_type")


def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and logins are delivered to group g; logins are acknowledged."""
    d = _log(spark, sf).where("event_type in ('purchase', 'login')")
    return d.select(F.lit("g").alias("group"), "stream", "id", F.lit("one").alias("consumer"), (F.col("id") * 10).alias("delivered_ms"), (F.col("event_type") == "login").alias("acked"))


@register("SELECT event_id AS id FROM events WHERE event_type NOT IN ('purchase', 'login') ORDER BY event_id LIMIT 500")
def group_read(spark: SparkSession, sf: str) -> DataFrame:
    return flows.group_read(_log(spark, sf), _deliveries(spark, sf), "g", 500).select("id")


@register("SELECT event_id AS id, CASE WHEN 50000 - event_id * 10 >= 10000 THEN 'two' ELSE 'one' END AS consumer FROM events WHERE event_type = 'purchase'")
def group_claim(spark: SparkSession, sf: str) -> DataFrame:
    return flows.pending(flows.claimed(_deliveries(spark, sf), "g", "two", 50_000, 10_000), "g").select("id", "consumer")


@register("SELECT event_id AS id FROM events WHERE event_id > 100 ORDER BY event_id DESC LIMIT 40")
def log_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return flows.tail(_log(spark, sf), 100, 40, reverse=True).select("id")


@register("SELECT event_id AS id FROM events WHERE event_type LIKE 'p_rch%'")
def pattern_subscription(spark: SparkSession, sf: str) -> DataFrame:
    return flows.subscribed(_log(spark, sf).withColumnRenamed("event_type", "channel"), pattern="p?rch*").select("id")


@register("""
WITH b AS (SELECT c_custkey AS path, 2 AS version, CASE WHEN c_custkey % 3 = 0 THEN 'remove' ELSE 'upsert' END AS op FROM customer WHERE c_nationkey < 12)
SELECT c_custkey AS path, CASE WHEN b.path IS NULL THEN 1 ELSE 2 END AS version FROM customer LEFT JOIN b ON c_custkey = b.path WHERE op IS NULL OR op <> 'remove'""")
def change_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream's batch does to the table: later versions replace, removals delete."""
    c = table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("path"), F.col("c_name").alias("content"), F.lit(1).alias("version"))
    batch = c.where("c_nationkey < 12").select(F.col("c_custkey").alias("path"), F.lit("new").alias("content"), F.lit(2).alias("version"), F.when(F.col("c_custkey") % 3 == 0, "remove").otherwise("upsert").alias("op"))
    return flows.apply_changes(base, batch).select("path", "version")


# --- lookups, availability, semantic tool search, the graph as nodes and edges ------------------------------------------------------


@register("SELECT 'node' AS part, n_name AS id, NULL AS target, 'nation' AS type FROM nation UNION ALL SELECT 'node', s_name, NULL, 'supplier' FROM supplier "
          "UNION ALL SELECT 'edge', c_name, n_name, 'buys_in' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'edge', s_name, n_name, 'sells_in' FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def graph_view(spark: SparkSession, sf: str) -> DataFrame:
    return graph.view(_entities(spark, sf), _relations(spark, sf))


@register("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS entity_count, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS relation_count")
def graph_view_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.view_counts(graph.view(_entities(spark, sf), _relations(spark, sf)))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A profile per customer: the later of two versions stays."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("project_id"), F.col("c_name").alias("profile_json"), F.lit(0).alias("updated_at"))
    new = c.withColumns({"profile_json": F.concat(F.lit("new "), "profile_json"), "updated_at": F.lit(1)})
    return state.upsert(c, new, ["project_id"])


@register("SELECT 'new ' || c_name AS profile_json FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def latest_profile(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    return state.latest_profile(_profiles(spark, sf), f"c{last}")


@register("SELECT count(*) AS n FROM customer")
def profile_count(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).agg(F.count("*").alias("n"))


@register("SELECT CAST(coalesce(max(event_id), 0) AS BIGINT) AS version FROM events")
def schema_version(spark: SparkSession, sf: str) -> DataFrame:
    return state.schema_version(table(spark, sf, "events").select(F.col("event_id").cast("long").alias("version")))


@register("SELECT 'u' || user_id AS project_id, CASE WHEN bool_or(event_type = 'error') THEN 'high' ELSE 'medium' END AS risk_level FROM events GROUP BY 1")
def effective_risk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return state.effective_risk(e.select(F.concat(F.lit("u"), "user_id").alias("project_id"), F.when(F.col("event_type") == "error", "unsafe-tools").otherwise("docs").alias("family")))


@register("SELECT DISTINCT l_partkey AS tool_id FROM lineitem WHERE l_returnflag IN ('A', 'R') ORDER BY tool_id")
def enabled_union(spark: SparkSession, sf: str) -> DataFrame:
    enabled = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("tool_id"), F.col("l_returnflag").alias("project_root"))
    return catalog.enabled_ids(enabled, "A", "R")


@register(f"""WITH h AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score, list_cosine_similarity(embedding::DOUBLE[], {_QV}) AS raw FROM embeddings),
k AS (SELECT id, score FROM h WHERE raw >= 0.1 ORDER BY score DESC, id LIMIT 30)
SELECT id, score, CASE WHEN id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) THEN 'enabled' ELSE 'available' END AS state FROM k JOIN part ON p_partkey = id""")
def tool_semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of tools meet the catalog by id; vectors of no tool are hits that go."""
    tools = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    enabled = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("tool_id"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return catalog.semantic(tools, enabled, v, _first_vector(spark, sf), 30, 0.1, digits=6).select("id", "score", "state")


@register("""
WITH m AS (SELECT *, (event_type = 'error')::INT AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CAST(streak AS BIGINT) AS streak, streak = 0 OR epoch_us((SELECT max(ts) FROM events)) >= epoch_us(ts) + 1000000 * CASE streak WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 60 END AS available FROM l""")
def provider_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's calls, whether the last one leaves it available at the time of the last event of all."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = routing.failure_runs(e, "user_id", F.col("event_type") == "error", F.col("ts"), F.col("event_id"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return routing.availability(runs, "user_id", "ts", now, "ts", "event_id").withColumn("streak", F.col("streak").cast("long"))
