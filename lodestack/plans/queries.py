"""The registered queries of the library's own operators, each over its whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalog, chunking, evaluation, graph, retrieval, routing, state, transcripts
from ..streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TERMS = "the que und"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _first_vector(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: that of the least id."""
    return list(_vectors(spark, sf).where("vector is not null").orderBy("id").limit(1).first()["vector"])


# --- retrieval ---------------------------------------------------------------------------------------------------------------

_KEYWORD = "(CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'und') AS INT)) / 3.0"
_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)"


@register(f"SELECT doc_id AS id, round({_KEYWORD}, 6) AS score FROM documents WHERE {_KEYWORD} > 0.3 ORDER BY {_KEYWORD} DESC, doc_id LIMIT 50")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.keyword_search(_docs(spark, sf), TERMS, 50, 0.3).select("id", F.round("score", 6).alias("score"))


@register(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_search(_vectors(spark, sf), _first_vector(spark, sf), 20, digits=6).select("id", "score")


@register("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s
QUALIFY rank <= 5""")
def dense_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.dense_batch(v, q, 5).select("query_id", "id", "score", "rank")


@register(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings WHERE label % 2 = 1 ORDER BY score DESC, id LIMIT 10")
def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_search(_vectors(spark, sf).where("label % 2 = 1"), _first_vector(spark, sf), 10, digits=6).select("id", "score")


@register(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_QV}) >= 0.25 ORDER BY score DESC, id")
def dense_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_search(_vectors(spark, sf), _first_vector(spark, sf), None, 0.25, digits=6).select("id", "score")


_DENSE_40 = f"(SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 6) AS d FROM embeddings ORDER BY d DESC, id LIMIT 40)"
_SPARSE_40 = "(SELECT doc_id AS id, (length(text) - length(replace(lower(text), 'the', ''))) / 3.0 AS s FROM documents WHERE contains(lower(text), 'the') ORDER BY s DESC, id LIMIT 40)"


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of 'the' as a sparse score."""
    n = (F.length("content") - F.length(F.replace(F.lower("content"), F.lit("the"), F.lit("")))) / 3.0
    return retrieval.top_k(_docs(spark, sf).where(F.lower("content").contains("the")).select("id", n.alias("score")), 40)


@register(f"""
SELECT coalesce(a.id, b.id) AS id, round(coalesce(d, 0) * 0.7 + coalesce(s / (s + 5.0), 0) * 0.3, 6) AS score
FROM {_DENSE_40} a FULL JOIN {_SPARSE_40} b ON a.id = b.id ORDER BY score DESC, id LIMIT 30""")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    dense = retrieval.dense_search(_vectors(spark, sf), _first_vector(spark, sf), 40, digits=6)
    return retrieval.fuse(dense, _sparse(spark, sf), 30, digits=6).select("id", "score")


@register(f"""
SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN d IS NULL THEN g WHEN g IS NULL THEN d ELSE d + 0.3 * g END, 6) AS score
FROM {_DENSE_40} a FULL JOIN (SELECT id, s / (s + 5.0) AS g FROM {_SPARSE_40}) b ON a.id = b.id ORDER BY score DESC, id LIMIT 30""")
def hybrid_graph_boost(spark: SparkSession, sf: str) -> DataFrame:
    dense = retrieval.dense_search(_vectors(spark, sf), _first_vector(spark, sf), 40, digits=6)
    g = _sparse(spark, sf).withColumn("score", t.saturate("score"))
    return retrieval.boost(dense, g, 30, digits=6).select("id", "score")


@register("SELECT doc_id AS id FROM documents WHERE list_has_all(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ['the', 'and', 'that'])")
def fts_all_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return state.fts(_docs(spark, sf), "the and that", "content").select("id")


@register("""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tk FROM documents),
f AS (SELECT id, len(tk) AS n, len(list_filter(tk, lambda x: x = 'of')) AS f0, len(list_filter(tk, lambda x: x = 'with')) AS f1 FROM d),
s AS (SELECT count(*) AS c, avg(n) AS a, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM f)
SELECT id, round(f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / a)) * ln(1 + (c - d0 + 0.5) / (d0 + 0.5)) + f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / a)) * ln(1 + (c - d1 + 0.5) / (d1 + 0.5)), 6) AS score
FROM f, s WHERE f0 > 0 AND f1 > 0 ORDER BY score DESC, id LIMIT 25""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(_docs(spark, sf), "with of", 25, t.fts_tokens("content"), digits=6)


@register("SELECT doc_id AS id FROM documents WHERE lower(text) LIKE '%tion_the%'")
def like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(t.like_contains("content", "tion_the")).select("id")


@register(f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS l FROM embeddings),
s AS (SELECT query_id, l, label, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10),
h AS (SELECT query_id, min(CASE WHEN l = label THEN rank END) AS rank FROM r GROUP BY query_id)
SELECT count(*) AS queries, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS recall_1, round(avg((rank IS NOT NULL AND rank <= 5)::INT), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM h""")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    q = v.select(F.col("id").alias("query_id"), "vector")
    found = retrieval.dense_batch(v, q, 11).where("id <> query_id")  # each query finds itself as well
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    top = found.withColumn("rank", rank).where("rank <= 10").join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id")
    first = top.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("want"), F.col("rank"))).alias("rank"))
    q_ = evaluation.quality(first)
    return q_.select("queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")])


# --- transcripts -----------------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as messages: the language is the role."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("lang").alias("role"), F.posexplode(F.split("text", "\n", -1)).alias("turn_index", "content"))


_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_MOTIFS = """
l AS (SELECT lang AS role, unnest(string_split(text, chr(10))) AS txt FROM documents),
m AS (SELECT role, txt AS canonical_text, count(*) AS occurrence_count, octet_length(encode(regexp_replace(txt, '^\\s+|\\s+$', '', 'g'))) AS b FROM l
      WHERE regexp_replace(txt, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY role, txt HAVING count(*) >= 2),
c AS (SELECT role, canonical_text, occurrence_count, least(95, 50 + CASE WHEN b < 10 THEN 0 WHEN b < 24 THEN 5 WHEN b < 48 THEN 10 ELSE 15 END
      + CASE WHEN occurrence_count <= 1 THEN 0 WHEN occurrence_count = 2 THEN 10 WHEN occurrence_count = 3 THEN 20 ELSE 30 END) AS confidence_percent,
      'aaak-' || substr(sha256(upper(role[1]) || role[2:] || ':' || canonical_text), 1, 12) AS pattern_key FROM m)"""


def _motifs(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.motifs(_lines(spark, sf))


@register(f"WITH {_MOTIFS} SELECT role, canonical_text, occurrence_count, confidence_percent, pattern_key FROM c")
def motif_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _motifs(spark, sf).select("role", "canonical_text", "occurrence_count", "confidence_percent", "pattern_key")


@register(f"""WITH {_MOTIFS} SELECT pattern_key, confidence_percent, occurrence_count, 'lesson-' || substr(sha256('p1:' || pattern_key), 1, 16) AS lesson_id
FROM c WHERE confidence_percent >= 70 ORDER BY confidence_percent DESC, occurrence_count DESC, pattern_key LIMIT 8""")
def lesson_rank(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.lessons(_motifs(spark, sf), "p1").select("pattern_key", "confidence_percent", "occurrence_count", "lesson_id")


@register(f"""WITH {_MOTIFS}, r AS (SELECT count(*) AS messages FROM l), k AS (SELECT coalesce(sum(occurrence_count), 0) AS refs FROM c WHERE confidence_percent >= 70)
SELECT messages, CAST(refs AS BIGINT) AS refs, messages AS restored FROM r, k""")
def compress_expand(spark: SparkSession, sf: str) -> DataFrame:
    m = _lines(spark, sf).select("role", "content", (F.col("doc_id") * 100_000 + F.col("turn_index")).alias("turn_index"))
    turns, found = transcripts.compress(m)
    back = transcripts.expand(turns, found).select(F.col("role").alias("r"), F.col("content").alias("c"), F.col("turn_index").alias("t"))
    same = m.join(back, (F.col("turn_index") == F.col("t")) & (F.col("role") == F.col("r")) & (F.col("content") == F.col("c")))
    counts = turns.agg(F.count("*").alias("messages"), F.sum((F.col("kind") == "motif").cast("long")).alias("refs"))
    return counts.join(same.agg(F.count("*").alias("restored")), F.lit(True))


_FACT = "trim(regexp_replace(regexp_replace(x, '[\\s\\x{A0}]+', ' ', 'g'), '^ | $', '', 'g'))"


@register(f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS x FROM documents),
f AS (SELECT doc_id, pos, {_FACT} AS fact FROM l),
k AS (SELECT doc_id, fact, min(pos) AS pos FROM f WHERE fact <> '' AND NOT regexp_matches(fact, '^(#|Source:|Format:|Wing:|Hall:|Room:|\\[turn:)') GROUP BY doc_id, fact)
SELECT doc_id, CAST(pos AS INT) AS pos, fact FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3""")
def facts_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.facts(table(spark, sf, "documents"), "doc_id", "text", 3)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"))


_CONV = "'[turn:' || turn || '][role:' || role || ']' || chr(10) || text"


@register(f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || (row_number() OVER w - 1) AS id, CAST(octet_length(encode({_CONV})) AS INT) AS byte_length, sha256({_CONV}) AS content_hash,
CAST(coalesce(sum(octet_length(encode({_CONV})) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.conversation(_messages(spark, sf)).select("id", "byte_length", "content_hash", "byte_offset")


@register("SELECT CAST(conv_id AS VARCHAR) AS source_path, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def doc_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf).select(F.col("source_id").alias("source_path"), F.col("turn_index").alias("chunk_index"), "content")
    return chunking.reassemble(m)


@register(f"""
WITH s AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id::VARCHAR LIMIT 20),
d AS (SELECT conv_id, max(turn) AS u, string_agg(text, chr(10) ORDER BY turn) AS c FROM conversations SEMI JOIN s USING (conv_id) GROUP BY conv_id),
l AS (SELECT conv_id, u, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS pos, unnest(string_split(c, chr(10))) AS x FROM d),
f AS (SELECT conv_id, u, pos, {_FACT} AS fact FROM l),
k AS (SELECT conv_id, u, fact, min(pos) AS pos FROM f WHERE fact <> '' AND NOT regexp_matches(fact, '^(#|Source:|Format:|Wing:|Hall:|Room:|\\[turn:)') GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(pos AS INT) AS pos, fact FROM k ORDER BY u DESC, conv_id::VARCHAR, pos LIMIT 50""")
def wake_up(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    whole = chunking.reassemble(m.select(F.col("source_id").alias("source_path"), F.col("turn_index").alias("chunk_index"), "content")).withColumnRenamed("source_path", "source_id")
    sources = m.groupBy("source_id").agg(F.max("turn_index").alias("updated_at"))
    return transcripts.wake_up(sources, whole, 20, 50)


# --- state -----------------------------------------------------------------------------------------------------------------------


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    out = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "login", "denied").otherwise("unheard of")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"), "event_type", out.alias("outcome"), t.millis("ts").alias("created_at"))


@register("SELECT event_id AS id, event_type, (SELECT count(*) FROM events WHERE user_id % 3 = 1) AS total FROM events WHERE user_id % 3 = 1 ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    mine = state.scoped(_audit(spark, sf), "p1")
    return state.page_at(mine, "audit", 50, 100).select("id", "event_type").join(mine.agg(F.count("*").alias("total")), F.lit(True))


@register("SELECT CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'login' THEN 'denied' ELSE 'unknown' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def audit_by_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return state.audit_counts(_audit(spark, sf))


@register("""SELECT event_id AS entry_id, strftime(ts, '%Y-%m-%d') AS entry_date FROM events
WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY entry_date DESC, epoch_ms(ts) DESC, event_id LIMIT 100""")
def diary_range(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select(F.col("event_id").alias("entry_id"), F.date_format("ts", "yyyy-MM-dd").alias("entry_date"), t.millis("ts").alias("updated_at"))
    return state.page_at(state.date_range(d, "2024-01-05", "2024-01-20"), "diary", 100, 0).select("entry_id", "entry_date")


@register("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest(table(spark, sf, "events"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_type", "event_id", "value")


@register("""
WITH c AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 7 = 0
           UNION ALL SELECT c_custkey + 100000000, c_name, c_acctbal FROM customer WHERE c_custkey % 11 = 0)
SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM c
UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2) FROM customer ANTI JOIN c USING (c_custkey)""")
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(0).alias("updated_at"))
    a = base.where("c_custkey % 7 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "updated_at": F.lit(1)})
    b = base.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 100_000_000)
    return state.upsert(base, a.unionByName(b), ["c_custkey"]).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("SELECT p_partkey AS id, p_name AS name, CASE WHEN e.k IS NOT NULL THEN 'enabled' ELSE 'available' END AS state FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 50) e ON p_partkey = e.k ORDER BY state DESC, name, id LIMIT 1000")
def catalog_state(spark: SparkSession, sf: str) -> DataFrame:
    tools = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    enabled = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("tool_id"))
    return catalog.tool_list(tools, enabled).select("id", "name", "state")


@register("SELECT p_partkey, p_type FROM part WHERE list_contains(string_split(p_type, ' '), 'BRASS') OR list_contains(string_split(p_type, ' '), 'SMALL')")
def array_membership(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.where(F.arrays_overlap(F.split("p_type", " "), F.array(F.lit("BRASS"), F.lit("SMALL")))).select("p_partkey", "p_type")


# --- graph -----------------------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit("region").alias("kind"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent_node_id"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.concat(F.lit("r"), "n_regionkey").alias("parent_node_id"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("label"), F.concat(F.lit("n"), "s_nationkey").alias("parent_node_id"))
    return r.unionByName(n).unionByName(s)


_TREE = """
t AS (SELECT 'r' || r_regionkey AS node_id, 'region' AS kind, r_name AS label, NULL AS parent FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, 'n' || s_nationkey FROM supplier),
e AS (SELECT node_id AS a, parent AS b FROM t WHERE parent IS NOT NULL UNION ALL SELECT parent, node_id FROM t WHERE parent IS NOT NULL)"""


@register(f"""
WITH RECURSIVE {_TREE}, w AS (SELECT 'n3' AS node_id, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node_id WHERE w.depth < 3),
d AS (SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id)
SELECT d.node_id, kind, label, depth FROM d JOIN t USING (node_id) ORDER BY depth, kind, label, node_id LIMIT 2000""")
def tree_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.traverse(_tree(spark, sf), "n3", 3)[0].select("node_id", "kind", "label", "depth")


def _tunnels(spark: SparkSession, sf: str) -> DataFrame:
    """Nations tied by orders of one clerk day: customer's nation to the next one by key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    raw = o.select(F.concat(F.lit("n"), "c_nationkey").alias("from_node_id"), F.concat(F.lit("n"), (F.col("c_nationkey") * 7 + F.col("o_orderkey")) % 25).alias("to_node_id"))
    return graph.with_ends(raw).distinct().withColumn("tunnel_id", F.concat_ws("-", "from_node_id", "to_node_id"))


@register(f"""
WITH RECURSIVE {_TREE}, w AS (SELECT 'r1' AS node_id, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node_id WHERE w.depth < 1),
o AS (SELECT 'n' || c_nationkey AS x, 'n' || ((c_nationkey * 7 + o_orderkey) % 25) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
u AS (SELECT DISTINCT least(x, y) AS from_node_id, greatest(x, y) AS to_node_id FROM o WHERE x <> y)
SELECT from_node_id, to_node_id FROM u WHERE from_node_id IN (SELECT node_id FROM w) AND to_node_id IN (SELECT node_id FROM w)""")
def tunnels_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    return graph.traverse(_tree(spark, sf), "r1", 1, tunnels=_tunnels(spark, sf))[1].select("from_node_id", "to_node_id")


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cols = lambda name, kind, key: [F.col(name).alias("source"), F.col("n_name").alias("target"), F.lit(kind).alias("relation_type"), F.array(F.concat(F.lit(kind), key)).alias("source_chunks")]
    return c.select(*cols("c_name", "buys_in", "c_custkey")).unionByName(s.select(*cols("s_name", "sells_in", "s_suppkey")))


@register("""
WITH r AS (SELECT lower(c_name) AS a, lower(n_name) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT lower(s_name), lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT a AS name, b AS other FROM r UNION ALL SELECT b, a FROM r)
SELECT DISTINCT name, other FROM e WHERE name IN (SELECT lower(n_name) FROM nation)""")
def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return graph.neighbours(_relations(spark, sf), names)


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.lit("").alias("description"), F.array(F.concat(F.lit("n"), "n_nationkey")).alias("source_chunks"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.lit("").alias("description"), F.array(F.concat(F.lit("s"), "s_suppkey")).alias("source_chunks"))
    return n.unionByName(s)


@register("""
WITH n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY lower(n_name)) - 1 AS rank FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY lower(n_name) LIMIT 5),
b AS (SELECT *, greatest(1.0 - rank * 0.1, 0.1) AS base FROM n),
h AS (SELECT 'n' || n_nationkey AS id, base AS score FROM b
      UNION ALL SELECT 's' || s_suppkey, base * 0.8 FROM b JOIN supplier ON s_nationkey = n_nationkey
      UNION ALL SELECT 'sells_in' || s_suppkey, base * 0.8 FROM b JOIN supplier ON s_nationkey = n_nationkey
      UNION ALL SELECT 'buys_in' || c_custkey, base * 0.8 FROM b JOIN customer ON c_nationkey = n_nationkey)
SELECT id, round(max(score), 6) AS score FROM h GROUP BY id""")
def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    e = _entities(spark, sf)
    ranked = graph.term_search(e.where("entity_type = 'nation'"), "nation_1", 5)
    return retrieval.graph_scores(e, _relations(spark, sf), ranked).select("id", F.round("score", 6).alias("score"))


@register("""
WITH e AS (SELECT p_brand AS name, p_type AS d, p_partkey AS k FROM part),
f AS (SELECT lower(name) AS n, d, min(k) AS k FROM e GROUP BY 1, 2)
SELECT name, description, chunks FROM (SELECT lower(name) AS n, max_by(name, k) AS name, count(*) AS chunks FROM e GROUP BY 1) JOIN
(SELECT n, string_agg(d, '; ' ORDER BY k) AS description FROM f GROUP BY n) USING (n)""")
def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.lit("brand").alias("entity_type"), F.col("p_type").alias("description"), F.array(F.col("p_partkey").cast("string")).alias("source_chunks"), F.col("p_partkey").alias("position"))
    return graph.merge_entities(e).select("name", "description", F.size("source_chunks").cast("long").alias("chunks"))


@register("SELECT p_type AS entity_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 8")
def top_types(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_types(table(spark, sf, "part"), 8, "p_type")


# --- routing ----------------------------------------------------------------------------------------------------------------------


@register("""SELECT doc_id, CASE WHEN contains(lower(text), 'search') OR contains(lower(text), 'docs') THEN 'retrieval' WHEN contains(lower(text), 'run') OR contains(lower(text), 'execute') THEN 'execution' ELSE 'default' END AS route FROM documents""")
def route_rules(spark: SparkSession, sf: str) -> DataFrame:
    return routing.routed(table(spark, sf, "documents"), "text").select("doc_id", "route")


@register("""
WITH a AS (SELECT user_id, event_type, max((event_id % 5 = 0)::INT) AS s, max((event_id % 5 = 1)::INT) AS f FROM events WHERE value >= 50 GROUP BY ALL),
x AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT x.user_id, x.event_type, CASE WHEN x.event_type <> 'purchase' THEN 'allow' WHEN s = 1 THEN 'session' WHEN f = 1 THEN 'forever' ELSE 'deny' END AS decision FROM x LEFT JOIN a USING (user_id, event_type)""")
def approval_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("project_id"), F.col("event_type").alias("action_key"), "event_id", "user_id", "value")
    scope = F.when(F.col("event_id") % 5 == 0, "session").when(F.col("event_id") % 5 == 1, "forever").otherwise("once")
    known = e.where("value >= 50").select("project_id", "action_key", scope.alias("scope"), F.lit(True).alias("approved"))
    actions = e.select("project_id", "action_key", "user_id").distinct().withColumn("risk_level", F.when(F.col("action_key") == "purchase", "high").otherwise("low"))
    return routing.approved(actions, known).select("user_id", F.col("action_key").alias("event_type"), "decision")


@register("""
WITH l AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20),
s AS (SELECT user_id, list_sort(list(value)) AS v FROM l GROUP BY user_id) SELECT user_id, v[len(v) // 2 + 1] AS p50 FROM s""")
def p50_last20(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct(F.col("ts"), F.col("event_id")).desc()
    return routing.p50(table(spark, sf, "events"), "user_id", "value", order)


@register("""
WITH m AS (SELECT *, (event_type = 'error')::INT AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m),
s AS (SELECT event_id, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, CAST(streak AS BIGINT) AS streak, CASE streak WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 60 END AS cooldown_s FROM s""")
def cooldown_islands(spark: SparkSession, sf: str) -> DataFrame:
    out = routing.failure_runs(table(spark, sf, "events"), "user_id", F.col("event_type") == "error", F.col("ts"), F.col("event_id"))
    return out.select("event_id", F.col("streak").cast("long").alias("streak"), "cooldown_s")


@register("SELECT event_type, count(value) AS calls, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS total, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) // greatest(count(value), 1) AS BIGINT) AS average FROM events GROUP BY event_type")
def metrics_avg(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("value", F.floor("value"))
    return routing.metrics(e, "event_type", "value").select("event_type", "calls", "total", F.col("average").cast("long").alias("average"))


@register("""SELECT 'priority' AS policy, n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS turn FROM nation
UNION ALL SELECT 'latency', n_name, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS INT) FROM nation
UNION ALL SELECT 'round_robin', n_name, CAST((n_nationkey - 7 + 25) % 25 AS INT) FROM nation""")
def profile_order(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("p50"))
    one = lambda policy: routing.provider_order(n, policy, 7).select(F.lit(policy).alias("policy"), "n_name", "turn")
    return one("priority").unionByName(one("latency")).unionByName(one("round_robin"))


# --- series and JSON -----------------------------------------------------------------------------------------------------------------


@register("""
SELECT user_id AS key, epoch_ms(date_trunc('minute', ts)) AS ts_ms, arg_max(value, event_id) AS value FROM events
WHERE epoch_ms(date_trunc('minute', ts)) BETWEEN (SELECT epoch_ms(min(ts)) FROM events) AND (SELECT epoch_ms(min(ts)) + 864000000 FROM events) GROUP BY 1, 2""")
def timeseries_range(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = e.agg(F.min(t.millis("ts"))).first()[0]
    s = flows.series(e.select(F.col("user_id").alias("key"), (t.millis("ts") - t.millis("ts") % 60_000).alias("ts_ms"), "value", F.col("event_id").alias("arrival")))
    return flows.series_range(s, start, start + 864_000_000)


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'login')
SELECT user_id, event_id, n FROM x WHERE n <= 5""")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type <> 'login'").select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"))
    n = F.row_number().over(Window.partitionBy("stream").orderBy(F.col("id").desc()))
    return flows.trimmed(e, 5).select(F.col("stream").alias("user_id"), F.col("id").alias("event_id"), n.cast("long").alias("n"))


@register("""SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS INT) AS tokens, sha256(text) AS content_hash,
CASE WHEN regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'node' ELSE regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug FROM documents""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", t.byte_tokens("text").alias("tokens"), F.sha2("text", 256).alias("content_hash"), t.slug("source").alias("slug"))


@register("""
WITH o AS (SELECT 'n' || c_nationkey AS x, 'n' || ((c_nationkey * 7 + o_orderkey) % 25) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
u AS (SELECT DISTINCT least(x, y) AS from_node_id, greatest(x, y) AS to_node_id FROM o WHERE x <> y)
SELECT from_node_id, to_node_id FROM u WHERE from_node_id IN ('n1', 'n2', 'n9') OR to_node_id IN ('n1', 'n2', 'n9')""")
def tunnels_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tunnels_touching(_tunnels(spark, sf), ["n1", "n2", "n9"]).select("from_node_id", "to_node_id")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def keyed_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return state.delete(table(spark, sf, "customer").select("c_custkey"), gone, ["c_custkey"])


@register("SELECT p_partkey AS id, s_name AS installed_path, CASE WHEN s_name IS NULL THEN 'available' ELSE 'installed' END AS state FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def catalog_full_info(spark: SparkSession, sf: str) -> DataFrame:
    inv = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("binary_name"), F.col("s_name").alias("path"), F.lit("1").alias("version"))
    return catalog.full_info(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), inv).select("id", "installed_path", "state")


@register("SELECT p_partkey AS id, p_name AS name, CASE WHEN e.k IS NULL THEN 'recommended' ELSE 'enabled' END AS grouping FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linenumber = 7) e ON p_partkey = e.k WHERE list_contains(string_split(p_type, ' '), 'SMALL') AND p_brand = 'Brand#1' ORDER BY CASE WHEN e.k IS NULL THEN 0 ELSE 1 END DESC, name, id LIMIT 500")
def catalog_suggest(spark: SparkSession, sf: str) -> DataFrame:
    tools = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_type", " ").alias("languages"), F.col("p_brand").alias("type"))
    enabled = table(spark, sf, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("tool_id"))
    return catalog.suggest(tools, enabled, 500, ["SMALL"], tool_type="Brand#1").select("id", "name", "grouping")


@register("""
WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[CAST(round((len(v) - 1) * 0.5) AS INT) + 1] AS p50, v[CAST(round((len(v) - 1) * 0.95) AS INT) + 1] AS p95 FROM v""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latency(table(spark, sf, "events"), "event_type", "value")


@register("""
WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def reindex_changes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    new = d.where("path % 10 <> 4").withColumn("content", F.when(F.col("path") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return state.changes(d.where("path % 10 <> 3"), new)


@register("SELECT conv_id, turn, role, CAST(octet_length(encode(text)) AS INT) AS bytes FROM conversations WHERE role IN ('user', 'assistant') AND turn BETWEEN 1 AND 3")
def transcript_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.where(F.col("role").isin("user", "assistant") & F.col("turn").between(1, 3)).select("conv_id", "turn", "role", F.octet_length("text").alias("bytes"))


@register("""SELECT user_id AS project_id, count(*) AS entries, min(strftime(ts, '%Y-%m-%d')) AS first_date, max(strftime(ts, '%Y-%m-%d')) AS last_date FROM events GROUP BY user_id""")
def diary_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.date_format("ts", "yyyy-MM-dd").alias("entry_date"))
    return state.diary_summary(d)


@register("""
WITH l AS (SELECT user_id, max(epoch_ms(ts)) AS m FROM events GROUP BY user_id) SELECT event_id FROM events JOIN l USING (user_id) WHERE epoch_ms(ts) >= m - 604800000""")
def series_retention(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), t.millis("ts").alias("ts_ms"))
    return flows.retained(e, 7.0).select("event_id")


@register("SELECT count(DISTINCT lower(s_name)) + count(DISTINCT lower(n_name)) AS entities, (SELECT count(*) FROM (SELECT DISTINCT lower(c_name), c_nationkey FROM customer)) + (SELECT count(*) FROM (SELECT DISTINCT lower(s_name), s_nationkey FROM supplier)) AS relations FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stats(_entities(spark, sf), _relations(spark, sf))


@register()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Plain-text chunks of all documents, by the chunker in Python (tests hold it against the rules)."""
    d = table(spark, sf, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    return chunking.chunk(d).select("id", "chunk_index", "byte_length", "content_hash", "line_range")


@register()
def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical names of suppliers, parts and nations (a Python rule)."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("raw")).union(table(spark, sf, "supplier").select("s_name")).union(table(spark, sf, "nation").select("n_name"))
    return names.select("raw", t.entity_name("raw").alias("name"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_fusion(spark, sf)

