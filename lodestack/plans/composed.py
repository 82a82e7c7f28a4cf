"""Registered queries over extraction with gleaning, reranking of many queries, sections of documents, pages by key and conversations taken in, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, extraction, graph, ingest, retrieval, state, storage, transcripts
from .more import _SLUG
from .queries import _FACT, _TREE, _docs, _tree, register, table
from .stores import _SPARSE, _TK, _dated, _sparse_hits


@register("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{10,}'), lambda x: lower(x)) AS k FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(k) AS name FROM w),
r AS (SELECT DISTINCT doc_id, k[i] AS name, k[i + 1] AS target FROM (SELECT doc_id, k, unnest(range(1, len(k))) AS i FROM w) WHERE k[i] <> k[i + 1])
SELECT 'entity' AS part, name, '' AS target, length(name) || ' letters' AS description, count(*) AS chunks FROM e GROUP BY name
UNION ALL SELECT 'relation', name, target, '', count(*) FROM r GROUP BY name, target""")
def extracted_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Long words of all documents as entities, half of them found by gleaning, and their neighbourhoods as relations."""
    found = extraction.mentions(_docs(spark, sf), extraction.long_words, store=storage.scratch(spark, "mentions"))
    e = extraction.entities(found).select(F.lit("entity").alias("part"), "name", F.lit("").alias("target"), "description", "chunks")
    return e.unionByName(extraction.relations(found).select(F.lit("relation").alias("part"), F.col("source").alias("name"), "target", "description", "chunks"))


@register(f"""WITH {_SPARSE},
ca AS (SELECT query_id, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({_TK.format(c='text')})) AS a FROM benchmark),
dt AS (SELECT id, unnest(list_distinct(tk)) AS b FROM d WHERE id IN (SELECT id FROM ca)),
sim AS (SELECT a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) / greatest(length(a), length(b)) AS x
  FROM (SELECT DISTINCT a FROM qt) JOIN (SELECT DISTINCT b FROM dt) ON left(a, 1) = left(b, 1)),
best AS (SELECT ca.query_id, ca.id, a, max(x) AS x FROM ca JOIN qt USING (query_id) JOIN dt USING (id) JOIN sim USING (a, b) GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
re AS (SELECT query_id, id, round(sum(x) / n, 6) AS score FROM best JOIN n USING (query_id) GROUP BY query_id, id, n)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM re QUALIFY rank <= 10""")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty best sparse hits of each benchmark item, scored again word by word against the whole texts, and the ten best of them."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.rerank_batch(_sparse_hits(spark, sf, retrieval.candidates(10)), asked, _docs(spark, sf), 10)


@register("""WITH t AS (SELECT conv_id, turn, role, 1 + turn % 3 AS lv, repeat('#', CAST(1 + turn % 3 AS INT)) || ' ' || role || chr(10) || text AS block FROM conversations),
l AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN lv END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS cur FROM t),
c AS (SELECT *, sum(coalesce(role <> 'assistant' AND lv <= cur, false)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS ended FROM l)
SELECT conv_id AS path, 'assistant' AS title, string_agg(block, chr(10) ORDER BY turn) AS section FROM c WHERE cur IS NOT NULL AND ended = 0 GROUP BY conv_id""")
def managed_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The first section of an assistant in each conversation, written as a document with a heading for each turn."""
    c = table(spark, sf, "conversations")
    block = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), "role", F.lit("\n"), "text")
    docs = c.groupBy(F.col("conv_id").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))), lambda x: x["block"]), "\n").alias("content"))
    return chunking.sections(docs, docs.select("path", F.lit("assistant").alias("title")))


@register("SELECT c_nationkey AS confidence_percent, c_mktsegment AS occurrence_count, c_name AS pattern_key FROM customer ORDER BY c_nationkey DESC, c_mktsegment DESC, c_name LIMIT 20 OFFSET 40")
def seek_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of customers as lessons, reached from cursor to cursor."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("confidence_percent"), F.col("c_mktsegment").alias("occurrence_count"), F.col("c_name").alias("pattern_key"))
    cursor = None
    for _ in range(2):
        _, cursor = state.seek(c, "lessons", 20, cursor)
    return state.seek(c, "lessons", 20, cursor)[0]


@register(f"""WITH d AS (SELECT role AS project_id, lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || turn AS entry_id, strftime(DATE '2024-01-01' + CAST(turn AS INT), '%Y-%m-%d') AS entry_date, conv_id AS updated_at, text FROM conversations),
l AS (SELECT project_id, entry_id, entry_date, updated_at, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS x FROM d),
f AS (SELECT *, {_FACT} AS fact FROM l),
k AS (SELECT project_id, entry_id, entry_date, updated_at, fact, min(pos) AS pos FROM f WHERE fact <> '' AND NOT regexp_matches(fact, '^(#|Source:|Format:|Wing:|Hall:|Room:|\\[turn:)') GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY entry_date DESC, updated_at DESC, entry_id, pos) AS n FROM k QUALIFY n <= 12),
h AS (SELECT project_id, string_agg(fact, ' | ' ORDER BY n) AS highlights FROM n GROUP BY 1),
c AS (SELECT project_id, count(*) AS entry_count, min(entry_date) AS date_from, max(entry_date) AS date_to FROM d GROUP BY 1)
SELECT project_id, entry_count, date_from, date_to, 'Summarized ' || entry_count || CASE WHEN entry_count = 1 THEN ' diary entry' ELSE ' diary entries' END || ' across the requested range.' AS summary, coalesce(highlights, '') AS highlights FROM c LEFT JOIN h USING (project_id)""")
def diary_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """Each role's turns as a diary: its range, how many entries, and the first twelve facts, latest entry first."""
    d = transcripts.diary_digest(_dated(spark, sf).withColumnRenamed("mood", "project_id"), 12)
    return d.withColumn("highlights", F.array_join("highlights", " | "))


_WORDS = """s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS path, CASE WHEN conv_id % 4 = 2 OR conv_id % 8 = 3 THEN 'Wing ' || conv_id % 5 END AS wing0, CASE WHEN conv_id % 4 >= 2 THEN 'hall ' || conv_id % 3 END AS hall,
  CASE WHEN conv_id % 2 = 1 THEN 'Room ' || conv_id % 7 END AS room FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT path, hall, room, CASE WHEN coalesce(wing0, hall, room) IS NOT NULL THEN coalesce(wing0, 'p1') END AS wing FROM s),
w AS (SELECT CAST(conv_id AS VARCHAR) AS path, CASE WHEN lower(role) IN ('system', 'user', 'assistant', 'tool') THEN lower(role) ELSE 'unknown' END AS role, turn, generate_subscripts(string_split(text, ' '), 1) AS pos, unnest(string_split(text, ' ')) AS x
  FROM (SELECT conv_id, role, turn, coalesce(text, '') AS text FROM conversations)),
m AS (SELECT path, role, x, row_number() OVER (PARTITION BY path ORDER BY turn, pos) - 1 AS i FROM w),
g AS (SELECT path, role, x, count(*) AS n, octet_length(encode(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS b FROM m WHERE regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT *, least(95, 50 + CASE WHEN b < 10 THEN 0 WHEN b < 24 THEN 5 WHEN b < 48 THEN 10 ELSE 15 END + CASE WHEN n = 2 THEN 10 WHEN n = 3 THEN 20 ELSE 30 END) AS sure,
  'aaak-' || substr(sha256(upper(role[1]) || role[2:] || ':' || x), 1, 12) AS key FROM g),
b AS (SELECT *, 'lesson-' || substr(sha256('p1:' || key), 1, 16) AS id FROM c WHERE sure >= 70 QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, x, key) <= 8),
d AS (SELECT DISTINCT wing, 'drawer:' || {w} || '-' || substr(sha256('v2:p1:drawer:' || wing), 1, 32) AS id FROM p WHERE wing IS NOT NULL),
k AS (SELECT DISTINCT p.wing, hall, 'closet:' || {h} || '-' || substr(sha256('v2:p1:closet:' || p.wing || ':' || hall), 1, 32) AS id, d.id AS up FROM p JOIN d USING (wing) WHERE hall IS NOT NULL),
r AS (SELECT DISTINCT p.wing, p.hall, room, 'room:' || {r} || '-' || substr(sha256('v2:p1:room:' || p.wing || ':' || coalesce(p.hall || ':', '') || room), 1, 32) AS id, coalesce(k.id, d.id) AS up
  FROM p JOIN d USING (wing) LEFT JOIN k ON k.wing = p.wing AND k.hall = p.hall WHERE room IS NOT NULL),
t AS (SELECT path, count(*) AS n FROM m GROUP BY 1)""".format(w=_SLUG.format(c="wing"), h=_SLUG.format(c="hall"), r=_SLUG.format(c="room"))


@register(f"""WITH {_WORDS}
SELECT 'source' AS part, path AS id, wing AS a, hall AS b, room AS c, n FROM p JOIN t USING (path)
UNION ALL SELECT 'node', id, wing, 'drawer', NULL, 0 FROM d UNION ALL SELECT 'node', id, hall, 'closet', up, 0 FROM k UNION ALL SELECT 'node', id, room, 'room', up, 0 FROM r
UNION ALL SELECT 'lesson', id, x, role, path, n FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY path DESC) = 1
UNION ALL SELECT 'chunk', path || ':' || i, '[turn:' || i || '][role:' || role || ']' || chr(10) || x, concat_ws('/', 'conversation', wing, hall, room), path, 0 FROM m JOIN p USING (path)
UNION ALL SELECT 'audit', 'memory.ingest_conversation', 'ok', '{{"project_id":"p1","path":"' || path || '","ingested_chunks":' || n || '}}', NULL, 0 FROM t""")
def ingest_records(spark: SparkSession, sf: str) -> DataFrame:
    """All rows that taking in the conversations makes, their words as messages, read from the stored tables after they were taken in twice."""
    t = table(spark, sf, "conversations")
    at = F.col("conv_id")
    text = lambda c, k: F.concat(F.lit(c), (at % k).cast("string"))
    wing, hall, room = F.when((at % 4 == 2) | (at % 8 == 3), text("Wing ", 5)), F.when(at % 4 >= 2, text("hall ", 3)), F.when(at % 2 == 1, text("Room ", 7))
    sources = t.select(at.cast("string").alias("source_path"), F.lit("claude").alias("format"), wing.alias("wing"), hall.alias("hall"), room.alias("room")).distinct()
    words = t.select(at.cast("string").alias("source_id"), F.when(F.lower("role").isin(*transcripts.ROLES), F.lower("role")).otherwise("unknown").alias("role"), "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("pos", "content"))
    turn = (F.row_number().over(Window.partitionBy("source_id").orderBy("turn", "pos")) - 1).alias("turn_index")
    found = ingest.records(words.select("source_id", "role", "content", turn), sources, "p1", 1)
    folder = storage.scratch(spark, "ingest")
    ingest.commit(found | {"audit": found["audit"].limit(0)}, folder, 8)
    kept = {k: v.read() for k, v in ingest.commit(found, folder).items()} | {"audit": spark.read.parquet(f"{folder}/audit")}
    cols = {
        "source": (kept["sources"], ["source_path", "wing", "hall", "room", "message_count"]),
        "node": (kept["nodes"], ["node_id", "label", "kind", "parent_node_id", F.lit(0)]),
        "lesson": (kept["lessons"], ["lesson_id", "canonical_text", "role", "source_transcript_path", "occurrence_count"]),
        "chunk": (kept["chunks"], ["id", "content", F.array_join("heading_hierarchy", "/"), "source_path", F.lit(0)]),
        "audit": (kept["audit"], ["operation", "outcome", "params", F.lit(None).cast("string"), F.lit(0)]),
    }
    parts = [df.select(F.lit(part).alias("part"), *[(F.col(c) if isinstance(c, str) else c).cast("long" if n == "n" else "string").alias(n) for c, n in zip(x, ["id", "a", "b", "c", "n"], strict=True)]) for part, (df, x) in cols.items()]
    return reduce(DataFrame.unionByName, parts)


@register(f"""WITH RECURSIVE {_TREE},
w AS (SELECT 'n3' AS node_id, CAST(NULL AS VARCHAR) AS back, 0 AS depth, '' AS way
  UNION ALL SELECT x.node_id, w.node_id, w.depth + 1, w.way || chr(1) || x.side || chr(1) || x.kind || chr(1) || x.label || chr(1) || x.node_id
  FROM w JOIN (SELECT t.node_id AS a, u.node_id, '0' AS side, u.kind, u.label FROM t JOIN t AS u ON u.node_id = t.parent UNION ALL SELECT parent, node_id, '1', kind, label FROM t WHERE parent IS NOT NULL) AS x
  ON x.a = w.node_id WHERE w.depth < 3 AND x.node_id IS DISTINCT FROM w.back)
SELECT row_number() OVER (ORDER BY depth, way) - 1 AS position, node_id, depth, (SELECT count(*) > 20 FROM w) AS truncated FROM w QUALIFY position < 20""")
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty places that a walk from a nation reaches within three steps, in the order of its queue, and whether there are more."""
    rows, truncated = graph.walk(_tree(spark, sf), "n3", 3, 20)
    return rows.select(F.col("position").cast("long").alias("position"), "node_id", "depth", F.lit(truncated).alias("truncated"))
