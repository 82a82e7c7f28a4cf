"""Registered queries over stored tables and indexes, which each query builds in the shared folder from its whole tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ann, chunking, fts_index, modes, retrieval, sparse, storage, websearch
from ..streaming import flows, watch
from .queries import _docs, _vectors, register, table

_TK = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25(rows: str, terms: list[str], k: int, every: bool = True) -> str:
    """SQL for BM25 of the terms over rows (id, tk)."""
    n = range(len(terms))
    f = ", ".join(f"len(list_filter(tk, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    d = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in n)
    score = " + ".join(f"f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / a)) * ln(1 + (c - d{i} + 0.5) / (d{i} + 0.5))" for i in n)
    held = (" AND " if every else " OR ").join(f"f{i} > 0" for i in n)
    return f"WITH d AS ({rows}), f AS (SELECT id, len(tk) AS n, {f} FROM d), s AS (SELECT count(*) AS c, avg(n) AS a, {d} FROM f) SELECT id, round({score}, 6) AS score FROM f, s WHERE {held} ORDER BY score DESC, id LIMIT {k}"


# --- stored full-text index --------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf: str) -> fts_index.Index:
    return fts_index.Index.create(_docs(spark, sf).select("id", "content"), storage.scratch(spark, "fts"))


@register(_bm25(f"SELECT doc_id AS id, {_TK.format(c='text')} AS tk FROM documents", ["of", "with"], 25))
def fts_indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of bm25_topk from a stored index, of which the two terms' buckets and the blocks that can matter are read."""
    return _index(spark, sf).search("with of", 25, digits=6).select("id", "score")


_CHANGED = "CASE WHEN lang = 'fr' THEN text || ' of the of' ELSE text END"


@register(_bm25(f"SELECT doc_id AS id, {_TK.format(c=_CHANGED)} AS tk FROM documents WHERE lang IS DISTINCT FROM 'de'", ["of", "the"], 40, False))
def fts_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all documents after a change in which the German ones go and the French ones get another text."""
    index, d = _index(spark, sf), _docs(spark, sf)
    index.change(d.where("lang = 'fr'").select("id", F.concat("content", F.lit(" of the of")).alias("content")), d.where("lang = 'de'").select("id"))
    return index.search("the of", 40, every=False, digits=6).select("id", "score")


@register(f"WITH d AS (SELECT doc_id AS id, {_TK.format(c='text')} AS tk FROM documents), p AS (SELECT id, len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'of' AND tk[i + 1] = 'the')) AS n FROM d) SELECT id, CAST(n AS INT) AS places FROM p WHERE n > 0")
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the two words in a row, from positions."""
    return _index(spark, sf).phrase("of the")


# --- approximate vector index ------------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _lists(spark: SparkSession, sf: str) -> ann.Lists:
    return ann.Lists.ensure(_vectors(spark, sf).select("id", "vector"), storage.scratch(spark, "ann"), target=0.98)


@register()
def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of each vector whose id is divisible by 50, from the lists that it probes."""
    return _lists(spark, sf).search(_asked(spark, sf), 10)


@register("SELECT count(*) AS queries, 10 AS k, true AS reached FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index finds nine tenths of the true ten neighbours of those vectors; the measured share is in ann_measured."""
    return ann_measured(spark, sf).select("queries", F.lit(10).alias("k"), (F.col("recall") >= 0.9).alias("reached"))


@register()
def ann_measured(spark: SparkSession, sf: str) -> DataFrame:
    """The recall itself, and how many of the lists a query probes."""
    index, asked = _lists(spark, sf), _asked(spark, sf)
    measured = ann.recall(index.search(asked, 10), retrieval.dense_batch(_vectors(spark, sf), asked, 10))
    return measured.select("queries", "recall", F.lit(index.note["probe"]).alias("probe"), F.lit(len(index.centroids)).alias("lists"))


# --- sparse vectors ----------------------------------------------------------------------------------------------------------

_SPARSE = f"""d AS (SELECT doc_id AS id, {_TK.format(c='text')} AS tk FROM documents),
a AS (SELECT count(*) AS c, avg(len(tk)) AS a FROM d),
f AS (SELECT id, n, t, count(*) AS tf FROM (SELECT id, len(tk) AS n, unnest(tk) AS t FROM d) GROUP BY id, n, t),
i AS (SELECT t, ln(1 + (c - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, a GROUP BY t, c),
q AS (SELECT item_id AS query_id, t, idf FROM (SELECT item_id, unnest(list_distinct({_TK.format(c='text')})) AS t FROM benchmark) JOIN i USING (t)),
s AS (SELECT query_id, id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a)) * idf), 6) AS score FROM f JOIN q USING (t), a GROUP BY query_id, id)"""


def _sparse_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    docs, tokens = _docs(spark, sf), t.fts_tokens("content")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    asked = sparse.queries(items, tokens, sparse.inverse_of(docs, tokens, sparse.dimensions(items, tokens)))
    return sparse.scan(docs, tokens, asked, k)


@register(f"WITH {_SPARSE} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10")
def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For each benchmark item the ten documents with the largest dot product of sparse vectors."""
    return _sparse_hits(spark, sf, 10)


@register(f"""WITH {_SPARSE},
sp AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
v AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
de AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, vec_id) <= 20),
b AS (SELECT coalesce(de.query_id, sp.query_id) AS query_id, coalesce(de.id, sp.id) AS id, round(coalesce(de.score, 0) * 0.7 + coalesce(sp.score / (sp.score + 5.0), 0) * 0.3, 9) AS score
  FROM (SELECT * FROM de WHERE score >= 0.2) de FULL JOIN sp ON de.query_id = sp.query_id AND de.id = sp.id)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM b QUALIFY rank <= 15""")
def hybrid_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and sparse hits of each benchmark item, whose vector is that of its number, fused."""
    v = _vectors(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(v.select(F.col("id").alias("query_id"), "vector"), "query_id")
    return sparse.pair(retrieval.dense_batch(v, asked, 20), _sparse_hits(spark, sf, 20), 15, 0.2, digits=9)


# --- bucketed table ----------------------------------------------------------------------------------------------------------


@register("""WITH o AS (SELECT o_custkey AS id, max(o_orderkey) AS last FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(last, 0) AS updated_at, c_nationkey AS nation, CASE WHEN last IS NULL THEN c_mktsegment ELSE o_orderpriority END AS value
FROM customer LEFT JOIN o ON id = c_custkey LEFT JOIN orders ON o_orderkey = last WHERE c_nationkey <> 7""")
def stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in a bucketed table after an upsert from their orders, of which the last counts, and a delete by nation."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    nation = F.col("c_nationkey").cast("int").alias("nation")
    rows = c.select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("updated_at"), nation, F.col("c_mktsegment").alias("value"))
    stored = storage.Stored.create(rows, storage.scratch(spark, "customers"), ["id"])
    changes = o.join(c.select("c_custkey", nation), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("long").alias("updated_at"), F.lit(-1).alias("nation"), F.col("o_orderpriority").alias("value"))
    stored.upsert(changes, keep_first=["nation"])
    stored.delete(c.where("c_nationkey = 7").select(F.col("c_custkey").alias("id")))
    return stored.read()


# --- search boxes, tombstones, watched files ---------------------------------------------------------------------------------

_DIARY = """SELECT lpad(CAST(conv_id AS VARCHAR), 9, '0') || '-' || turn AS entry_id, strftime(DATE '2024-01-01' + CAST(turn AS INT), '%Y-%m-%d') AS entry_date, conv_id AS updated_at, text AS content FROM conversations"""


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as diary entries: a day for each turn number."""
    c = table(spark, sf, "conversations")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")), "yyyy-MM-dd")
    return c.select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), "turn").alias("entry_id"), day.alias("entry_date"), F.col("conv_id").alias("updated_at"), F.col("role").alias("mood"), F.array("role").alias("tags"), F.col("text").alias("content"))


def _places(term: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len(list_filter(tk, lambda x: x = '{term}')) + 1), lambda j: 1.0 / (j * j))), 0)"


@register(f"""WITH d AS ({_DIARY}), k AS (SELECT *, {_TK.format(c='content')} AS tk FROM d WHERE entry_date >= '2024-01-02' AND entry_date <= '2024-01-04')
SELECT entry_id, round(({' + '.join(_places(w) for w in ('la', 'of', 'que', 'the'))}) * 0.6 / (pi() * pi()) / 4, 6) AS rank FROM k
WHERE (len(list_filter(range(1, len(tk)), lambda i: tk[i] = 'of' AND tk[i + 1] = 'the')) > 0 AND NOT list_contains(tk, 'is')) OR (list_contains(tk, 'que') AND list_contains(tk, 'la'))""")
def diary_websearch(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of three days with a phrase and without a word, or with two words."""
    return websearch.search(_dated(spark, sf), '"of the" -is OR que la', "2024-01-02", "2024-01-04", digits=6).select("entry_id", "rank")


@register("""SELECT c_custkey AS path, CASE WHEN c_acctbal < 0 THEN 1 WHEN c_nationkey < 12 THEN 2 ELSE 1 END AS version FROM customer WHERE NOT (c_nationkey >= 5 AND c_acctbal < 0)""")
def late_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Removals at version 3, then late upserts at version 2 over version 1: what was removed does not come back."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), "c_nationkey", "c_acctbal")
    base = c.select("path", F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    gone = c.where("c_nationkey >= 5 and c_acctbal < 0").select("path", F.lit(3).alias("version"), F.lit("remove").alias("op"))
    late = c.where("c_nationkey < 12 and (c_acctbal >= 0 or c_nationkey >= 5)").select("path", F.lit(2).alias("version"), F.lit("upsert").alias("op"))
    return flows.present(flows.apply_changes(flows.apply_changes(base, gone), late))


@register("""WITH p AS (SELECT 'note' || page_id || '.md' AS path, page_id, row_number() OVER () AS n FROM pages)
SELECT path AS source_path, CASE WHEN page_id % 2 = 0 THEN 'first' ELSE 'second' END AS content FROM p WHERE page_id % 5 <> 0""")
def watched_rechunk(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk table after two settled batches: every note written, then the odd ones again and every fifth removed."""
    p = table(spark, sf, "pages").select(F.concat(F.lit("note"), F.col("page_id"), F.lit(".md")).alias("path"), "page_id")
    none = chunking.chunk(p.select("path", F.lit("x").alias("content"))).where("false")
    chunks = storage.Stored.create(none, storage.scratch(spark, "chunks"), ["source_path"], 16)
    watch.rechunk(p.select("path", F.lit("upsert").alias("op")), chunks, lambda paths: paths.withColumn("content", F.lit("first")))
    second = p.where("page_id % 2 = 1 or page_id % 5 = 0").select("path", F.when(F.col("page_id") % 5 == 0, "remove").otherwise("upsert").alias("op"))
    watch.rechunk(second, chunks, lambda paths: paths.withColumn("content", F.lit("second")))
    return chunks.read().select("source_path", "content")


# --- hybrid mode -------------------------------------------------------------------------------------------------------------


@register("""
WITH q AS (SELECT n_nationkey AS query_id, lower(n_name) AS w, embedding::DOUBLE[] AS v FROM nation LEFT JOIN embeddings ON vec_id = n_nationkey),
e AS (SELECT lower(n_name) AS name, n_nationkey AS chunk FROM nation UNION ALL SELECT lower(s_name), 100 + s_suppkey FROM supplier),
r AS (SELECT lower(s_name) AS a, lower(n_name) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT query_id, name, greatest(1.0 - 0.1 * (row_number() OVER (PARTITION BY query_id ORDER BY (name <> w)::INT, name) - 1), 0.1) AS base FROM q, (SELECT DISTINCT name FROM e) WHERE contains(name, w) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (name <> w)::INT, name) <= 10),
s AS (SELECT a AS name, b AS other FROM r UNION SELECT b, a FROM r),
t AS (SELECT * FROM b UNION ALL SELECT query_id, other, base * 0.8 FROM b JOIN s USING (name)),
sim AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 9) DESC, vec_id) AS rank FROM q, embeddings WHERE v IS NOT NULL),
p AS (SELECT query_id, s_suppkey, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM q, supplier JOIN embeddings ON vec_id = 100 + s_suppkey WHERE v IS NOT NULL),
p5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s_suppkey) - 1 AS rank FROM p QUALIFY rank < 5),
h AS (SELECT query_id, chunk AS id, base AS score FROM t JOIN e USING (name) UNION ALL SELECT query_id, 100 + s_suppkey, score * greatest(1.0 - 0.1 * rank, 0.1) FROM p5 WHERE score >= 0),
m AS (SELECT query_id, id, round(max(score), 9) AS score FROM h GROUP BY ALL),
g AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
d AS (SELECT * FROM sim WHERE rank <= 20 AND score >= 0.1),
f AS (SELECT coalesce(d.query_id, g.query_id) AS query_id, coalesce(d.id, g.id) AS id, round(CASE WHEN d.score IS NULL THEN g.score WHEN g.score IS NULL THEN d.score ELSE d.score + 0.3 * g.score END, 12) AS score,
  CASE WHEN g.score IS NULL THEN 'dense' WHEN d.score IS NULL THEN 'graph' ELSE 'both' END AS legs FROM d FULL JOIN g ON d.query_id = g.query_id AND d.id = g.id)
SELECT query_id, id, score, legs, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation asked by its name and the vector of its number: vectors are the chunks, nations and suppliers the graph, suppliers' vectors the semantic leg."""
    n, s, v = table(spark, sf, "nation"), table(spark, sf, "supplier"), _vectors(spark, sf).select("id", "vector")
    asked = n.join(v, F.col("n_nationkey") == F.col("id"), "left").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("text"), "vector")
    chunk = (F.lit(100) + F.col("s_suppkey")).cast("long")
    entities = n.select(F.col("n_name").alias("name"), F.array(F.col("n_nationkey").cast("long")).alias("source_chunks")).unionByName(s.select(F.col("s_name").alias("name"), F.array(chunk).alias("source_chunks")))
    relations = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"))
    points = s.select(chunk.alias("chunk"), F.col("s_suppkey").cast("long").alias("supplier")).join(v, F.col("chunk") == F.col("id")).select(F.col("supplier").alias("id"), "vector", F.array("chunk").alias("source_chunks"))
    return modes.hybrid(asked, v, entities, relations, 10, entity_points=points, threshold=0.1, digits=12)
