import math

from lodestack.operators import retrieval
from lodestack.plans.queries import recall_mrr

K = 10


def test_every_vector_is_a_query(spark, tmp_path):
    rows = [(i, [math.sin(3 * i), math.cos(7 * i), math.sin(i * i)], i % 4) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    stored = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()]

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b), 6)

    first = []
    for i, v, label in stored:
        best = sorted(((-cosine(v, w), j, other) for j, w, other in stored if j != i))[:K]
        first.append(next((n for n, (_, _, other) in enumerate(best, 1) if other == label), None))
    got = recall_mrr(spark, str(tmp_path)).first()
    assert got.queries == len(rows)
    assert got.recall_1 == round(sum(r == 1 for r in first) / len(rows), 6)
    assert got.recall_5 == round(sum(r is not None and r <= 5 for r in first) / len(rows), 6)
    assert got.mrr == round(sum(1 / r for r in first if r) / len(rows), 6)


def test_rounds_of_queries_give_the_same_rows(spark):
    v = spark.createDataFrame([(i, [math.sin(3 * i), math.cos(7 * i), math.sin(i * i)]) for i in range(60)], "id long, vector array<double>").repartition(5)
    q = v.withColumnRenamed("id", "query_id")
    one, many = (sorted(map(tuple, retrieval.dense_batch(v, q, 4, most=m).select("query_id", "id", "score", "rank").collect())) for m in (100, 7))
    assert one == many and len(one) == 240
