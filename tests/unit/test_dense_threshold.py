from lodestack.plans import queries


def test_all_rows_that_reach_the_threshold(spark, tmp_path):
    rows = [(i, [1.0, i / 1000], 0) for i in range(1500)] + [(2000, [-1.0, 0.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r.id for r in queries.dense_threshold(spark, str(tmp_path)).collect()]
    assert len(got) == 1500 and got[0] == 0 and 2000 not in got
