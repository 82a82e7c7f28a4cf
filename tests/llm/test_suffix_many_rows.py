from pyspark.sql import functions as F

from lodestack.llm import suffix_dedup as sd


def test_more_rows_of_an_id_than_two_bytes_number(spark):
    passage = "a passage that stands in a document of a smaller id and is long enough to go"
    many = spark.range(1 << 16).select(F.lit(2).cast("long").alias("doc_id"), F.format_string("%06d", "id").alias("text"))
    docs = many.union(spark.createDataFrame([(1, passage), (2, "~" + passage)], "doc_id long, text string"))
    got = sd.dedup(docs).where("n_bytes > 6").collect()
    assert {(r.doc_id, bytes(r.kept).decode()) for r in got} == {(1, passage), (2, "~")}
