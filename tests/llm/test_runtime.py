from pyspark.sql import functions as F

from foldstore.llm import runtime


def test_working_tables_go_but_for_those_that_the_result_reads(spark):
    paths = []

    @runtime.clearing
    def operator(rows):
        first = runtime.cut(rows, "first")
        second = runtime.cut(first.withColumn("x", F.col("id") + 1), "second")
        paths.extend(runtime._made[-2:])
        return second.where("x > 2")

    out = operator(spark.range(5))
    assert [r.x for r in out.orderBy("x").collect()] == [3, 4, 5]
    assert not runtime.exists(spark, paths[0]) and runtime.exists(spark, paths[1]) and not set(paths) & set(runtime._made)


def test_passing_keeps_every_wanted_row(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    got = runtime.passing(rows, "doc_id", spark.range(0, 2000, 37).union(spark.createDataFrame([(None,)], "id long")))
    ids = [r.doc_id for r in got.collect()]
    assert set(range(0, 2000, 37)) <= set(ids) and None in ids and len(ids) < 200 and got.columns == ["doc_id", "text"]
