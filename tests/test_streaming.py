from pyspark.sql import functions as F

from screenloom.streaming.incremental import pending, process_new


def test_new_files_are_taken_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    spark.range(5).write.parquet(src)
    double = lambda df: df.select((F.col("id") * 2).alias("v"))
    schema = spark.read.parquet(src).schema
    process_new(spark, src, schema, double, out, chk)
    process_new(spark, src, schema, double, out, chk)
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 7).write.mode("append").parquet(src)
    process_new(spark, src, schema, double, out, chk)
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8, 10, 12]


def test_pending(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    assert [r.k for r in pending(a, b, "k").orderBy("k").collect()] == [3, 4] and pending(a, b, "k", force=True).count() == 5
