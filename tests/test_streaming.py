from pyspark.sql import functions as F

from lamina.operators import group_sum
from lamina.streaming import stream_group_sum


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_group_sum(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(spark.table("sums")) == key(group_sum(df, "k", "v"))
