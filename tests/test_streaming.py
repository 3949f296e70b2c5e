from conftest import rows
from pyspark.sql import functions as F

from merloom.operators.tally import mer_tally
from merloom.streaming import tally


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 1000 * i) for i, t in enumerate(["ABCD", "BCDE", "", None, "ABCD"])], "ord bigint, seq string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = tally.running_tally(stream, 3).writeStream.format("memory").queryName("mers").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("mers")) == rows(mer_tally(df, 3))
    assert rows(tally.windowed_tally(df, 3, "at").groupBy("mer").agg(F.sum("cnt").alias("cnt"))) == rows(mer_tally(df, 3))
