from pyspark.sql import functions as F

from covaria.streaming.moments import running_moments


def test_stream_equals_batch(spark, tmp_path):
    ddl = "ts timestamp, slide string, cell_type string, gene string, value double"
    rows = spark.range(400).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.concat(F.lit("s"), F.col("id") % 2).alias("slide"), F.lit("T").alias("cell_type"), F.concat(F.lit("g"), F.col("id") % 3).alias("gene"), F.col("id").cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running_moments(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    job = stream.writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert sorted(map(tuple, spark.table("moments").collect())) == sorted(map(tuple, running_moments(rows).collect()))
