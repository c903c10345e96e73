"""Streams run to their end over a folder of rows."""

from pyspark.sql import functions as F

from tamiz.streaming import incremental


def test_streams(spark, tmp_path):
    rows = [(1, "hola mundo", "2026-01-01 00:00:00"), (2, "hola mundo", "2026-01-01 00:01:00"), (3, "te voy a matar", "2026-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "id int, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("once", incremental.without_copies(stream, "ts")), ("labelled", incremental.classified(stream))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == 2
    assert {r["id"]: r["tiene_violencia"] for r in spark.table("labelled").collect()} == {1: "false", 2: "false", 3: "true"}
