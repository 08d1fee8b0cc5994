from larkspur.operators.sessions import instant_ms, sessionise
from larkspur.streaming.recalls import append_to, recall_stream, recalls_per_hour, streamed_sessions
from pyspark.sql import functions as F

SCHEMA = "id bigint, memory_id bigint, queried_by string, query_scope string, ts string"


def events():
    rows = [(i, i % 3, "a" if i % 2 else "b", "os", f"2026-05-01T{i // 6:02}:{i % 6 * 10:02}:00Z") for i in range(60)]
    rows = [r for r in rows if r[4][11:13] not in ("03", "06")]
    return rows + rows[:7] + [(900, 1, None, "os", "2026-05-01T01:00:00Z"), (901, 1, "a", "os", "pending"), (902, 1, "a", "os", None)]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame(events(), SCHEMA)
    df.where("id < 30").coalesce(1).write.parquet(src)
    df.where("id >= 30").coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(5000, 1, "z", "os", "2026-05-02T23:00:00Z")], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    q = append_to(recall_stream(spark, src, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == df.where("ts like '2026%'").select("id").distinct().count() + 1
    for name, plan in (("s", streamed_sessions), ("h", recalls_per_hour)):
        q = plan(recall_stream(spark, src, 1)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = sessionise(df.withColumn("ms", instant_ms(F.col("ts"))), ["queried_by", "query_scope"], "id", "ms")
    assert {tuple(r) for r in spark.table("s").collect()} == {tuple(r) for r in want.collect()}
    assert spark.table("h").agg(F.sum("n")).first()[0] == got.where("id <> 5000").count()
