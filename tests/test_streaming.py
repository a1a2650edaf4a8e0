from millrace.operators import curves
from millrace.streaming import eventlog
from pyspark.sql import functions as F


def _stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def test_failure_guard(spark, tmp_path, sf_dir):
    events, stream = _stream(spark, tmp_path, sf_dir)
    query = eventlog.failure_guard(stream).writeStream.format("memory").queryName("guard").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {r["user_id"]: (r["n_failed"], r["longest"]) for r in spark.table("guard").collect()}
    want = {r["user_id"]: (r["n_failed"], r["longest"]) for r in curves.streaks(events, "user_id", "event_id", F.col("event_type") == "error").collect()}
    assert got == want


def test_windowed(spark, tmp_path, sf_dir):
    events, stream = _stream(spark, tmp_path, sf_dir)
    query = eventlog.windowed(stream, "1 day", "1 hour").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()


def test_aborts_as_in_the_batch_form(spark, tmp_path, sf_dir):
    """The stream is fed in four batches; each key's state goes on from one to the next."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    bounds = [*events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0), float("inf")]
    low = float("-inf")
    for high in bounds:
        events.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        low = high
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = eventlog.aborts(stream, "error", 3, 5).writeStream.format("memory").queryName("aborts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        query.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.table("aborts").collect())
    want = sorted(tuple(r) for r in curves.abort_points(events, "user_id", "event_id", F.col("event_type") == "error", 3, 5).collect())
    assert got == want and len(want) > 3
