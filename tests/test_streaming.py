from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.sources.stores import append_log
from quillgraph.streaming import latency, sessions


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_latency_windows_of_a_log(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("t", "m", None if i % 2 else "deterministic", i, 1, 1, 1.7e9 + 600 * i) for i in range(40)]
    for part in (rows[:20], rows[20:]):
        append_log(spark.createDataFrame(part, schemas.CALL_METRICS).coalesce(1), log)
    stream = latency.windowed(latency.metrics_stream(spark, log, schemas.CALL_METRICS, 1))
    got = {(r.start, r.path): (r.n, r.total_ms) for r in drained(stream, "windows", "append").collect()}
    batch = spark.read.schema(schemas.CALL_METRICS).json(log).withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))
    want = {(r.start, r.path): (r.n, r.total_ms) for r in latency.windowed(batch).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 4  # the last windows are still open


def test_running_scores(spark, tmp_path):
    path = str(tmp_path / "a")
    for i in range(3):
        spark.createDataFrame([(1, i != 1), (2, None if i == 2 else True)], "session bigint, correct boolean").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("session bigint, correct boolean").option("maxFilesPerTrigger", 1).parquet(path)
    rows = drained(sessions.running_scores(stream), "scores", "update").collect()
    last = {s: max((r for r in rows if r.session == s), key=lambda r: r.answered) for s in (1, 2)}
    assert (last[1].answered, last[1].correct, last[1].percent) == (3, 2, 67) and (last[2].answered, last[2].correct) == (3, 2)
