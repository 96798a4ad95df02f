"""Quiz sessions as keyed state with timers: a session that has been quiet for ``gap`` is closed and scored.

The state of a session is its counters and, by topic, the misses with the turn of the first.
Each batch of answers moves the session's one event-time timer; when the watermark passes it,
the score is sent and the state goes, so state is bounded by the sessions that are open. The
state store must be RocksDB (``with_rocksdb``). An answer that comes after its session was
closed opens a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session bigint, answered bigint, correct bigint, percent int, weak string"
TOPICS = 3


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The setting that streams started inside need; the caller's own comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Quiz(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "answered bigint, correct bigint, last_ms bigint")
        self.misses = handle.getMapState("misses", "topic string", "times bigint, first bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        answered, correct, last = self.score.get() if self.score.exists() else (0, 0, None)
        if last is not None:
            self.handle.deleteTimer(last + self.gap_ms)
        for r in rows:
            answered, last = answered + 1, max(r.ms, last or r.ms)
            if r.correct:
                correct += 1
                continue
            topic = (r.topic or "",)
            times, first = self.misses.getValue(topic) if self.misses.containsKey(topic) else (0, r.turn)
            self.misses.updateValue(topic, (times + 1, min(first, r.turn)))
        self.score.update((answered, correct, last))
        self.handle.registerTimer(last + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        answered, correct, _ = self.score.get()
        weak = sorted((-value[0], value[1], topic[0]) for topic, value in self.misses.iterator())[:TOPICS]
        self.score.clear()
        self.misses.clear()
        yield Row(session=key[0], answered=answered, correct=correct, percent=(200 * correct + answered) // (2 * answered), weak=", ".join(topic for _, _, topic in weak))

    def close(self) -> None:
        pass


def closed_sessions(answers: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row a session once it is closed, of a stream of answers (session, turn, topic, correct, ts)."""
    gap_ms = answers.sparkSession.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {gap})").first()[0]
    rows = answers.withWatermark("ts", late).select(F.col("session").cast("bigint").alias("session"), F.col("turn").cast("bigint").alias("turn"), "topic", F.coalesce("correct", F.lit(False)).alias("correct"), "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("session").transformWithState(statefulProcessor=Quiz(gap_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")
