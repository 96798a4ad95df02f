"""Containment over all documents, timed state, sketches, discovery, contracts."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import containment
from quillgraph.sources import contracts, frontier
from quillgraph.streaming import live_sessions, sketches


def test_containment_equals_brute_force(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 5))) for _ in range(80)]
    sets = [rnd.sample(words, rnd.randint(1, 40)) for _ in range(120)]
    sets += [s[: max(1, len(s) * 9 // 10)] for s in sets[:40]] + [list(reversed(s)) for s in sets[:10]] + [sets[3]] * 30
    rows = [(i, " ".join(s)) for i, s in enumerate(sets)] + [(900, None), (901, ""), (None, sets[0][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    stop = set(spark.range(1).select(F.lit(1)).columns)  # no word above is a stop word
    whole = {i: frozenset(w for w in (t or "").split() if w not in stop) for i, t in rows if i is not None}
    for percent, least in ((80, 5), (100, 3), (50, 1)):
        members = containment.classes(docs, "doc_id", "text", least)
        got = {r.id: r.class_id for r in members.collect()}
        want = {i: min(k for k, s in whole.items() if s == whole[i]) for i in whole if len(whole[i]) >= least}
        assert got == want
        reps = containment.representatives(members)
        links = containment.linked(reps, percent)
        keys = sorted(set(want.values()))
        pairs = {(a, b) for a in keys for b in keys if (len(whole[a]), a) < (len(whole[b]), b) and 100 * len(whole[a] & whole[b]) >= percent * len(whole[a])}
        assert {(r.small, r.large) for r in links.collect()} == pairs
        met = [tuple(r) for r in containment.candidates(reps, percent).collect()]
        assert len(met) == len(set(met)) and pairs <= set(met)
        if percent == 80:
            assert len(met) < len(keys) * (len(keys) - 1) / 4
        counts = {r.id: r.n_links for r in containment.overview(members, links).collect()}
        assert counts == {i: sum(c in p for p in pairs) for i, c in want.items()}


def answers(spark, rows):
    return spark.createDataFrame([(s, t, topic, ok, ts) for s, t, topic, ok, ts in rows], "session long, turn int, topic string, correct boolean, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000)).drop("at").coalesce(1)


def test_sessions_close_by_timer_and_go_on_after_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "session bigint, turn int, topic string, correct boolean, ts timestamp"

    def run():
        stream = live_sessions.closed_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "30 minutes")
        with live_sessions.with_rocksdb(spark):
            q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination(200)
        return sorted(tuple(r) for r in spark.read.schema(live_sessions.OUT).parquet(out).collect())

    before = spark.conf.get(live_sessions.PROVIDER, None)
    answers(spark, [(1, 0, "a", True, 0), (1, 1, "b", False, 60), (2, 0, None, None, 100), (3, 0, "x", False, 4000)]).write.parquet(src)
    assert run() == [(1, 2, 1, 50, "b"), (2, 1, 0, 0, "")]
    answers(spark, [(3, 1, "y", False, 4100), (3, 2, "y", False, 4200), (3, 3, "x", True, 4300)]).write.mode("append").parquet(src)
    answers(spark, [(4, 0, "z", True, 20000)]).write.mode("append").parquet(src)
    assert run() == [(1, 2, 1, 50, "b"), (2, 1, 0, 0, ""), (3, 4, 1, 25, "y, x")]  # the state of session 3 came through the restart
    assert run() == [(1, 2, 1, 50, "b"), (2, 1, 0, 0, ""), (3, 4, 1, 25, "y, x")]
    assert spark.conf.get(live_sessions.PROVIDER, None) == before


def test_merged_sketches_are_near_the_exact_percentile(spark):
    rows = spark.range(60_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("ts"), F.concat(F.lit("t"), F.col("id") % 3).alias("task"), F.when(F.col("id") % 2 == 0, "p").alias("path"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("latency_ms"))
    windows = sketches.sketched(rows)
    assert windows.count() > 300
    got = {(r.level, r.label): r for r in sketches.merged(windows).withColumns({"a": sketches.quantile(F.col("sketch"), 0.5), "b": sketches.quantile(F.col("sketch"), 0.95)}).collect()}
    assert {k[0] for k in got} == {"day", "task", "path"} and got["path", "generative"].n == 30_000 and sum(r.n for k, r in got.items() if k[0] == "day") == 60_000
    for r in got.values():
        assert abs(r.a / 10_000 - 0.5) < sketches.RANK_ERROR + 0.02 and abs(r.b / 10_000 - 0.95) < sketches.RANK_ERROR + 0.02


def test_reached(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (5, 6), (4, None), (None, 7), (4, 4), (1, 2)]
    links = spark.createDataFrame(edges, "src long, dst long")
    seeds = spark.createDataFrame([(1,), (9,), (1,), (None,)], "node long")
    assert {r.node: r.depth for r in frontier.reached(links, seeds).collect()} == {1: 0, 9: 0, 2: 1, 4: 1, 3: 2}
    assert {r.node: r.depth for r in frontier.reached(links, seeds, 1).collect()} == {1: 0, 9: 0, 2: 1, 4: 1}
    assert frontier.reached(links, seeds.where("node = 77")).count() == 0


def test_contract(spark):
    rows = ['{"a": 1, "b": "x"}', '{"a": "1"}', '{"a": null}', "{", None, "7", '{"a": 11, "b": "z", "c": 2}', '{"a": 2, "c": 1.5}', '{"a": 2, "c": true}', '{"a": 2.5}']
    df = spark.createDataFrame(list(enumerate(rows)), "id int, j string")
    fields = [contracts.Field("a", "$.a", "bigint", most=10), contracts.Field("b", "$.b", "string", required=False, among=("x", "y")), contracts.Field("c", "$.c", "double", required=False)]
    out = contracts.checked(df, "j", fields)
    assert {r.id: (r.a, r.b, r.c) for r in contracts.good(out).collect()} == {0: (1, "x", None), 7: (2, None, 1.5)}
    bad = {}
    for r in contracts.quarantined(out, "id").collect():
        bad.setdefault(r.id, set()).add(r.reason)
    assert bad == {1: {"a: not bigint"}, 2: {"a: missing"}, 3: {"j: not JSON"}, 4: {"j: null"}, 5: {"j: not an object"}, 6: {"a: above 10", "b: not listed"}, 8: {"c: not double"}, 9: {"a: not bigint"}}


@pytest.mark.parametrize("size", [1, 3, 10, 37, 200])
@pytest.mark.parametrize("percent", [50, 70, 80, 100])
def test_prefixes_are_never_longer_than_the_set(spark, size, percent):
    looked_up, shared = containment.prefix(F.lit(size), percent)
    r = spark.range(1).select(looked_up.alias("p"), shared.alias("s"), containment.required(F.lit(size), percent).alias("n")).first()
    assert 1 <= r.s <= r.p <= size and size - r.p + r.s == r.n


def test_containment_over_many_blocks_makes_no_rows_of_chance_meetings(spark, monkeypatch):
    """Every pair of these sets shares words; only those that link may become rows."""
    monkeypatch.setattr(containment, "LEAST_BLOCK", 200)
    monkeypatch.setattr(containment, "AT_ONCE", 50)
    rnd = random.Random(8)
    words = ["".join(rnd.choice("bcdfgh") for _ in range(4)) for _ in range(60)]
    sets = [rnd.sample(words, rnd.randint(5, 40)) for _ in range(150)] + [rnd.sample(words[:12], rnd.randint(5, 10)) for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string")
    reps = containment.representatives(containment.classes(docs, "doc_id", "text", 5))
    whole = {r.class_id: frozenset(r.set) for r in reps.collect()}
    want = {(a, b, len(whole[a] & whole[b])) for a in whole for b in whole if (len(whole[a]), a) < (len(whole[b]), b) and 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a])}
    links = containment.linked(reps)
    assert {(r.small, r.large, r.shared) for r in links.collect()} == want and len(want) > 20
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan  # meetings are counted where they are found


def test_sets_move_once_however_many_blocks(spark, monkeypatch):
    """a set was dealt out once for each other block, so what moved grew with the square of the input."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(4)
    words = ["".join(rnd.choice("bcdfgh") for _ in range(4)) for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rnd.sample(words, rnd.randint(5, 15)))) for i in range(120)], "doc_id long, text string")
    reps = containment.representatives(containment.classes(docs, "doc_id", "text", 5))
    found = []
    for block in (1 << 24, 200):
        monkeypatch.setattr(containment, "MOST", block)
        links = containment.linked(reps, 60)
        plan = links._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan and "shuffle_replicate_nl" in plan
        found.append(sorted(tuple(r) for r in links.collect()))
    monkeypatch.undo()
    assert found[0] and found[0] == found[1]

    numbers = [[3, 4, 900], [], [7], [1, 2]]
    table = pa.table({"block": pa.array([2] * 4, pa.int32()), "class_id": ["a", "b", "c", "d"], "numbers": pa.array(numbers, pa.list_(pa.int32()))})
    packed = containment._packed(table)
    assert packed["block"].to_pylist() == [2]
    back = containment._unpacked(packed["sets"][0], True)
    assert back["numbers"].to_pylist() == numbers and back["class_id"].to_pylist() == ["a", "b", "c", "d"] and back["second"].to_pylist() == [True] * 4 and np.array_equal(back["n"], [3, 0, 1, 2])
