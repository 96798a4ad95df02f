"""The inverted file against exact search."""

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import vector_index, vectors
from quillgraph.operators.vector_index import VectorIndex, recall


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


def test_recall_and_exact_mode(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 200)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    x[300:700] = x[300]  # a crowd of equal vectors
    v = table(spark, x)
    odd = spark.createDataFrame([(9000, None), (9001, []), (9002, [1.0] * 3), (9003, [float("nan")] * 16), (9004, [0.0] * 16)], "id long, embedding array<double>")
    index = VectorIndex.built(v.unionByName(odd), str(tmp_path / "v")).calibrated(0.95)
    assert index.blocks.select(F.explode("ids")).count() == 1501
    assert index.blocks.where("size(ids) > 400").count() == 0  # a crowded list lies in several blocks
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = index.search(q, 8, exact=True, exclude_self=True)
    want = vectors.batch_search(v.unionByName(odd.where("id = 9004")), q, 8, exclude_self=True)
    as_set = lambda df: {(r.query_id, r.id, r["rank"], round(r.similarity, 5)) for r in df.collect()}
    assert as_set(exact) == as_set(want)
    crowd = [20 * i for i in range(15, 35)]  # their nearest are ties beyond number: any of the crowd is right
    found = index.search(q, 8, exclude_self=True)
    assert recall(found, exact).where(~F.col("query_id").isin(crowd)).agg(F.avg("recall")).first()[0] >= 0.9
    assert all(abs(r.similarity - 1) < 1e-6 for r in found.where(F.col("query_id").isin(crowd)).collect())
    assert 1 <= index.probes <= len(index.quantizer.centroids)


def test_codes_are_read_before_vectors(spark, tmp_path):
    index = VectorIndex.built(table(spark, np.random.default_rng(1).normal(size=(100, 8))), str(tmp_path / "v"))
    plan = index.search(table(spark, np.eye(8)[:2]).withColumnRenamed("id", "query_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<list:int,block:bigint,ids:array<bigint>,codes:binary>" in plan


def test_empty_index(spark, tmp_path):
    index = VectorIndex.built(spark.createDataFrame([], "id long, embedding array<double>"), str(tmp_path / "v"))
    q = table(spark, np.eye(4)).withColumnRenamed("id", "query_id")
    assert index.calibrated().search(q, 3).count() == 0


def test_ties_and_blocks_of_an_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "HELD", 1)
    x = np.repeat(np.eye(4), 20, axis=0)
    got = vectors.batch_search(table(spark, x).repartition(3), table(spark, np.eye(4)).withColumnRenamed("id", "query_id"), 5).collect()
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(i, n + 1, 20 * i + n) for i in range(4) for n in range(5)}


def most_returned(df):
    """Most rows that a Python step of the plan returned."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        metric = p.metrics().get("pythonNumRowsReceived")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = p.children().iterator()
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else []
        while children.hasNext():
            todo.append(children.next())
    return most


def test_a_search_sends_only_what_can_be_among_the_best(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 8))
    index = VectorIndex.built(table(spark, x), str(tmp_path / "v"), lists=12)
    q = table(spark, x[::20]).withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in df.collect())
    found = index.search(q, 5, probes=9, rerank=20)
    assert 0 < most_returned(found) <= 30 * 20  # not that many from each of nine lists
    want = key(found)
    assert len(want) == 30 * 5
    for name, n in (("ASKED", 7), ("LEAST_ASKED", 7), ("CODED", 90), ("PAIRS", 100)):
        monkeypatch.setattr(vector_index, name, n)
    for name, n in (("QUERY_BLOCK", 4), ("VECTOR_BLOCK", 30), ("HELD", 2), ("STRIPE", 2)):
        monkeypatch.setattr(vectors, name, n)
    assert key(index.search(q, 5, probes=9, rerank=20)) == want  # many small cells


def test_groups_of_queries_meet_all_stripes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(vectors, "HELD", 2)
    x = np.random.default_rng(5).normal(size=(200, 6))
    v = table(spark, x).withColumn("subject", F.col("id") % 3)
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")  # both sides of one table
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for same in (False, True):
        got = vectors.batch_search(v, q, 4, exclude_self=True, same_subject=same).collect()
        near = {i: sorted((-(unit[i] @ unit[j]), j) for j in range(200) if j != i and (not same or (i - j) % 3 == 0))[:4] for i in range(0, 200, 10)}
        assert {(r.query_id, r["rank"], r.id) for r in got} == {(i, n + 1, j) for i, few in near.items() for n, (_, j) in enumerate(few)}
