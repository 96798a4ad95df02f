"""The keyword index on disk, and tables in versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import bm25, text_index
from quillgraph.operators.text_index import TextIndex
from quillgraph.sources.versions import Outdated, Part, Versions, merge_collection


def rows_of(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice([4, 12, 40])]) for _ in range(rnd.randint(0, 30)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "rare w0 w1"), (1003, "rare rare rare"), (1004, "é È évil")]
    return spark.createDataFrame(rows, "doc_id long, text string")


QUERIES = ["w0", "w1 w2", "w3 w3 w0", "rare", "rare w0", "evil", "w1,w2", "w0 w1,w2", "nothing", "w0 nothing", "", ">", "w39 w38"]


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(text_index, "GROUP", 16)
    patch.setattr(text_index, "FIRST", 2)
    x = TextIndex(spark, str(tmp_path_factory.mktemp("index") / "t"))
    x.append(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    x.append(docs.where("doc_id % 3 = 1"), "doc_id", "text")
    x.append(docs.where("doc_id % 3 = 2"), "doc_id", "text")
    yield x
    patch.undo()


def test_search_equals_the_search_without_an_index(spark, docs, index):
    p, s = bm25.postings(docs, "doc_id", "text"), bm25.corpus_statistics(docs, "doc_id", "text")
    want = {q: rows_of(bm25.search(p, s, q, 7)) for q in QUERIES}
    assert {q: rows_of(index.search(q, 7)) for q in QUERIES} == want
    among = docs.select(F.col("doc_id").alias("id")).where("id % 5 = 0")
    assert rows_of(index.search("w1 w2", 7, among)) == rows_of(bm25.search(p, s, "w1 w2", 7, among))
    index.merge()
    assert len(index.versions.parts()) == 1
    assert {q: rows_of(index.search(q, 7)) for q in QUERIES} == want


def test_blocks_below_the_bound_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "GROUP", 20)
    rows = [(i, "common " + "filler " * 30) for i in range(400)] + [(1000 + i, "common common common") for i in range(3)]
    x = TextIndex(spark, str(tmp_path / "i"))
    x.append(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r.id for r in x.search("common", 3).collect()} == {1000, 1001, 1002}
    assert x.reads["groups"] >= 15 and x.reads["read"] <= 3


def test_a_search_reads_no_text(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"some words {i % 5}") for i in range(50)], "doc_id long, text string").write.parquet(at)
    x = TextIndex(spark, str(tmp_path / "i"))
    x.append(spark.read.parquet(at), "doc_id", "text")
    found = TextIndex(spark, str(tmp_path / "i")).search("words", 5)
    plan = found._jdf.queryExecution().toString()
    assert at not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket" in plan
    assert found.count() == 5
    empty = TextIndex(spark, str(tmp_path / "e"))
    assert empty.search("words").count() == 0
    empty.append(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert empty.search("words").count() == 0


def test_many_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SEGMENTS", 2)
    x = TextIndex(spark, str(tmp_path / "i"))
    for k in range(3):
        x.append(spark.createDataFrame([(10 * k + i, "a word") for i in range(4)], "doc_id long, text string"), "doc_id", "text")
    assert len(x.versions.parts()) == 1 and x.versions.parts()[0].facts["docs"] == 12
    assert sorted(r.id for r in x.search("word", 20).collect()) == [10 * k + i for k in range(3) for i in range(4)]
    assert x.versions.drop_unused(keep=1) == 3 and x.search("word", 20).count() == 12


def test_a_version_is_published_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.newest() == 0 and v.parts() == []
    v.publish([Part("a", "parts/x", {"n": 1})], 0)
    with pytest.raises(Outdated):
        v.publish([Part("b", "parts/y")], 0)
    assert v.newest() == 1 and v.parts() == [Part("a", "parts/x", {"n": 1})]


def test_only_changed_parts_are_written(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 10).cast("string").alias("subject"), F.concat(F.lit("t"), "id").alias("text")).unionByName(spark.sql("SELECT 999L AS id, CAST(NULL AS STRING) AS subject, CAST(NULL AS STRING) AS text"))
    v = Versions(spark, str(tmp_path / "c"))
    schema = "id bigint, subject string, text string"
    assert merge_collection(v, rows, "subject") == {"written": 11, "kept": 0, "dropped": 0}
    before = {p.name: p.folder for p in v.parts()}
    held = v.read(v.parts(), schema)  # a reader of the first version
    changed = rows.where("subject is not null").withColumn("text", F.when(F.col("subject") == "3", F.upper("text")).otherwise(F.col("text"))).repartition(3)
    assert merge_collection(v, changed, "subject") == {"written": 1, "kept": 9, "dropped": 1}
    after = {p.name: p.folder for p in v.parts()}
    assert {n for n in after if after[n] != before[n]} == {"3"}
    assert sorted(map(tuple, v.read(v.parts(), schema).collect())) == sorted(map(tuple, changed.collect()))
    assert held.count() == 201 and v.newest() == 2
    assert merge_collection(v, changed, "subject")["written"] == 0 and v.newest() == 2


def test_skyline_of_many_counts_takes_one_pass(spark):
    """F5, F7, F8: every pair was made anew for each of a block's counts, so a block of a common word took many seconds."""
    each = [(i, i * 37 % 1500 + 300, i * 7 % 200 + 1) for i in range(1024)]
    made = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.struct(i.alias("id"), (i * 37 % 1500 + 300).cast("bigint").alias("length"), F.sequence(F.lit(1), i * 7 % 200 + 1).alias("positions")))
    sky = text_index._skyline(F.col("docs"))
    assert str(sky).count("transform(") <= 1
    found = [(p.f, p.length) for p in spark.range(1).select(made.alias("docs")).select(sky.alias("s")).first().s]
    right = [(f, n) for f, n in {(f, n) for _, n, f in each} if not any((g > f and m <= n) or (g == f and m < n) for _, m, g in each)]
    assert found == sorted(right)


def test_postings_of_an_index_move_no_tokens(spark, docs):
    """F5, F7, F8: a document's tokens were shuffled one by one."""
    two = docs.withColumn("more", F.concat(F.lit("w1 more "), "text"))
    made = text_index._postings(two, "doc_id", "text", "more")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    right = bm25.postings(two, "doc_id", "text", "more")
    assert made.exceptAll(right).isEmpty() and right.exceptAll(made).isEmpty()
