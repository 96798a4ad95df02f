"""The index of distinct texts, merge rounds, block-max search; hashes of crafted words."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import block_max, common, cut_index, odd_sketch, piece_merges, queries, tokens
from quillgraph.llm.common import load_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans(block_max.UPPER, block_max.LOWER)
DOCS = "doc_id long, text string, output string, form string, part int"


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


# distinct-text index


def plain_cut(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    d = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), sha(out), sha(text)


def test_cuts_equal_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(cut_index, "HOT_ROWS", 20)
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab Zé日\n<PSM>/😀") for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, "one text that many rows share, " * 5) for i in range(150)]  # a hot text
    rows += [(7, "twice")] * 40 + [(None, "no id"), (None, "no id"), (None, None), (5000, None), (5001, ""), (5002, "<P> inside"), (5003, "long wörds " * 60000), (5004, "<S"), (5005, "<"), (5006, "x" * 300000)]
    docs = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOCS).repartition(7)
    got = [tuple(r) for r in cut_index.digests(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
    assert Counter(got) == Counter(plain_cut(*r) for r in rows)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


def test_cuts_of_an_empty_table(spark):
    assert cut_index.digests(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=300, unique=True), st.integers(0, 100000))
def test_elias_fano_selects(ends, more):
    ends = sorted(ends)
    low, lows, highs = cut_index.packed(np.array(ends, np.int64), ends[-1] + more)
    assert [cut_index.selected(i, low, lows, highs) for i in range(len(ends) + 1)] == [0, *ends]
    assert 8 * (len(lows) + len(highs)) <= len(ends) * (2 + max(0, math.log2((ends[-1] + more) / len(ends)))) + len(ends) + 24


def test_ends_are_computed_once_a_distinct_text(spark):
    docs = spark.createDataFrame([(i, f"text {i % 10}") for i in range(200)], "doc_id long, text string")
    rows = cut_index.joined_index(docs)
    assert rows.count() == 200 and rows.select("text").distinct().count() == 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


# merge rounds


@pytest.fixture(scope="module")
def model():
    return piece_merges.Pieces(piece_merges.default_model())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.sampled_from(" ▁\n\tabcdethino.,01é日本<>\0😀")), st.text(max_size=30)), max_size=5))
def test_pieces_equal_the_library(model, group):
    group = [t.encode("utf-8", "ignore").decode() for t in group]
    assert model.known
    ids = model.encode(group)
    assert [x.tolist() for x in ids] == [model.library.encode(t, add_bos=True, add_eos=True) for t in group]
    assert model.decode(ids) == [model.library.decode(x.tolist()) for x in ids]


def test_pieces_of_pieces_equal_the_library(model):
    rnd, vocabulary = random.Random(5), list(model.pieces)
    group = ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 15))) for _ in range(3000)]
    group += [" " * k + "x" for k in range(70)] + ["=" * k for k in range(70)] + ["a b" * 3, "ab" * 40000, " " * 50000, "".join(rnd.choice("abcdefgh") for _ in range(100000))]
    assert [x.tolist() for x in model.encode(group)] == [model.library.encode(t, add_bos=True, add_eos=True) for t in group]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=20))
def test_any_ids_decode_as_in_the_library(model, ids):
    assert model.decode([np.array(ids, "<u4")]) == [model.library.decode(ids)]


def test_another_normalisation_goes_to_the_library(model, monkeypatch):
    other = piece_merges.Pieces(piece_merges.default_model())
    monkeypatch.setattr(other, "known", False)
    group = ["some  text", "", " ﬁ"]
    assert [x.tolist() for x in other.encode(group)] == [model.library.encode(t, add_bos=True, add_eos=True) for t in group]


def test_piece_queries(spark, data, model):
    got = {r[0]: tuple(r)[1:] for r in queries.op12_piece_merges(spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    rows = load_documents(spark, data).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = model.library.encode(text or "", add_bos=True, add_eos=True)
        assert got[doc] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(model.library.decode(ids)))


def test_pieces_of_odd_rows(spark, model):
    texts = [None, "", "same", "same", "x" * 200000, "é" * 3]
    docs = spark.createDataFrame([(None if i == 3 else i % 4, t, "c", "c", 0) for i, t in enumerate(texts)], DOCS)
    ids = piece_merges.encoded(docs)
    want = Counter((None if i == 3 else i % 4, tuple(model.library.encode(t or "", add_bos=True, add_eos=True))) for i, t in enumerate(texts))
    assert Counter((r[0], tuple(r[1])) for r in ids.collect()) == want
    assert Counter(r[1] for r in piece_merges.decoded(ids).collect()) == Counter(t or "" for t in texts)
    gone = piece_merges.decoded(spark.createDataFrame([(1, None), (2, [1, 2])], "doc_id long, ids array<int>")).collect()
    assert {r[0]: r[1] for r in gone} == {1: None, 2: ""}
    assert piece_merges.round_trip(spark.createDataFrame([], DOCS)).count() == 0


# block-max search


def plain_search(rows, items, k):
    docs = [(d, [t.translate(SMALL) for t in TERM.findall(x or "")]) for d, x in rows]
    docs = [(d, Counter(w), len(w)) for d, w in docs if w]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, x in items:
        asked.setdefault(i, set()).update(t.translate(SMALL) for t in TERM.findall(x or ""))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c, length in docs:
            m = 50 + (50 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("group", [200_000, 5])
def test_search_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(block_max, "BLOCK_BYTES", 400)
    monkeypatch.setattr(block_max, "CHUNK_BLOCKS", 3)
    monkeypatch.setattr(block_max, "GROUP_TERMS", group)
    rnd = random.Random(9)
    words = ["the", "of", "Éa", "日本", "x1", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice([5, 20, 65])]) for _ in range(rnd.randint(0, 25)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "..,"), (None, "the w1 w2"), (5, "w3 w3 the"), (5, "w3 w3 the"), (6, "THE Of É Éa"), (903, "w7 " * 5000)]
    items = [(1, "w1 w2 w3"), (2, "THE"), (3, None), (4, ""), (5, "nowhere"), (1, "w4"), (None, "w5 the"), (7, "Éa 日本 x1"), (8, " ".join(words))]
    docs = spark.createDataFrame([(*r, "c", "c", 2) for r in rows], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, term string")
    got = [tuple(r) for r in block_max.ranked(docs, asked, k=10).select("item_id", "rank", "doc_id", "score").collect()]
    assert Counter(got) == Counter(plain_search(rows, items, 10))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert block_max.ranked(docs, items).count() == block_max.ranked(docs, some).count() == block_max.ranked(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0


def test_blocks_below_the_bound_are_not_scored():
    common_, rare = "the of and", [f"rare{i} rare{i} {i}" for i in range(40)]
    blocks = []
    for i in range(40):
        part = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(10 * i, 10 * i + 10)), "text": pa.array([common_] * 9 + [rare[i]])})
        blocks.append(block_max.block_of(part, 400, 1600))
    items = block_max.Items([0], [(0, "rare3"), (0, "the")])
    items.weigh({items.vocabulary.index("rare3"): 1, items.vocabulary.index("the"): 360}, 400)
    vocabulary = pa.array(items.vocabulary)
    rows = [{n: pa.array(x) if not isinstance(x, pa.Array) else x for n, x in b.items()} for b in blocks]
    ranker = block_max.Ranker(items, 400, 1600, 1, np.ones(1, np.int64))
    ranker.feed([block_max.Block(r, vocabulary, 2) for r in rows])
    assert ranker.scored == 1 and ranker.seen == 40 and ranker.results().column(1).to_pylist() == [39]


# crafted words


def morse(n: int) -> str:
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


ONE, TWO = morse(1024), morse(1024).translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse():
    group = [ONE, TWO, ONE + " " + TWO, "-" * 5000, "x" * 33, "x" * 34]
    enc = tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(group)] == [enc.library.encode(t, add_special_tokens=False).ids for t in group]
    body, bounds = common.text_bytes(pa.array([ONE, TWO]))
    h = common.word_hashes(body, *common.word_spans(body, bounds), True)
    assert h[0] != h[1]


def test_long_pieces_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_CHARS", 100)
    enc = tokens.Encoder(tokens.default_vocabulary())
    for group in (["y" * 90, "z" * 90], ["z" * 90, "y" * 90], ["y" * 90 + " a", "b"]):
        assert [x.tolist() for x in enc.encode(group)] == [enc.library.encode(t, add_special_tokens=False).ids for t in group]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB é", min_size=1, max_size=80), min_size=1, max_size=8))
def test_equal_hashes_are_equal_words(group):
    body, bounds = common.text_bytes(pa.array(group))
    starts, ends = common.word_spans(body, bounds)
    raw = body.tobytes()
    words = [raw[a:z].lower() for a, z in zip(starts.tolist(), ends.tolist())]
    h = common.word_hashes(body, starts, ends, True).tolist()
    assert len(set(zip(words, h))) == len(set(words)) == len(set(h))


def test_documents_of_confusing_words_are_not_linked(spark):
    rows = [(1, f"{ONE} and some more"), (2, f"{TWO} and some more"), (3, f"{ONE} and some more")]
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
