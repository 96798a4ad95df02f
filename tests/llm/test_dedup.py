"""Near-duplicate, passage and embedding operators against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quillgraph.llm import odd_sketch, pigeonhole_join, queries, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def family_texts(seed, n=60):
    """Groups of near copies with edits on both sides of the threshold, and odd texts."""
    r, out = random.Random(seed), []
    for _ in range(n // 6):
        base = [r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(r.randint(2, 60))]
        for k in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 10))):
                w[r.randrange(len(w))] = "x" + str(r.randint(0, 9))
            out.append(r.choice(["  ", " ", "\n", "\t"]).join(w) if k else " ".join(base))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = family_texts(size) + ["", " \n", None, "one", "ONE", "one two", "One  TWO", "é É", "x" * 5000, "a " * 3000]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, key string, n_shingles string")
    got = {r.doc_id: r for r in odd_sketch.near_duplicates(docs, size).collect()}
    sets = {i: shingles(t, size) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id bigint, text string")
    rows = sorted(odd_sketch.near_duplicates(docs, 2).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(None, None, False), (7, 7, True), (7, 7, True), (9, 7, False)]
    empty = odd_sketch.near_duplicates(docs.where("false"), 2)
    assert empty.count() == 0


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "a"), (1, "totally other words are kept here too", "b"), (2, long + " end", "c"), (3, None, "d"), (3, "", "e"), (None, long, "f"), (None, long, "g"), (0, "totally other words are kept here too", "h"), (5, long, "i"), (1, long, "j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    got = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in odd_sketch.near_duplicates(docs, 5).collect())
    assert got == sorted([(True, 1, 46, 1, True)] * 2 + [(True, 1, 3, 0, False), (True, 2, 47, 1, False), (True, 3, 0, 3, True), (True, 3, 0, 3, True), (False, None, 46, None, False), (False, None, 46, None, False), (True, 0, 3, 0, True), (True, 5, 46, 1, False)])
    kept = odd_sketch.deduplicated(docs, 5)
    assert kept.columns == docs.columns
    left = {r.row for r in kept.collect()}
    assert left - {"a", "j"} == {"d", "e", "f", "g", "h"} and len(left) == 6
    assert odd_sketch.deduplicated(docs.where("false"), 5).count() == 0


def test_links_between_members_that_no_hub_joins(spark, monkeypatch):
    """A chain of near copies whose ends are far apart is one component."""
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(8):
        w = list(words)
        w[k * 12 : k * 12 + 12] = [f"z{k}_{i}" for i in range(12)]
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    monkeypatch.setattr(odd_sketch, "TILE", 2)
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(docs, 2, 75).collect()}
    assert got == components(sets, links)


def test_bounds_hold():
    assert odd_sketch.most_flips(0.8) < odd_sketch.most_flips(0.5) <= 64 * odd_sketch.WORDS + 16
    a, b = set(range(1000)), set(range(100, 1100))
    x, y = (np.sort(np.array([hash(("s", i)) & (2**63 - 1) for i in s], np.uint64)) for s in (a, b))
    p, q = (np.frombuffer(v, np.uint64) for v in odd_sketch.parity_bitmaps([x, y]))
    assert np.bitwise_count(p ^ q).sum() <= len(a ^ b)


def plain_removal(rows, length):
    seen, out = {}, {}
    for key, (i, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            grams = [b[p : p + length] for p in range(len(b) - length + 1)]
            for p, g in enumerate(grams):
                if seen.get(g, i) < i:
                    gone[p : p + length] = b"\1" * length
            for g in grams:
                seen[g] = min(seen.get(g, i), i)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.setdefault(i, []).append((len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("length, hot", [(50, 1 << 15), (50, 6), (32, 2)])
def test_passages_equal_brute_force(spark, length, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 100)
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 500)
    r = random.Random(length + hot)
    blocks = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 120))) for _ in range(12)] + ["a" * 200, "ab" * 60]
    rows = [(i, "".join(r.choice(blocks) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "x" * (length - 1)), (203, rows[5][1]), (3, rows[4][1]), (3, blocks[0] + blocks[1]), (None, blocks[2] * 2), (500, blocks[2])]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id bigint, text string, n_bytes int, chunk string")
    found = suffix_dedup.remove_repeats(docs, length).collect()
    got = {}
    for x in found:
        got.setdefault(x.doc_id, []).append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
        assert hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256
    assert {k: sorted(v) for k, v in got.items()} == plain_removal(rows, length)


def test_passages_of_no_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def plain_factors(text, starts, docs, length):
    grams = [bytes(text[s : s + length]) for s in starts]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), length)
    return [max([shared(g, h) for h, e in zip(grams, docs) if e < d], default=0) for g, d in zip(grams, docs)]


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors_by_plain_comparison(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([r.integers(97, 97 + 1 + seed, 400).astype(np.uint8), np.frombuffer(b"abcabc" * 40, np.uint8), np.zeros(8, np.uint8)])
    starts = r.permutation(len(text) - 50)[:300]
    docs = r.integers(0, (300, 2, 40)[seed % 3], 300)
    for length in (32, 50):
        want = plain_factors(text, starts, docs, length)
        assert suffix_dedup.lpf(text, starts, docs, length).tolist() == want
        for least in (9, length):
            got = suffix_dedup.lpf(text, starts, docs, length, least)
            assert [max(x, least - 1) for x in got] == [max(x, least - 1) for x in want]
        hit = suffix_dedup.covered(text, starts, docs, suffix_dedup.string_hash(text, starts, length), length)
        assert hit.tolist() == [x >= length for x in want]


def test_short_passages_are_refused(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 27)


def test_very_long_texts_and_one_id_for_many_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 100_000)
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, long[1000:300_000]), (3, "x" * 200_000)] + [(4, long[i * 100 : i * 100 + 400]) for i in range(100)] + [(0, long[5:60])]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), keep_text=False).collect()
    by = {x.doc_id: x for x in found}
    assert len(found) == len(rows) and by[1].n_removed == 55 and by[2].n_removed == 299_000 and by[3].n_removed == 0
    assert all(x.n_removed == x.n_bytes for x in found if x.doc_id == 4)


def cloud(seed, n=300, size=64):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size)).astype(np.float32)
    for k in range(0, n, 5):  # families around the threshold
        for j in range(1, 4):
            x[(k + j) % n] = x[k] + r.normal(size=size).astype(np.float32) * (0.15 + 0.08 * j)
    x[7], x[8] = x[6], x[6] * 2
    return x


@pytest.mark.parametrize("size", [64, 12, 3])
def test_embeddings_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(pigeonhole_join, "TILE", 16)
    x = cloud(size, size=size)
    rows = [(i, [float(v) for v in e], i % 3) for i, e in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * size, 1), (902, rows[0][1], None), (903, [float("nan")] * size, 1), (904, [None] * size, 1), (905, [], 1), (906, rows[1][1], 1), (907, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id bigint, embedding array<float>, label int, v string")
    got = {r.vec_id: r for r in pigeonhole_join.near_duplicates(df).collect()}
    good = {}
    for i, e, label in rows:
        if e and label is not None and all(v is not None and np.isfinite(v) for v in e) and any(e):
            good[i] = (np.array(e, np.float32).astype(np.float64), label)
    links = []
    for a, b in itertools.combinations(good, 2):
        (u, p), (v, q) = good[a], good[b]
        if p == q and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
            links.append((a, b))
    want = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert links
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) for i, r in got.items())


def test_embeddings_of_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    rows = sorted(pigeonhole_join.near_duplicates(df).collect(), key=lambda r: r.vec_id or 0)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows] == [(None, 0, None, False), (2, 1, 2, True), (2, 1, 2, True)]
    assert pigeonhole_join.near_duplicates(df.where("false")).count() == 0


def test_embeddings_that_share_an_id_and_families_in_a_table(spark):
    x = cloud(1, 40, 16)
    rows = [(1, [float(v) for v in x[0]], 1), (1, [float(v) for v in x[0] * 1.01], 1), (2, [float(v) for v in x[0]], 1), (2, [float(-v) for v in x[0]], 1), (0, [float(-v) for v in x[0]], 1), (9, [float(v) for v in x[0]], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pigeonhole_join.near_duplicates(df).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 1, 0, False), (0, 1, 0, True), (9, 0, 9, True)])
    assert pigeonhole_join.near_duplicates(df.where("false")).count() == 0


def plain_rows(found):
    return found[sorted(found.columns)].astype(str).sort_values(sorted(found.columns)).values.tolist()


@pytest.mark.parametrize("name", ["op1_pigeonhole_join", "op7_suffix_lpf", "op8_odd_sketch", "op9_mixing"])
def test_sql_agrees_on_odd_rows(spark, tmp_path, name):
    """The counterparts in SQL over a fixture with links, repeated rows, nulls and repeated passages."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(11)
    texts = family_texts(4, 48) + [None, "", " ", "One two", "one TWO", "x " * 300]
    docs = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)] + [(5, texts[5], "s1")] * 3 + [(60 + k, texts[k] + " " + texts[k + 1], "s0") for k in range(0, 20, 2)]
    r.shuffle(docs)
    x = cloud(2, 60, 16)
    vectors = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)] + [(70, None, 1), (71, [0.0] * 16, 1), (72, [float(v) for v in x[0]], None), (73, [float(v) for v in x[0]], 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as c:
        for t in ("documents", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(tmp_path)).toPandas()
    assert len(got) and plain_rows(got) == plain_rows(want)
