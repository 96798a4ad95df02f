"""Fitted operators: held-out accuracy, counts by a plain version, decoding by enumeration."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import centroid_lang, line_crf, noisy_or
from quillgraph.llm.common import held_out, load_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def odd_texts():
    r = random.Random(3)
    words = ["a", "bb", "é", "ccc", "#x", "|", "d\x85e", "𝄞𝄞"]
    out = [None, "", " \n\t", "\n\n\n", "a", "a\na\na", "a\r\na\r\nb", "x " * 4000, "\n".join(["same line here"] * 30), "z" * 100_000]
    for _ in range(150):
        out.append("".join(r.choice(words) + r.choice([" ", "  ", "\n", "\x0b", "\n\n"]) for _ in range(r.randint(0, 80))))
    return out


def test_line_counts_equal_plain_version(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(0, 100, 3)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    for r in line_crf.quality(docs, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(texts[r.doc_id]), repr(texts[r.doc_id])[:80]
        assert not (r.base_failed and r.kept)


def test_field_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.kept for r in line_crf.quality(docs, labels).collect()] == [True]
    assert line_crf.quality(docs.where("false"), labels).count() == 0


def test_share_of_one_half_is_kept_and_rows_that_share_an_id_are_judged_each(spark):
    width = line_crf.WIDTH
    weights, jump = np.zeros((width, 2)), np.zeros((2, 2))
    words = " ".join(f"w{i}" for i in range(11))
    docs = spark.createDataFrame([(1, words), (1, words + "\nother " + words), (1, "short"), (None, words)], "doc_id bigint, text string")
    rows = line_crf.judged(docs, (weights, jump)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in rows) == [(0, 11, False, True), (1, 1, True, False), (1, 11, False, True), (1, 23, True, False)]
    assert len(rows) == 4 and all(r.kept == (not r.base_failed and r.content_share >= line_crf.SHARE) for r in rows)


def test_viterbi_and_marginals_by_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores, jump = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        paths = list(itertools.product((0, 1), repeat=n))
        total = np.array([sum(scores[i, p[i]] for i in range(n)) + sum(jump[a, b] for a, b in zip(p, p[1:])) for p in paths])
        first, count = np.array([0]), np.array([n])
        assert line_crf.viterbi(scores, jump, first, count).tolist() == list(paths[total.argmax()])
        p, pairs = line_crf.marginals(scores, jump, first, count)
        w = np.exp(total - total.max())
        w /= w.sum()
        assert np.allclose(p[:, 1], [sum(x for x, q in zip(w, paths) if q[i]) for i in range(n)])
        assert np.isclose(pairs.sum(), n - 1)


def test_several_sequences_decode_apart():
    r = np.random.default_rng(2)
    count = np.array([3, 1, 4])
    first = np.array([0, 3, 4])
    scores, jump = r.normal(size=(8, 2)), r.normal(size=(2, 2))
    together = line_crf.viterbi(scores, jump, first, count)
    apart = np.concatenate([line_crf.viterbi(scores[a : a + n], jump, np.array([0]), np.array([n])) for a, n in zip(first, count)])
    assert together.tolist() == apart.tolist()


def test_quality_keeps_clean_and_drops_junk(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    r = line_crf.quality(load_documents(spark, data), labels).join(labels, "doc_id").toPandas()
    judged = r[~r.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.2


def slur_rows(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        sentences = [" ".join(r.choice(vocabulary) for _ in range(6)) for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(["badword", "vileness", "rottenhead"])
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return rows


def test_toxicity_held_out_and_sentences(spark):
    rows = slur_rows(600, 1)
    docs = spark.createDataFrame([r[:2] + ("u",) for r in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in noisy_or.toxicity(docs, labels).collect()}
    out = [r for r in rows if got[r[0]].held_out]
    assert 120 < len(out) < 280
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([got[r[0]].predicted == r[2] for r in out]) > 0.97
    for i, text, toxic in out:
        for s in got[i].sentences:
            assert any(w in text.encode()[s.start : s.end].decode() for w in ("badword", "vileness", "rottenhead")) or not toxic


def test_toxicity_of_odd_rows(spark):
    rows = slur_rows(80, 2)
    texts = [(1000, None), (1001, ""), (1002, "..!?"), (1003, "x" * 50_000), (None, "badword here"), (1, "again")]
    docs = spark.createDataFrame([r[:2] for r in rows] + texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (4, 0), (4, 1)], "doc_id bigint, toxic int")
    got = noisy_or.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score == 0 and not by[None].held_out
    none = noisy_or.toxicity(docs, labels.where("false")).collect()
    assert len(none) == docs.count() and max(r.score for r in none) < 0.01
    assert noisy_or.toxicity(docs.where("false"), labels).count() == 0


def test_noisy_or_score_is_one_minus_the_product():
    model = (np.sort(np.concatenate([noisy_or.word_hashes(np.frombuffer(b"bad", np.uint8), np.array([0]), np.array([3]), True)])), np.array([3.0]), -2.0)
    h, s, row, *_ = noisy_or.sentence_words(pa.array(["a bad. good thing. bad bad"]))
    assert row.tolist() == [0, 0, 0]
    p = [1 / (1 + np.exp(-(-2.0 + 3.0 * bool(set(h[s == k].tolist()) & set(model[0].tolist()))))) for k in range(3)]
    total = sum(noisy_or.softplus(np.log(q / (1 - q))) for q in p)
    assert np.isclose(1 - np.prod([1 - q for q in p]), -np.expm1(-total))


def test_toxicity_on_the_tables(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    r = noisy_or.toxicity(load_documents(spark, data), labels).join(labels, "doc_id").toPandas()
    r = r[r.held_out]
    assert r[r.toxic == 0].predicted.mean() < 0.02 and r[r.toxic == 1].predicted.mean() >= 0.5


def test_language_held_out(spark, data):
    docs = load_documents(spark, data)
    r = centroid_lang.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (r[r.held_out].lang == r[r.held_out].lang_pred).mean() > 0.97
    assert r.rejected.mean() < 0.01 and r.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    base = [(i, f"the cat sat on the mat {i} and then the hat", "en") for i in range(30)] + [(100 + i, f"der hund und die katze {i} sind nicht hier", "de") for i in range(30)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 + ² !", "de"), (903, "日本語のテキスト", None), (904, "x" * 60_000, None), (None, "the cat and the hat", "en"), (905, "the " * 2000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in base + odd], "doc_id bigint, text string, lang string, lang_pred double")
    got = {r.doc_id: r for r in centroid_lang.languages(docs).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0 and got[900].rejected
    assert got[903].lang_pred in ("en", "de") and got[903].rejected
    assert got[905].lang_pred == got[None].lang_pred == "en" and not got[None].held_out
    unlabelled = centroid_lang.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert centroid_lang.languages(docs.where("false")).count() == 0


def plain_grams(text):
    """n-grams of one text by slices."""
    import unicodedata

    x = "".join(c if unicodedata.category(c)[0] in "LM" or c >= "\u3400" else " " for c in (text or "").lower())
    return Counter(g for n in (1, 2, 3) for g in (x[i : i + n] for i in range(len(x) - n + 1)) if not g.startswith("  ") and g != " ")


def test_counts_equal_plain_ngrams(monkeypatch):
    texts = ["Ab, c", "", None, "aa aa", "ÜBER die Straße", "ПРИВЕТ мир", "日本語 x", "a" * 3000, "é\u0301 \U0001d11e𐐷", " 12 "]
    for chars in (centroid_lang.CHARS, 5):
        monkeypatch.setattr(centroid_lang, "CHARS", chars)
        x = centroid_lang.counts(texts)
        for t, row in zip(texts, x):
            want = plain_grams(t)
            # equal but for grams that share a dimension
            assert row.sum() == want.total() and (row > 0).sum() <= len(want) and (len(want) > 200 or (row > 0).sum() >= len(want) - 2)
            one = centroid_lang.counts([t])[0]
            assert (one == row).all()
    assert (centroid_lang.counts(["ABC Straße"]) == centroid_lang.counts(["abc straße"])).all()


def test_language_is_that_of_the_nearest_centroid():
    """Plain cosines, one text and centroid at a time; ties go to the first name."""
    rows = [(f"the cat and the {w} are here", "en") for w in ("hat", "dog", "mat", "rat")] + [(f"der hund und {w} sind nicht da", "de") for w in ("katze", "haus", "maus")]
    names, idf, centroids, least = centroid_lang.fit([t for t, _ in rows], [v for _, v in rows])
    for t in ["the hat", "der hund", "und", "zzz", "the und", "katze hat"]:
        x, root = centroid_lang.vectors([t], idf)
        plain = [sum(float(a) * float(b) for a, b in zip(x[0], c)) for c in centroids]
        assert np.allclose(x[0] @ centroids.T, plain, atol=1e-5) and np.isclose(np.linalg.norm(x[0]), 1, atol=1e-5)
        assert root[0] == np.sqrt(len(set(plain_grams(t))))
    twice = centroid_lang.fit([t for t, _ in rows] * 2, ["b"] * len(rows) + ["a"] * len(rows))
    x, _ = centroid_lang.vectors(["the cat"], twice[1])
    assert twice[0][int((x @ twice[2].T).argmax()) // centroid_lang.CENTROIDS] == "a"


def test_foreign_scripts_are_rejected_and_short_clean_texts_stay(spark, data):
    docs = load_documents(spark, data)
    model = centroid_lang.train(docs)
    texts = ["これは日本語です。今日は天気がいい。" * 5, "привет как дела " * 9, "Ελληνικό κείμενο " * 9, "qzxj wvkq xxzzq kjqz " * 20]
    clean = [" ".join(WORD.findall(r.text)[:4]) for r in docs.where("lang is not null").limit(200).collect()]
    rows = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id bigint, text string")
    got = {r.doc_id: r.rejected for r in centroid_lang.predicted(rows, model).collect()}
    assert all(got[i] for i in range(4)) and np.mean([got[i] for i in range(4, len(got))]) < 0.02


def test_fits_are_bounded_however_often_a_row_repeats(spark):
    from quillgraph.llm.common import bounded, up_to

    rows = spark.createDataFrame([(1, "same")] * 500 + [(i, f"t{i}") for i in range(500)], "doc_id bigint, text string")
    assert bounded(rows, 2000).count() == 1000 and bounded(rows, 50).count() <= 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x" * 1_100_000] * 10)], names=["i", "t"])
    assert sum(b.num_rows for b in up_to(iter([batch]), 1, 2_000_000)) == 2


def test_noisy_or_scores_equal_a_plain_version(spark):
    """The scorer on whole texts against words, sentences and the product written out."""
    rows = slur_rows(300, 5)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, "Bad! badword?\nvileness. É badwordy"), (901, ""), (902, "badword x badword, vileness badword")], "doc_id bigint, text string")
    names, weights, bias = noisy_or.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    weight = dict(zip(names.tolist(), weights.tolist()))

    # weights for repetitions too, whether or not the fit found them telling
    again = [f ^ int(noisy_or.TWICE) for f in weight]
    weight |= {f: 0.75 for f in again if f not in weight}
    names = np.array(sorted(weight), np.uint64)
    weights = np.array([weight[f] for f in names.tolist()])

    def code(word, n=None):
        b = word.encode()[: n or None]
        h = noisy_or.word_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), True)[0]
        return int(h + np.uint64(n or 0))

    def plain(text):
        keep = 1.0
        for sentence in re.split(r"[.!?\n\r]", text):
            words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", sentence)
            if words:
                met = [code(w, n) for w in words for n in (None, *noisy_or.STEMS)]
                found = set(met) | {f ^ int(noisy_or.TWICE) for f in met if met.count(f) > 1}
                keep *= 1 - 1 / (1 + np.exp(-(bias + sum(weight.get(f, 0) for f in found))))
        return 1 - keep

    got = {r.doc_id: r for r in noisy_or.scored(docs, (names, weights, bias)).collect()}
    for r in docs.collect():
        assert np.isclose(got[r.doc_id].score, plain(r.text), atol=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


@pytest.mark.parametrize("modulus, remainder", [(3, 1), (5, 0)])
def test_held_out_is_crc32(spark, modulus, remainder):
    import zlib

    rows = spark.range(200).select("id", held_out("id", modulus, remainder).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % modulus == remainder) for r in rows)


def test_a_labelled_text_without_a_letter_leaves_rejection_on(spark):
    from quillgraph.llm import centroid_lang

    rows = [(i, f"the cat number {'abcdefghij'[i % 10]} sat on the mat with the dog", "en") for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, "12345 67890 --", "en"), (41, "", "en")], "doc_id bigint, text string, lang string")
    least = centroid_lang.train(docs)[3]
    assert (least > 0).all() and least.tolist() == centroid_lang.train(docs.where("doc_id < 40"))[3].tolist()
