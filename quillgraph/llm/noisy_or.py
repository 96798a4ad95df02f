"""Toxicity by multiple-instance learning.

Only documents have labels, but it is sentences that offend. A sentence's probability is a
logistic function of the words in it, their beginnings, and which of these it repeats; a document's is the noisy-or of its sentences,
1 - prod(1 - p). The weights are fitted on document labels through that combination, so
they settle on the words of the offending sentences, and those sentences can be pointed at.

The model is fitted on a bounded sample of labelled rows (``sample``), in one task; its size
is bounded too (``words``: features that tell labels apart significantly). Scoring reads every whole text in batches.

Sentences end at . ! ? and line ends; words are runs of letters, A-Z as a-z. Defined
results: a null or empty text has no sentence and the score 0; so has every text if nothing
is labelled; if only one label value occurs, the model is that of its words all the same.
Several labels of one document count as toxic if one does; null labels and ids do not count.
Rows with a null doc_id are scored and are not held out. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, bounded, held_out, slices, small_batches, text_bytes, texts, tidied, up_to, word_hashes, word_spans

SAMPLE, WORDS, ROUNDS = 12_000, 8192, 250
STEMS = (4, 6)  #: lengths in bytes of the beginnings of words that are features too
TELLING = 15.0  #: least likelihood ratio (G squared) of a feature
TWICE = np.uint64(0x9E3779B97F4A7C15)  #: turns a feature's hash into that of its repetition within a sentence


def _tables() -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    end = np.zeros(256, bool)
    end[list(b".!?\n\r")] = True
    return letter, end


def sentence_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: the hash and sentence of each word and its beginnings, each sentence's row and its bounds in bytes of the row.

    Only stretches between ends that hold a word are sentences.
    """
    letter, end = _tables()
    body, bounds = text_bytes(column)
    starts, ends = word_spans(body, bounds, letter)
    row = np.searchsorted(bounds, starts, "right") - 1
    stop = np.cumsum(end[body])
    part = stop[starts] if len(starts) else np.zeros(0, np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    kinds = [word_hashes(body, starts, ends, True), *(word_hashes(body, starts, np.minimum(ends, starts + k), True) + np.uint64(k) for k in STEMS)]
    return np.concatenate(kinds), np.tile(np.cumsum(fresh) - 1, len(kinds)), row[first], starts[first] - bounds[row[first]], ends[last] - bounds[row[first]]


def with_repeats(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their sentences, and further ones for each hash that a sentence holds again."""
    order = np.lexsort((h, s))
    again = order[1:][(h[order][1:] == h[order][:-1]) & (s[order][1:] == s[order][:-1])]
    return np.concatenate((h, h[again] ^ TWICE)), np.concatenate((s, s[again]))


def known(h: np.ndarray, s: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Sorted distinct sentence * number of names + place of the name, of all ``names`` (sorted) that occur."""
    if not len(names) or not len(h):
        return np.zeros(0, np.int64)
    wanted = np.unique(np.concatenate((names, names ^ TWICE)))
    some = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
    h, s = with_repeats(h[some], s[some])
    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
    hit = names[at] == h
    return np.unique(s[hit] * len(names) + at[hit])


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(tables: list[tuple[pa.Array, np.ndarray]], words: int, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the bias, from texts with labels.

    The texts are read twice: first for the number of documents with each feature, then for
    the features that stay, so only counts and the sample itself are held.
    """
    label = [np.asarray(y).astype(bool) for _, y in tables]
    y = np.concatenate(label) if label else np.zeros(0, bool)
    names, a, b = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    parts = [(c.slice(i, 512), o[i : i + 512]) for (c, _), o in zip(tables, label) for i in range(0, len(o), 512)]
    for column, own in parts:
        h, s, row, *_ = sentence_words(column)
        h, s = with_repeats(h, s)
        row = row[s]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, toxic = h[new], own[row[new]]
        names, place = np.unique(np.concatenate((names, h)), return_inverse=True)
        a = np.bincount(place, np.concatenate((a, toxic)), len(names))
        b = np.bincount(place, np.concatenate((b, ~toxic)), len(names))
    if not len(names):
        return np.zeros(0, np.uint64), np.zeros(0), -20.0
    p, q = (a + 0.5) / (y.sum() + 1), (b + 0.5) / ((~y).sum() + 1)
    share = y.mean()
    gain = 2 * (a * np.log(np.maximum(a, 1) / np.maximum((a + b) * share, 1e-9)) + b * np.log(np.maximum(b, 1) / np.maximum((a + b) * (1 - share), 1e-9)))
    ranked = np.argsort(-gain, kind="stable")[:words]
    best = np.sort(ranked[gain[ranked] >= TELLING])  # those that tell the labels apart
    kept = names[best]
    pairs, rows, documents, sentences = [], [], 0, 0
    for column, own in parts:
        h, s, row, *_ = sentence_words(column)
        pairs.append(known(h, s, kept) + sentences * len(kept))
        rows.append(row + documents)
        documents, sentences = documents + len(own), sentences + len(row)
    row, pair = np.concatenate(rows), np.concatenate(pairs)
    s, word = pair // max(len(kept), 1), pair % max(len(kept), 1)

    w, bias = np.clip(np.log(p / q)[best], -1, 5), -7.0
    theta, m, v = np.append(w, bias), np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(s, theta[:-1][word], sentences) + theta[-1]
        total = np.maximum(np.bincount(row, softplus(z), len(y)), 1e-12)
        slope = np.where(y, -1 / np.expm1(np.minimum(total, 500)), 1.0)
        g_z = slope[row] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(word, g_z[s], len(best)), g_z.sum()) / len(y)
        g[:-1] += (0.05 * theta[:-1] + 0.02 * np.sign(theta[:-1])) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return kept, theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows, those first by a hash of their id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit("sample")), "doc_id").limit(sample)
    small_batches(docs.sparkSession)
    # at most ``sample`` pairs of numbers
    rows = bounded(texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, w, bias = fit([(b.column(1), b.column(2).to_numpy(zero_copy_only=False)) for b in up_to(batches, 1, SAMPLE_BYTES) if b.num_rows], words, rounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h, np.uint64(0)).view(np.int64)), pa.array(np.append(w, bias)), pa.array([False] * len(h) + [True])], names=["h", "w", "bias"])

    model = rows.mapInArrow(tidied(run), "h bigint, w double, bias boolean").collect()  # at most words + 1 rows
    found = sorted((r.h & 0xFFFFFFFFFFFFFFFF, r.w) for r in model if not r.bias)
    return np.array([x for x, _ in found], np.uint64), np.array([x for _, x in found]), next((r.w for r in model if r.bias), -20.0)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.7, sentence_threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted, and the offending sentences: start and end in UTF-8 bytes, score."""
    names, weights, bias = model
    leak = float(softplus(np.float64(bias)))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 1)):
            h, s, row, start, end = sentence_words(batch.column(1))
            pair = known(h, s, names)
            some, word = (pair // len(names), pair % len(names)) if len(names) else (pair, pair)
            ids, place = np.unique(some, return_inverse=True)
            z = np.bincount(place, weights[word], len(ids)) + bias if len(ids) else np.zeros(0)
            total = np.bincount(row, minlength=batch.num_rows) * leak + np.bincount(row[ids], softplus(z) - leak, batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            bad = np.flatnonzero(p >= sentence_threshold)
            of = row[ids[bad]]
            spans = [{"start": int(start[ids[k]]), "end": int(end[ids[k]]), "score": float(p[k])} for k in bad.tolist()]
            edge = np.searchsorted(of, np.arange(batch.num_rows + 1))
            score = np.clip(-np.expm1(-np.maximum(total, 0)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(spans, span))], names=["doc_id", "score", "predicted", "sentences"])

    small_batches(docs.sparkSession)
    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidied(run), "doc_id bigint, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out."""
    model = train(docs, labels.where(~held_out("doc_id", modulus, remainder)))
    return scored(docs, model, threshold).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted", "sentences")
