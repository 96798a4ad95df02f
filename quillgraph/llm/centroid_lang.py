"""Language identification by nearest centroids.

A text is a vector of character n-grams (one to three code points of any script, letters in
small case and all else as blanks, blanks at the ends of words included), hashed to a fixed
number of dimensions, weighted by TF-IDF and scaled to length one. Each language has several
centroids, found by spherical k-means; the language of the centroid with the highest cosine
wins. The cosine of a short text is lower, about as the root of its number of different
n-grams (counted up to ``MANY``). A text is rejected if its cosine over that root stays below
its language's least: a fixed part of a low quantile of that quotient among the texts that
the language was fitted on.

The centroids and document frequencies are fitted on a bounded sample of labelled rows
(about ``sample`` a language, picked by a hash of id and text, and at most ``SAMPLE_BYTES`` of
text), in one task; their size is bounded by the number of languages. Prediction reads every
whole text.

Defined results: a null text and one without a letter are ``und`` with score 0 and rejected;
so is every text if nothing is labelled; a text with letters always gets a learned
language, by order of names on ties. Null labels are not learned. Further columns are
ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, held_out, mix64, small_batches, tidied, up_to

DIMENSIONS, CENTROIDS, SAMPLE = 1 << 13, 4, 1000
MANY, QUANTILE, PART = 100, 0.01, 0.4  #: n-grams that count for the root; of the fitted quotients; of that quantile
ROWS, CHARS = 128, 1 << 20  #: texts and characters that are counted at once
SIZES = (1, 2, 3)

Model = tuple[list[str], np.ndarray, np.ndarray, np.ndarray]  # languages; idf; centroids; least quotients


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters or marks that belong to them; those past the table's end count as letters."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x3400)] + [True])


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in small case, blanks for all but letters, and each text's bounds."""
    small = [(t or "").lower() for t in texts]
    x = np.frombuffer("".join(small).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    table = _letters()
    x[~table[np.minimum(x, len(table) - 1).astype(np.int64)]] = 32
    return x, np.concatenate(([0], np.cumsum([len(t) for t in small]))).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """n-gram counts, a row a text."""
    n = len(texts)
    out, group, size = np.zeros(n * DIMENSIONS), [], 0
    for i, t in enumerate([*texts, None]):
        if group and (i == n or size > CHARS):
            _count(group, i - len(group), out)
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    return out.reshape(n, DIMENSIONS).astype(np.float32)


def _count(texts: list[str | None], first: int, out: np.ndarray) -> None:
    x, bounds = folded(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    part = out[first * DIMENSIONS : (first + len(texts)) * DIMENSIONS]
    blank = x == 32
    for size in SIZES:
        m = len(x) - size + 1
        if m <= 0:
            continue
        h, inside = x[:m].copy(), row[:m] == row[size - 1 :]
        for i in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + m]
        inside &= ~blank[:m] | (~blank[1 : m + 1] if size > 1 else False)
        h = mix64(h + np.uint64(size << 40)) % np.uint64(DIMENSIONS)
        part += np.bincount((row[:m] * DIMENSIONS + h.astype(np.int64))[inside], minlength=len(part))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the root of the number of different n-grams, up to MANY."""
    x = counts(texts)
    return unit(np.log1p(x) * idf), np.sqrt(np.clip((x > 0).sum(axis=1), 1, MANY))


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centroids of unit vectors; seeds are the rows farthest from those before."""
    centroids = unit(x.mean(axis=0, keepdims=True))
    near = x @ centroids[0]
    seeds = [int(near.argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centroids = x[seeds]
    for _ in range(10):
        at = (x @ centroids.T).argmax(axis=1)
        centroids = unit(np.stack([x[at == i].mean(axis=0) if (at == i).any() else centroids[i] for i in range(len(centroids))]))
    return centroids


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    known = np.array([names.index(v) for v in langs])
    seen = np.zeros(DIMENSIONS)
    for i in range(0, len(texts), ROWS):
        seen += (counts(texts[i : i + ROWS]) > 0).sum(axis=0)
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    centroids, least = [], []
    for k in range(len(names)):
        own = [texts[i] for i in np.flatnonzero(known == k)]
        x, root = (np.concatenate(z) for z in zip(*(vectors(own[i : i + ROWS], idf) for i in range(0, len(own), ROWS))))
        c = clustered(x, CENTROIDS)
        c = np.concatenate((c, np.zeros((CENTROIDS - len(c), DIMENSIONS), np.float32)))
        near = x @ c.T
        centroids.append(c)
        least.append([PART * float(np.quantile(near.max(axis=1) / root, QUANTILE))] * CENTROIDS)
    return names, idf, np.concatenate(centroids).astype(np.float32), np.array(least, np.float64).ravel()


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on about ``sample`` of the rows of each language with a letter, all of which may be used."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not many:
        return None
    part = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(many.items())))
    # copies of one row share a hash: the limit bounds them too
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000)) < part * 1_000_000).limit(4 * sample * len(many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for b in up_to(batches, 1, SAMPLE_BYTES):
            texts += b.column(1).to_pylist()
            langs += b.column(2).to_pylist()
        if texts:
            names, idf, centroids, least = fit(texts, langs)
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (idf, centroids, least))], names=["names", "idf", "centroids", "least"])

    found = picked.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id").mapInArrow(tidied(run), "names array<string>, idf binary, centroids binary, least binary").collect()
    if not found:
        return None
    m = found[0]
    return list(m.names), np.frombuffer(m.idf, np.float32), np.frombuffer(m.centroids, np.float32).reshape(-1, DIMENSIONS), np.frombuffer(m.least)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected behind its own columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = batch.column(at).to_pylist()
                some = np.array([bool(t and letter(t)) for t in texts], bool) & (model is not None)
                lang, score, rejected = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                if some.any():
                    names, idf, centroids, least = model
                    x, root = vectors(texts, idf)
                    near = x @ centroids.T
                    best = near.argmax(axis=1)
                    score = np.where(some, np.clip(near[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
                    lang = [names[b // CENTROIDS] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())]
                    rejected = ~some | (score < least[best] * root)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidied(run), f"{schema}, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, by a model of the rows that are not held out."""
    model = train(docs.where(~held_out("doc_id", modulus, remainder)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return predicted(rows, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "lang_pred", "score", "rejected")
