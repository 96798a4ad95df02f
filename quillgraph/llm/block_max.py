"""Ranked lexical search over a forward index in blocks of documents, with block-max pruning.

A block is a range of documents in the order they are read, about 256 KB of text. It holds its
distinct terms with, for each, the number of its documents and the greatest impact in any of
them, and the documents' entries (term, occurrences). Impacts are whole numbers, so scores
and bounds are exact.

A search adds up each item's bound for every block from the terms' greatest impacts alone.
First the blocks with the highest bounds of all are scored, which gives every item a score
that its last result must reach. Then each task sorts its blocks by an item's bound and
scores them until the bound is below that score or below the last of the results it has; it
returns no more than those. Items are asked in groups of a bounded number of terms, each group
with one search of all blocks.

Defined results: terms are maximal runs of digits, letters and characters beyond ASCII, A-Z in
small case. A null text has no term; a document or an item without one has no result. Every
row of the documents is a document: equal rows are ranked each, equal scores by doc_id, null
ids last. Rows that share an item_id are one item with the terms of all; null is an id as any
other. Empty tables give no rows; further columns are ignored. Two texts are the same term
only if all their bytes agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches, text_bytes, texts, tidied, word_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 256 << 10  #: of text in a block, one document at least
CHUNK_BLOCKS = 32  #: blocks whose bounds a task sorts at once
GROUP_TERMS = 200_000  #: terms of the items asked at once, about
SEEDS = 4  #: blocks that are scored first for an item
INDEX = "block bigint, doc_ids array<bigint>, n_terms array<bigint>, first array<int>, codes array<int>, tf array<int>, terms array<string>, df array<int>, most array<bigint>"

_MEMBER = np.zeros(256, bool)
_MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    body, bounds = text_bytes(column)
    body = _FOLD[body]
    return body, bounds, *word_spans(body, bounds, _MEMBER)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            for part in slices(batch, 1):
                _, bounds, starts, _ = _spans(part.column(1))
                first = np.searchsorted(starts, bounds)
                n, words = n + int((first[1:] > first[:-1]).sum()), words + len(starts)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "words": pa.array([words], pa.int64())})

    row = texts(docs).mapInArrow(tidied(run), "n bigint, words bigint").agg(F.sum("n"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Of occurrences in documents of so many terms."""
    m = 50 + (50 * length.astype(np.int64) * n_docs) // max(n_words, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def block_of(part: pa.RecordBatch, n_docs: int, n_words: int) -> dict | None:
    """One block of the rows (doc_id, text), as columns of INDEX without its number; None without a term."""
    body, bounds, starts, ends = _spans(part.column(1))
    if not len(starts):
        return None
    held = np.diff(np.searchsorted(starts, bounds))
    some = np.flatnonzero(held)
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body[_MEMBER[body]])]).dictionary_encode()
    terms = len(words.dictionary)
    doc = np.repeat(np.arange(len(some)), held[some])
    entry, tf = np.unique(doc * terms + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, code = np.divmod(entry, terms)
    most = np.zeros(terms, np.int64)
    np.maximum.at(most, code, impacts(tf, held[some][doc], n_docs, n_words))
    return {
        "doc_ids": part.column(0).cast(pa.int64()).take(pa.array(some)), "n_terms": held[some], "first": np.searchsorted(doc, np.arange(len(some) + 1)), "codes": code, "tf": tf,
        "terms": words.dictionary.cast(pa.string()), "df": np.bincount(code, minlength=terms), "most": most,
    }


_LISTS = {"doc_ids": pa.int64(), "n_terms": pa.int64(), "first": pa.int32(), "codes": pa.int32(), "tf": pa.int32(), "terms": pa.string(), "df": pa.int32(), "most": pa.int64()}


def as_row(number: int, block: dict) -> pa.RecordBatch:
    def one(name: str) -> pa.Array:
        x = block[name] if isinstance(block[name], pa.Array) else pa.array(block[name].astype(_LISTS[name].to_pandas_dtype()))
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *map(one, _LISTS)], names=["block", *_LISTS])


def built(docs: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """The index (columns of INDEX) of all documents, for those statistics."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, BLOCK_BYTES):
                block = block_of(part, n_docs, n_words)
                if block:
                    yield as_row(number, block)
                    number += 1

    return texts(docs).mapInArrow(tidied(run), INDEX)


class Items:
    """A group of items: their terms as numbers in one vocabulary, and the weights."""

    def __init__(self, ids: list, rows: list[tuple[int, str]]):
        self.ids = ids
        self.vocabulary = sorted({t for _, t in rows})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        rows = sorted((i, number[t]) for i, t in rows)
        self.item = np.array([i for i, _ in rows], np.int64)
        self.term = np.array([t for _, t in rows], np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """Weights by document frequencies; terms in no document or without weight go, and items left without any."""
        w = np.zeros(len(self.vocabulary), np.int64)
        for t, d in df.items():
            w[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
        self.weight = w
        keep = w[self.term] > 0
        self.item, self.term = self.item[keep], self.term[keep]
        self.asked, self.first = np.unique(self.item, return_index=True)

    def bounds(self, greatest: np.ndarray) -> np.ndarray:
        """By asked item, the sum of weight times each term's greatest impact."""
        return np.add.reduceat(self.weight[self.term] * greatest[self.term], self.first)

    def terms(self, k: int) -> np.ndarray:
        return self.term[self.first[k] : self.first[k + 1] if k + 1 < len(self.first) else None]


class Block:
    """A row of the index as a group of items sees it."""

    def __init__(self, row: dict[str, pa.Array], vocabulary: pa.Array, n_terms: int):
        self.row = row
        self.number = pc.index_in(row["terms"], value_set=vocabulary)
        known = np.flatnonzero(self.number.is_valid().to_numpy(zero_copy_only=False))
        self.known, self.of = known, self.number.drop_null().to_numpy(zero_copy_only=False)
        self.greatest = np.zeros(n_terms, np.int64)
        self.greatest[self.of] = row["most"].to_numpy(zero_copy_only=False)[known]
        self.entries = None

    def load(self, n_docs: int, n_words: int) -> None:
        """The entries of asked terms: document, term and impact, in the order of documents."""
        codes, first = (self.row[c].to_numpy(zero_copy_only=False) for c in ("codes", "first"))
        number = np.full(len(self.number), -1, np.int64)
        number[self.known] = self.of
        term = number[codes]
        live = np.flatnonzero(term >= 0)
        doc = np.searchsorted(first, live, "right") - 1
        self.entries = doc, term[live], impacts(self.row["tf"].to_numpy(zero_copy_only=False)[live], self.row["n_terms"].to_numpy(zero_copy_only=False)[doc], n_docs, n_words)
        self.start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else doc
        ids = self.row["doc_ids"]
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)


class Ranker:
    """The best documents of every item over the blocks it is fed, in chunks."""

    def __init__(self, items: Items, n_docs: int, n_words: int, k: int, floor: np.ndarray):
        self.items, self.n_docs, self.n_words, self.k = items, n_docs, n_words, k
        self.floor = np.maximum(floor, 1)  #: by asked item, the least score of a result
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items.asked]
        self.weights = np.zeros(len(items.vocabulary), np.int64)
        self.seen = self.scored = 0

    def feed(self, blocks: list[Block]) -> None:
        bounds = np.stack([self.items.bounds(b.greatest) for b in blocks])
        self.seen += bounds.size
        for i in np.flatnonzero(bounds.max(axis=0) >= self.floor).tolist():
            terms = self.items.terms(i)
            self.weights[terms] = self.items.weight[terms]
            for b in np.argsort(-bounds[:, i], kind="stable").tolist():
                if bounds[b, i] < self.floor[i]:
                    break
                self.score(i, blocks[b])
            self.weights[terms] = 0

    def score(self, i: int, block: Block) -> None:
        self.scored += 1
        if block.entries is None:
            block.load(self.n_docs, self.n_words)
        doc, term, impact = block.entries
        if not len(doc):
            return
        score = np.add.reduceat(self.weights[term] * impact, block.start)
        good = np.flatnonzero(score >= self.floor[i])
        if not len(good):
            return
        where = doc[block.start[good]]
        found = [np.concatenate(x) for x in zip(self.best[i], (score[good], block.ids[where], block.null[where]))]
        if len(found[0]) >= self.k:
            top = np.lexsort((found[1], found[2], -found[0]))[: self.k]
            found = [x[top] for x in found]
            self.floor[i] = max(self.floor[i], found[0][-1])
        self.best[i] = tuple(found)

    def results(self) -> pa.RecordBatch:
        scores, ids, null = (np.concatenate([b[c] for b in self.best]) if self.best else np.zeros(0, np.int64) for c in range(3))
        item = np.repeat(self.items.asked, [len(b[0]) for b in self.best])
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
    lists = {n: batch.column(n) for n in batch.schema.names if n != "block"}
    for i in range(batch.num_rows):
        yield {n: c[i].values for n, c in lists.items()}


def _frequencies(index: DataFrame, items: Items) -> dict[int, int]:
    vocabulary = items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, asked = np.zeros(len(vocabulary), np.int64), pa.array(vocabulary, pa.string())
        for batch in batches:
            for row in _rows(batch):
                number = pc.index_in(row["terms"], value_set=asked)
                total[number.drop_null().to_numpy(zero_copy_only=False)] += row["df"].filter(number.is_valid()).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(total[some], pa.int64())})

    # no more rows than the group of items has terms
    return {r[0]: r[1] for r in index.select("terms", "df").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect()}


def _first_blocks(index: DataFrame, items: Items) -> DataFrame:
    """The numbers of the SEEDS blocks with the highest bounds of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(items.vocabulary, pa.string())
        bound, block = np.full((SEEDS, len(items.asked)), -1, np.int64), np.zeros((SEEDS, len(items.asked)), np.int64)
        for batch in batches:
            for number, row in zip(batch.column("block").to_pylist(), _rows(batch)):
                new = items.bounds(Block(row, asked, len(items.vocabulary)).greatest)
                low = bound.argmin(axis=0)
                at = np.flatnonzero(new > bound[low, np.arange(len(new))])
                bound[low[at], at], block[low[at], at] = new[at], number
        at = np.nonzero(bound > 0)
        yield pa.RecordBatch.from_pydict({"item": pa.array(at[1], pa.int64()), "block": pa.array(block[at], pa.int64()), "bound": pa.array(bound[at], pa.int64())})

    found = index.select("block", "terms", "most").mapInArrow(run, "item bigint, block bigint, bound bigint")
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SEEDS).select("block").distinct()


def _scored(index: DataFrame, items: Items, n_docs: int, n_words: int, k: int, floor: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker, chunk, asked = Ranker(items, n_docs, n_words, k, floor.copy()), [], pa.array(items.vocabulary, pa.string())
        for batch in batches:
            for row in _rows(batch):
                chunk.append(Block(row, asked, len(items.vocabulary)))
                if len(chunk) == CHUNK_BLOCKS:
                    ranker.feed(chunk)
                    chunk = []
        if chunk:
            ranker.feed(chunk)
        yield ranker.results()

    found = index.mapInArrow(tidied(run), "item bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, n_docs: int, n_words: int, k: int = 50) -> DataFrame:
    """The ``k`` best documents of every item (columns item_id, text): item_id, rank, doc_id, score."""
    spark = index.sparkSession
    small_batches(spark)
    asked = items.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    total = asked.count()
    groups = -(-total // GROUP_TERMS)
    out = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")]
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # about GROUP_TERMS rows
        ids = list(dict.fromkeys(r[0] for r in rows))
        number = {x: i for i, x in enumerate(ids)}
        group = Items(ids, [(number[r[0]], r[1]) for r in rows])
        group.weigh(_frequencies(index, group), n_docs)
        if not len(group.asked):
            continue
        first = index.join(F.broadcast(_first_blocks(index, group)), "block", "left_semi")  # SEEDS an item at most
        reached = _scored(first, group, n_docs, n_words, k, np.ones(len(group.asked), np.int64))
        least = {r[0]: r[1] for r in reached.groupBy("item").agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}  # a row an item
        floor = np.array([least.get(i, 1) for i in group.asked.tolist()], np.int64)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item bigint, item_id {kind}")
        out.append(_scored(index, group, n_docs, n_words, k, floor).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index all documents, write the index to the shared folder and search it for all items."""
    n_docs, n_words = statistics(docs)
    return search(materialize(built(docs, n_docs, n_words), "blocks", block_mb=8), items, n_docs, n_words, k)
