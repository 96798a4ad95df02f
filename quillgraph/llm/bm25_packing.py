"""Packing into fixed windows by lexical retrieval.

Every document's ids are cut into full windows and a remainder. Remainders are what needs
packing: they are dealt into shards in the order of a weighted MinHash sketch of their
vocabulary, so texts that share telling words tend to meet, and each shard holds an inverted index with BM25 weights.
Document frequencies and the mean length are those of all remainders. The next unused
remainder seeds a window; its best-scoring unused neighbours fill the rest greedily, the
last of them cut to fit, and what is left of it stays in the index. At the end of a shard
the open window is cut into sequences whose lengths are powers of two, which need no padding.

The sketch of a remainder is the first four of its terms in one random order of all terms,
in which a term comes early in proportion to its inverse document frequency; those that most
remainders hold come last, so they decide nothing. Neighbours are those of the own shard
only; what that loses against one index of all remainders is measured in the tests and
stated in the README.

A shard has a bounded number of remainders, so the index of one task stays small however
common a word or a text is. Terms are token ids, so the table of document frequencies is
bounded by the vocabulary.

Defined results: a null text is empty and consists of the end id; every row is packed, also
with a null or repeated doc_id. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, parallelism, small_batches, texts, tidied
from .tokens import default_vocabulary, encoder

SHARD = 1024  #: remainders in an index
SKETCH = 4
PART_BYTES = 16 << 20  #: of remainders in a partition
K1, B = 1.2, 0.75


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def remainders(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, the checksums of its full windows and the ids behind them.

    At its end each task adds rows with the number of remainders that hold each term.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary()), ("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen = np.zeros(vocabulary_size(path, end_id), np.int64)
        for batch in batches:
            rows = []
            for ids in enc.encode(batch.column(1).to_pylist()):
                ids = np.append(ids, np.array([end_id], enc.dtype))
                full = len(ids) // window
                tail = ids[full * window :]
                seen[np.unique(tail)] += 1
                rows.append((len(ids), [crc(ids[k * window : (k + 1) * window]) for k in range(full)], tail.tobytes()))
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate([schema.field(j) for j in (1, 2, 3)])), none.cast(pa.int32()), none.cast(pa.int64())], schema=schema)
        terms = np.flatnonzero(seen)
        if len(terms):
            none = pa.nulls(len(terms))
            yield pa.RecordBatch.from_arrays([none.cast(f.type) for f in list(schema)[:4]] + [pa.array(terms, pa.int32()), pa.array(seen[terms])], schema=schema)

    return texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id bigint, doc_tokens bigint, crcs array<bigint>, tail binary, term int, n bigint")


def vocabulary_size(path: str, end_id: int) -> int:
    return max(encoder(path).library.get_vocab_size(), end_id + 1)


def term_ranks(idf: np.ndarray) -> np.ndarray:
    """Each term's place in a fixed random order, early in proportion to its weight; those without one share the last place."""
    u = (mix64(np.arange(1, len(idf) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
    arrival = np.where(idf > 0, -np.log(np.maximum(u, 1e-300)) / np.maximum(idf, 1e-12), np.inf)
    ranks = np.empty(len(idf), np.int32)
    ranks[np.argsort(arrival, kind="stable")] = np.arange(len(idf), dtype=np.int32)
    ranks[~np.isfinite(arrival)] = len(idf)
    return ranks


def sketches(tails: list[np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """The first SKETCH distinct places of each remainder's terms, a row each; all hold at least the end id."""
    start = np.concatenate(([0], np.cumsum([len(t) for t in tails])))[:-1].astype(np.int64)
    found, row = ranks[np.concatenate(tails).astype(np.int64)], np.repeat(np.arange(len(tails)), [len(t) for t in tails])
    out = np.empty((len(tails), SKETCH), np.int32)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat(found, start)
        found = np.where(found == out[row, k], len(ranks) + 1, found)
    return out


class Index:
    """BM25 over one shard; a cut remainder keeps its place."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        length = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(self.n), length)
        flat = np.concatenate(tails).astype(np.int64) if self.n else np.zeros(0, np.int64)
        useful = idf[flat] > 0  # a term in over half of all remainders weighs nothing
        key, times = np.unique(flat[useful] * self.n + doc[useful], return_counts=True)
        self.term, self.doc = key // self.n, key % self.n
        weight = idf[self.term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[self.doc] / mean))
        self.weight = weight.astype(np.float32)
        # postings of a term lie together; of a document, its terms' places
        self.first = np.concatenate(([True], self.term[1:] != self.term[:-1])) if len(key) else np.zeros(0, bool)
        self.start = np.flatnonzero(self.first)
        self.size = np.diff(np.append(self.start, len(key)))
        place = np.cumsum(self.first) - 1
        by = np.argsort(self.doc, kind="stable")
        self.places, self.edge = place[by], np.searchsorted(self.doc[by], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Each remainder's BM25 score for the seed's distinct terms as the query."""
        terms = self.places[self.edge[seed] : self.edge[seed + 1]]
        size = self.size[terms]
        total = int(size.sum())
        at = np.repeat(self.start[terms] - (np.cumsum(size) - size), size) + np.arange(total)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def pack(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (remainder, first id, ids): full windows, then the powers of two that are left."""
    index = Index(tails, idf, mean)
    length = np.array([len(t) for t in tails], np.int64)
    used = np.zeros(len(tails), np.int64)
    out, seed = [], 0
    open_ = length > 0
    while True:
        while seed < len(tails) and not open_[seed]:
            seed += 1
        if seed == len(tails):
            return out
        sequence, room = [], window

        def take(k: int) -> None:
            nonlocal room
            n = min(room, int(length[k] - used[k]))
            sequence.append((k, int(used[k]), n))
            used[k] += n
            room -= n
            open_[k] = used[k] < length[k]

        take(seed)
        if room:
            score = np.where(open_, index.scores(seed), -1.0)
            # neighbours by score, ties and those without a common term by place
            few = min(len(score), 32)
            best = np.argpartition(-score, few - 1)[:few] if few < len(score) else np.arange(len(score))
            for k in best[np.lexsort((best, -score[best]))].tolist():
                if room and open_[k] and score[k] > 0:
                    take(k)
            if room:
                for k in np.lexsort((np.arange(len(score)), -score)).tolist():
                    if not room:
                        break
                    if open_[k]:
                        take(k)
        if not room:
            out.append(sequence)
            continue
        size = window  # the shard is used up
        while sequence:
            size //= 2
            if sum(n for *_, n in sequence) >= size:
                part, need = [], size
                while need:
                    k, at, n = sequence.pop(0)
                    part.append((k, at, min(n, need)))
                    if n > need:
                        sequence.insert(0, (k, at + need, n - need))
                    need -= part[-1][2]
                out.append(part)


def packed(docs: DataFrame, vocabulary: str | None = None, window: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``keep_ids`` a column ids (null for full windows, which are their document's ids
    from start on).
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(remainders(docs, path, window, end_id), "remainders")
    # at most one row for each id of the vocabulary
    counts = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n, mean = rows.where("term is null").agg(F.count("*"), F.avg(F.length("tail"))).first()
    wide = encoder(path).dtype.itemsize
    frequency = np.zeros(vocabulary_size(path, end_id))
    frequency[counts["term"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    idf = np.where(frequency > 0, np.maximum(np.log((n - frequency + 0.5) / (frequency + 0.5)), 0), 0)
    mean, ranks = (mean or wide) / wide, term_ranks(idf)
    kinds = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary()), *((f"k{i}", pa.int32()) for i in range(SKETCH))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tails = [np.frombuffer(t, f"<u{wide}") for t in batch.column(3).to_pylist()]
                # a text that fills its windows exactly leaves no ids and goes last
                some = np.array([len(t) > 0 for t in tails])
                keys = np.full((len(tails), SKETCH), len(ranks) + 1, np.int32)
                if some.any():
                    keys[some] = sketches([t for t in tails if len(t)], ranks)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(keys[:, i])) for i in range(SKETCH))], schema=kinds)

    keys = [f"k{i}" for i in range(SKETCH)]
    parts = max(parallelism(spark), int(mean * wide * n) // PART_BYTES)
    placed = rows.where("term is null").drop("term", "n").mapInArrow(tidied(place), "doc_id bigint, doc_tokens bigint, crcs array<bigint>, tail binary, " + ", ".join(f"{k} int" for k in keys))
    tie = F.xxhash64("doc_id", "tail")
    dealt = placed.repartitionByRange(parts, *keys, tie).sortWithinPartitions(*keys, tie, "doc_id").drop(*keys)
    fields = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int64()))] * keep_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, group = TaskContext.get().partitionId() << 40, 0, []

        def out() -> pa.RecordBatch:
            nonlocal number
            found: list[tuple] = []
            for doc, tokens, crcs, _ in group:
                for k, c in enumerate(crcs):
                    found.append((doc, k * window, window, c, tokens, base + number, 0, None))
                    number += 1
            tails = [np.frombuffer(g[3], f"<u{wide}") for g in group]
            for sequence in pack(tails, idf, mean, window):
                at = 0
                for k, first, size in sequence:
                    doc, tokens, crcs, _ = group[k]
                    ids = tails[k][first : first + size]
                    found.append((doc, len(crcs) * window + first, size, crc(ids), tokens, base + number, at, ids.tolist() if keep_ids else None))
                    at += size
                number += 1
            group.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                group.append(row)
                if len(group) == SHARD:
                    yield out()
        if group:
            yield out()

    return dealt.mapInArrow(tidied(run), ", ".join(f"{c} bigint" for c, _ in fields[:7]) + ", ids array<bigint>" * keep_ids)
