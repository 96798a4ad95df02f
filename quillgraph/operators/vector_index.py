"""An inverted file of vectors with residual codes and exact re-ranking.

Centroids are fitted on a bounded sample of unit vectors. Every vector goes to the list of its
nearest centroid; what is left of it (the residual) is cut into subspaces and coded by the
nearest of a few codewords in each. A list lies in blocks of about BLOCK vectors, codes and full
vectors in columns of their own, sorted by list.

A search looks at the lists of a query's ``probes`` nearest centroids. Groups of queries meet
large stripes of codes there, and a task keeps the best ``rerank`` of each query by what the
codes stand for; these are then ranked by their full vectors, groups of queries by stripes of
vectors. Both numbers are set by trial searches (``calibrated``) for a wanted recall. With ``exact`` every list
is searched with full vectors.

Defined results: rows without a vector, with null or non-finite components or of another
length than the first are not in the index; a zero vector has similarity 0. Equal similarities
are ranked by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vec

SAMPLE = 20_000  #: most vectors that centroids and codewords are fitted on
LISTS = 4096  #: most lists
CODES, WIDTH = 64, 4  #: codewords of a subspace, dimensions of a subspace
BLOCK = 4096  #: vectors of a block, about
ROUNDS = 12
TRIALS, MOST_RERANKED = 200, 4096
ASKED, LEAST_ASKED, CODED = 1024, 64, 1 << 20  #: most queries, queries at which more cells stop to help, and most codes, about, of a cell
PAIRS, PRODUCTS = 1 << 22, 1 << 14  #: pairs to rank in a cell, about; products at once
NEAR = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("about", pa.float64()), ("n", pa.int32())])
BLOCKS = "list int, block bigint, ids array<bigint>, codes binary, vectors array<array<float>>"


def _means(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Centres of ``n`` clusters by Lloyd's rounds from distinct rows; a cluster that runs empty takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:n]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        total, count = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-((x - centres[near]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


@dataclass
class Quantizer:
    """Centroids of the lists and codewords of the residuals' subspaces."""

    centroids: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def fitted(cls, x: np.ndarray, lists: int, seed: int = 1) -> Quantizer:
        centroids = _means(x, lists, seed)
        rest = x - centroids[_nearest(x, centroids)]
        return cls(centroids, [_means(rest[:, a : a + WIDTH], CODES, seed + a) for a in range(0, x.shape[1], WIDTH)])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row."""
        near = _nearest(x, self.centroids)
        rest = x - self.centroids[near]
        return near, np.stack([_nearest(rest[:, WIDTH * i : WIDTH * (i + 1)], w) for i, w in enumerate(self.words)], axis=1).astype(np.uint8)

    def decoded(self, number: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of a list stand for: about its unit vectors."""
        return self.centroids[number] + np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)


class Few:
    """The ``keep`` greatest of each query's similarities, which come in the order of the vectors; of equal ones the first."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.edge = keep, np.full(queries, -np.inf)
        self.parts, self.n = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, queries: np.ndarray, first: int, s: np.ndarray) -> None:
        row, at = np.nonzero(s > self.edge[queries][:, None])
        self.parts.append((queries[row].astype(np.int32), first + at, s[row, at]))
        self.n += len(row)
        if self.n > 2 * self.keep * len(self.edge) + (1 << 20):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at, s = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(row, kind="stable")
        ends, kept = np.searchsorted(row[order], np.arange(len(self.edge) + 1)), []
        for i in range(len(self.edge)):
            own = order[ends[i] : ends[i + 1]]
            if len(own) > self.keep:
                x = s[own]
                self.edge[i] = least = np.partition(x, len(x) - self.keep)[len(x) - self.keep]
                above = np.flatnonzero(x > least)
                own = own[np.sort(np.concatenate([above, np.flatnonzero(x == least)[: self.keep - len(above)]]))]
            kept.append(own)
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.parts, self.n = [(row[kept], at[kept], s[kept])], len(kept)
        return self.parts[0]

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector, similarity and rank from 1."""
        row, at, s = self.cut()
        order = np.lexsort((at, -s, row))
        row = row[order]
        return row, at[order], s[order], np.arange(len(row)) - np.searchsorted(row, row) + 1


class VectorIndex:
    """``blocks`` (columns of BLOCKS) with the quantizer they were coded by."""

    def __init__(self, quantizer: Quantizer, blocks: DataFrame):
        self.quantizer, self.blocks = quantizer, blocks
        self.probes, self.rerank = 16, 64

    @classmethod
    def built(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Index the rows (id, embedding) and write the blocks to ``path``; by default as many lists as the root of the rows."""
        good = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding")).where(vec.USABLE)
        n = good.count()
        part = min(1.0, SAMPLE / max(n, 1))
        order = F.xxhash64("id", F.lit("sample"))
        sample = good.where(F.pmod(order, F.lit(1_000_000)) < part * 1_000_000).orderBy(order).limit(2 * SAMPLE).select("embedding").toArrow().column(0)
        if not len(sample):
            return cls(Quantizer(np.zeros((0, 1)), []), vectors.sparkSession.createDataFrame([], BLOCKS))
        d = len(sample[0])
        fit = vec.matrix(pa.array([x for x in sample.to_pylist() if len(x) == d], pa.list_(pa.float32())))
        q = Quantizer.fitted(fit, min(lists or max(1, round(n**0.5)), LISTS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near, codes = q.coded(vec.matrix(b.column(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["list", "id", "code", "embedding"])

        coded = good.where(F.size("embedding") == d).mapInArrow(run, "list int, id bigint, code binary, embedding array<float>")
        # the vectors of a crowded list fall into several blocks, so no task gets a whole one
        blocks = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK))))).groupBy("list", "block").agg(F.array_sort(F.collect_list(F.struct("id", "code", "embedding"))).alias("x"))
        flat = blocks.select("list", "block", F.col("x.id").alias("ids"), F.unhex(F.array_join(F.transform("x", lambda r: F.hex(r["code"])), "")).alias("codes"), F.col("x.embedding").alias("vectors"))
        flat.repartitionByRange("list", "block").sortWithinPartitions("list", "block").write.mode("overwrite").option("compression", "zstd").parquet(path)
        return cls(q, vectors.sparkSession.read.schema(BLOCKS).parquet(path))

    def calibrated(self, target: float = 0.95, k: int = vec.K, trials: int = TRIALS) -> VectorIndex:
        """Set ``probes`` and ``rerank`` so that ``trials`` of the index's own vectors find that part of their ``k`` nearest.

        The lists of their exact nearest tell how many lists must be probed; then ``rerank``
        doubles until the searches reach the target.
        """
        rows = self.blocks.select("list", F.explode(F.arrays_zip("ids", "vectors")).alias("x")).select("list", F.col("x.ids").alias("id"), F.col("x.vectors").alias("embedding"))
        asked = rows.orderBy(F.xxhash64("id", F.lit("trial"))).limit(trials).select(F.col("id").alias("query_id"), "embedding").toArrow()
        if not asked.num_rows:
            return self
        q = self.blocks.sparkSession.createDataFrame(asked)
        right = self.search(q, k, exact=True, exclude_self=True).select("query_id", "id").toArrow()  # trials times k rows
        right = self.blocks.sparkSession.createDataFrame(right)
        place = F.posexplode(F.arrays_zip("ids", "vectors")).alias("at", "x")
        places = self.blocks.select("list", "block", place).select("list", "block", "at", F.col("x.ids").alias("id"))
        right = right.join(places.join(F.broadcast(right.select("id").distinct()), "id", "left_semi"), "id").select("query_id", "list", "block", "at").toArrow()
        if not right.num_rows:
            return self
        near = vec.matrix(asked.column(1).combine_chunks()) @ self.quantizer.centroids.T
        place = dict(zip(asked.column(0).to_pylist(), np.argsort(np.argsort(-near, axis=1), axis=1)))
        ranks = np.sort([place[r["query_id"]][r["list"]] for r in right.to_pylist()])
        self.probes = int(ranks[min(len(ranks) - 1, int(len(ranks) * (1 + target) / 2))]) + 1
        # a vector is found if it is among the first by codes, so one search tells what any number of them would find
        few = self._by_codes(self._usable(q), asked.num_rows, self.probes, MOST_RERANKED, exclude_self=True)
        wanted = self.blocks.sparkSession.createDataFrame(right)
        seen = wanted.join(few, ["query_id", "list", "block", "at"], "left").select("query_id", "n").toArrow()
        query, n = seen.column(0).to_numpy(), np.array([x or MOST_RERANKED + 1 for x in seen.column(1).to_pylist()])
        share = 1 / np.unique(query, return_counts=True)[1][np.unique(query, return_inverse=True)[1]]
        while self.rerank < MOST_RERANKED and share[n <= self.rerank].sum() * k < target * len(n):
            self.rerank *= 2
        return self

    def search(self, queries: DataFrame, k: int = vec.K, probes: int | None = None, rerank: int | None = None, exact: bool = False, exclude_self: bool = False) -> DataFrame:
        """query_id, id, similarity, rank of the k nearest found for each query (query_id, embedding)."""
        if exact or not len(self.quantizer.centroids):
            rows = self.blocks.select(F.explode(F.arrays_zip("ids", "vectors")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.vectors").alias("embedding"))
            return vec.batch_search(rows, queries, k, exclude_self)
        q, k_found, rerank = self._usable(queries), k, rerank or self.rerank
        n, stripe = q.count(), vec.STRIPE * vec.VECTOR_BLOCK
        held = min(vec.HELD * vec.QUERY_BLOCK, max(vec.QUERY_BLOCK, PAIRS * max(1, self.size // stripe) // rerank))
        groups, stripes = vec.cells(q, n, self.size, held, stripe)
        group, own = vec.dealt("query_id", groups).alias("group"), F.pmod(F.xxhash64("list", "block"), F.lit(stripes)).cast("int").alias("stripe")
        of_query = q.select(group, vec.every(stripes).alias("stripe"), "query_id", "embedding", F.lit(None).cast("int").alias("list"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("int").alias("at"))
        of_pair = self._by_codes(q, n, probes or self.probes, rerank, exclude_self).select(group, own, "query_id", F.lit(None).cast("array<double>").alias("embedding"), "list", "block", "at")
        rows = self.blocks.select(vec.every(groups).alias("group"), own, "list", "block", "ids", "vectors")

        def met(asked: pa.Table, rows: pa.Table) -> pa.Table:
            is_query = pc.is_valid(asked.column("embedding"))
            queries, pairs = asked.filter(is_query), asked.filter(pc.invert(is_query))
            if not pairs.num_rows:
                return vec.FOUND.empty_table()
            of, x = queries.column("query_id").to_numpy(), vec.matrix(queries.column("embedding").combine_chunks())
            lists = rows.column("ids").combine_chunks()
            ids, y, size = lists.flatten().to_numpy(), vec.matrix(rows.column("vectors").combine_chunks().flatten()), pc.list_value_length(lists).to_numpy()
            i, j = _found(of, pairs.column("query_id").to_numpy()), (np.cumsum(size) - size)[_found(_keys(rows), _keys(pairs))] + pairs.column("at").to_numpy()
            s = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + PRODUCTS]], y[j[a : a + PRODUCTS]]) for a in range(0, len(i), PRODUCTS)])
            order = np.lexsort((ids[j], -np.round(s, 12), i))
            keep = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k_found]
            return pa.table([of[i[keep]], ids[j[keep]], s[keep]], schema=vec.FOUND)

        found = of_query.unionByName(of_pair).groupBy("group", "stripe").cogroup(rows.groupBy("group", "stripe")).applyInArrow(met, "query_id bigint, id bigint, similarity double")
        return vec.ranked(found, k)

    @cached_property
    def size(self) -> int:
        return self.blocks.agg(F.sum(F.size("ids"))).first()[0] or 0

    def _usable(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(vec.USABLE).where(F.size("embedding") == self.quantizer.centroids.shape[1])

    def _by_codes(self, q: DataFrame, n: int, probes: int, rerank: int, exclude_self: bool) -> DataFrame:
        """query_id, list, block, at and rank n of the ``rerank`` nearest by their codes in the probed lists.

        Groups of queries meet stripes of codes in cells, and a cell sends only what can be among them.
        """
        quantizer, probes = self.quantizer, min(probes, len(self.quantizer.centroids))
        groups, stripes = max(-(-n // ASKED), min(-(-n // LEAST_ASKED), q.sparkSession.sparkContext.defaultParallelism), 1), max(1, -(-self.size // CODED))
        asked = q.select(vec.dealt("query_id", groups).alias("group"), vec.every(stripes).alias("stripe"), "query_id", "embedding")
        # only ids and codes are read here
        rows = self.blocks.select(vec.every(groups).alias("group"), F.pmod(F.xxhash64("list", "block"), F.lit(stripes)).cast("int").alias("stripe"), "list", "block", "ids", "codes")
        n_asked, n_rows = vec.QUERY_BLOCK, vec.VECTOR_BLOCK

        def met(asked: pa.Table, rows: pa.Table) -> pa.Table:
            if not asked.num_rows or not rows.num_rows:
                return NEAR.empty_table()
            rows = rows.take(pc.sort_indices(rows.select(["list", "block"]), [("list", "ascending"), ("block", "ascending")]))
            lists = rows.column("ids").combine_chunks()
            own, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            of = np.repeat(np.arange(len(size)), size)
            at, block, number = np.arange(len(own)) - (np.cumsum(size) - size)[of], rows.column("block").to_numpy()[of], rows.column("list").to_numpy()[of]
            ends, out = np.searchsorted(number, np.arange(len(quantizer.centroids) + 1)), []
            for a in range(0, asked.num_rows, n_asked):
                _, _, query_id, embedding = (c.combine_chunks() for c in asked.slice(a, n_asked).columns)
                query_id, x = query_id.to_numpy(), vec.matrix(embedding)
                probed = np.zeros((len(x), len(quantizer.centroids)), bool)
                np.put_along_axis(probed, np.argpartition(-(x @ quantizer.centroids.T), probes - 1, axis=1)[:, :probes], True, axis=1)
                few = Few(len(x), rerank)
                for i in np.flatnonzero(probed.any(axis=0) & (ends[1:] > ends[:-1])):
                    some = np.flatnonzero(probed[:, i])
                    for b in range(ends[i], ends[i + 1], n_rows):
                        to = min(b + n_rows, ends[i + 1])
                        s = x[some] @ quantizer.decoded(i, codes[b:to]).T
                        if exclude_self:
                            s[query_id[some][:, None] == own[None, b:to]] = -np.inf
                        few.add(some, b, s)
                row, v, s, n = few.ranked()
                out.append(pa.RecordBatch.from_arrays([pa.array(query_id[row]), pa.array(number[v], pa.int32()), pa.array(block[v]), pa.array(at[v], pa.int32()), pa.array(s), pa.array(n, pa.int32())], schema=NEAR))
            return pa.Table.from_batches(out)

        near = asked.groupBy("group", "stripe").cogroup(rows.groupBy("group", "stripe")).applyInArrow(met, "query_id bigint, list int, block bigint, at int, about double, n int")
        if stripes > 1:
            order = Window.partitionBy("query_id").orderBy(F.desc("about"), "list", "block", "at")
            near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rerank)
        return near.drop("about")


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted ones among different keys, which hold them all."""
    order = np.argsort(keys, kind="stable")
    return order[np.searchsorted(keys[order], wanted)]


def _keys(blocks: pa.Table) -> np.ndarray:
    return (blocks.column("list").to_numpy().astype(np.int64) << 40) + blocks.column("block").to_numpy()


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and recall: the part of each query's exact results that were found."""
    right = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return right.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
