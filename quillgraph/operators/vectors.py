"""Exact cosine search with a confidence gate over vectors (id, embedding, subject, locator, text, sparse)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cosine
from ..functions.text import FOREIGN_TERMS, foreign_term

K, DEPTH = 8, 32
HARD, SOFT, MARGIN = 0.65, 0.55, 0.02
SKIP, COUNT = 1, 4
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096  #: rows of a block
USABLE = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
HELD, STRIPE = 64, 4  #: most blocks of queries, and of vectors, about, that meet in a cell
ASKED, MET = ("query_id", "asked", "asked_subject"), ("met_id", "met", "met_subject")  #: columns of a cell's sides, which may stem from one table
FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def search(vectors: DataFrame, query: Sequence[float], subject=None, k: int = K) -> DataFrame:
    """The k nearest, with similarity; ties by id. A subject filters first."""
    v = vectors if subject is None else vectors.where(F.col("subject") == subject)
    q = F.array(*(F.lit(float(x)) for x in query))
    return v.withColumn("similarity", cosine(F.col("embedding"), q)).where("similarity is not null").orderBy(F.desc("similarity"), "id").limit(k)


def batch_search(vectors: DataFrame, queries: DataFrame, k: int = DEPTH, exclude_self: bool = False, same_subject: bool = False) -> DataFrame:
    """query_id, id, similarity, rank of the k nearest of each query (query_id, embedding[, subject]).

    Groups of up to HELD blocks of queries meet stripes of up to STRIPE blocks of vectors, both by
    a hash of the id, in cells; a cell takes one matrix product of two blocks at a time and sends
    only its k nearest of each query to the ranking. So a vector moves once a group of queries, a
    query once a stripe. Rows without an embedding or with null or non-finite components find
    nothing and are not found; only vectors of one length meet.
    """
    more = ["subject"] if same_subject else []
    v, q = vectors.select("id", "embedding", *more).where(USABLE), queries.select("query_id", "embedding", *more).where(USABLE)
    groups, stripes = cells(q, q.count(), v.count(), HELD * QUERY_BLOCK, STRIPE * VECTOR_BLOCK)
    length = F.size("embedding").alias("length")
    asked = q.select(length, dealt("query_id", groups).alias("group"), every(stripes).alias("stripe"), *(F.col(c).alias(a) for c, a in zip(q.columns, ASKED)))
    rows = v.select(length, every(groups).alias("group"), dealt("id", stripes).alias("stripe"), *(F.col(c).alias(a) for c, a in zip(v.columns, MET)))
    n_asked, n_rows = QUERY_BLOCK, VECTOR_BLOCK

    def met(asked: pa.Table, rows: pa.Table) -> pa.Table:
        blocks = [Nearest(*columns(asked.slice(a, n_asked), ASKED), k, exclude_self) for a in range(0, asked.num_rows, n_asked)]
        for b in range(0, rows.num_rows if blocks else 0, n_rows):
            own = columns(rows.slice(b, n_rows), MET)
            for x in blocks:
                x.meet(*own)
        return pa.Table.from_batches([x.rows() for x in blocks], FOUND)

    key = ("length", "group", "stripe")
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(met, "query_id bigint, id bigint, similarity double")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cells(df: DataFrame, asked: int, rows: int, group: int, stripe: int) -> tuple[int, int]:
    """Groups of queries and stripes of vectors: of up to about so many rows, and with a cell for each core if that leaves blocks whole."""
    groups, blocks = max(1, -(-asked // group)), max(1, -(-rows // VECTOR_BLOCK))
    return groups, max(1, -(-rows // stripe), min(blocks, -(-df.sparkSession.sparkContext.defaultParallelism // groups)))


def dealt(by: str, n: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int")


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def columns(cell: pa.Table, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, unit rows and, where there is one, the subjects of a cell's rows."""
    ids, embedding, *subject = (cell.column(c).combine_chunks() for c in names if c in cell.column_names)
    return ids.to_numpy(zero_copy_only=False), matrix(embedding), subject[0].to_numpy(zero_copy_only=False) if subject else None


def matrix(lists: pa.Array) -> np.ndarray:
    """Unit rows of equally long lists; zeros stay."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Nearest:
    """The k nearest of a block of queries over the blocks of vectors it meets."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, subjects: np.ndarray | None, k: int, exclude_self: bool):
        self.ids, self.q, self.subjects = ids, q, subjects
        self.k, self.exclude_self = k, exclude_self
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # place of the query, id, similarity
        self.edge = np.full(len(ids), -np.inf)  # what a vector must reach; ties are settled by id

    def meet(self, own: np.ndarray, x: np.ndarray, subjects: np.ndarray | None) -> None:
        s = self.q @ x.T
        if self.exclude_self:
            s[self.ids[:, None] == own[None, :]] = -np.inf
        if self.subjects is not None:
            s[self.subjects[:, None] != subjects[None, :]] = -np.inf
        edge = self.edge
        if np.isneginf(edge).all() and len(own) > self.k:
            edge = np.partition(s, len(own) - self.k, axis=1)[:, len(own) - self.k] - 2e-12
        row, at = np.nonzero(s >= np.maximum(edge, -2)[:, None])
        if not len(row):
            return
        place, ids, sim = (np.concatenate(p) for p in zip(self.best, (row, own[at], s[row, at])))
        order = np.lexsort((ids, -np.round(sim, 12), place))
        place = place[order]
        n = np.arange(len(place)) - np.searchsorted(place, place)
        keep = order[n < self.k]
        self.best = (place[n < self.k], ids[keep], sim[keep])
        self.edge[place[n == self.k - 1]] = sim[order[n == self.k - 1]] - 2e-12

    def rows(self) -> pa.RecordBatch:
        place, ids, sim = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[place], pa.int64()), pa.array(ids, pa.int64()), pa.array(sim, pa.float64())], schema=FOUND)


def tops(hits: DataFrame) -> DataFrame:
    """Of ranked hits (query_id, id, similarity, rank, sparse): the first that is not sparse, and its lead over the next such.

    A query whose hits are all sparse has a null top; the margin is null without a second one.
    """
    n = hits.where("not sparse")
    order = Window.partitionBy("query_id").orderBy("rank")
    first = n.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("similarity").over(order)).where("n = 1")
    top = first.select("query_id", F.col("id").alias("top_id"), F.col("rank").alias("top_rank"), F.col("similarity").alias("top_similarity"), (F.col("similarity") - F.col("next")).alias("margin"))
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits")).join(top, "query_id", "left")


def gated(queries: DataFrame, found: DataFrame, hard: float = HARD, soft: float = SOFT, margin: float = MARGIN, terms: tuple[str, ...] = FOREIGN_TERMS) -> DataFrame:
    """Decision and reason for each query (query_id, text): a foreign phrase vetoes before anything else."""
    q = queries.select("query_id", foreign_term(F.col("text"), terms).alias("term")).join(found, "query_id", "left")
    s, m = F.col("top_similarity"), F.col("margin")
    reason = F.when(F.col("term").isNotNull(), "out_of_domain").when(F.coalesce("n_hits", F.lit(0)) == 0, "no_passages").when(F.col("top_id").isNull(), "only_sparse").when(s >= hard, "hard").when((s >= soft) & F.coalesce(m >= margin, F.lit(False)), "soft").otherwise("below_floor")
    return q.withColumn("reason", reason).withColumn("accepted", F.col("reason").isin("hard", "soft"))


def neighbours(hits: DataFrame, found: DataFrame, window: int = K, skip: int = SKIP, count: int = COUNT) -> DataFrame:
    """Of the first ``window`` hits without the source: ``count`` after skipping ``skip``."""
    near = hits.where(F.col("rank") <= window).join(found.select("query_id", "top_id"), "query_id").where(F.col("top_id").isNull() | (F.col("id") != F.col("top_id")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.withColumn("place", place - skip).where((F.col("place") >= 1) & (F.col("place") <= count)).drop("top_id")


def hit_rate(hits: DataFrame, expected: DataFrame, k: int = K) -> DataFrame:
    """located for each query (query_id, expect_locator): the expected locator is part of one of the first k, in any case."""
    h = hits.where(F.col("rank") <= k).select("query_id", F.lower("locator").alias("l"))
    e = expected.where("expect_locator is not null").select("query_id", F.lower("expect_locator").alias("e"))
    return e.join(h, "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(F.contains("l", "e")), F.lit(False)).alias("located"))
