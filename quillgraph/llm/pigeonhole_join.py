"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c have a squared distance of at most t = 2 - 2c. They are rotated
onto their principal axes and split into low-dimensional blocks; each block gets the part of
t that is proportional to its dimensions. If every block's squared distance were above its
budget, the sum would be above t, so each pair that is sought is within budget in some
block. Each block is range-joined on its own: its two strongest axes are cut into cells as
wide as the block's radius, and a vector meets those of its own cell and the eight around
it. Candidates are verified by the cosine in double precision; of the blocks that offer a
pair only the first counts it. The axes are those of a sample of bounded size; any rotation
gives the same pairs, a fitting one fewer candidates.

Rows are told apart by a number of their own, never by vec_id. Equal vectors of one label
become one node with a multiplicity. Large cells are cut into
tiles that meet pairwise, whatever their size; a meeting returns counts and a spanning
forest of its links, never the pairs, so what is sent grows with the vectors only.

Defined results: a vector that is null, empty, zero or holds null or non-finite components
links with nothing, and so does any with a null label; vectors of different lengths don't
link; equal rows link with each other, also those with one vec_id; rows with a null vec_id have a null component, link
with nothing and are not kept. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forest, keyed_join, materialize, runs, small_batches, tidied

BLOCK, TILE = 8, 1024  #: dimensions of a block; vectors of a tile
SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20  #: most vectors, and bytes of them, that the axes are taken from
#: Steps to the cells that a cell meets as the first of two; the cells the other way meet it.
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))
SLACK = 1e-6  #: for rounding, on squared distances of unit vectors


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f4").reshape(len(blobs), -1).astype(np.float64) if blobs else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Principal axes of at most SAMPLE vectors, those first by a hash, strongest first, in columns."""
    few = max(min(SAMPLE, SAMPLE_BYTES // (4 * size)), 1)
    x = unit(matrix([r.v for r in vectors.select("v").orderBy(F.xxhash64("v")).limit(few).collect()]))
    _, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1])


def blocks_of(size: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]


def meetings(a: np.ndarray, b: np.ndarray | None, block: int, axes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of a, rows of b) that this block is the first to offer, with cosine >= ``least``. b None: a with itself."""
    size = a.shape[1]
    spans = blocks_of(size)
    budget = np.array([(2 - 2 * least) * (z - s) / size for s, z in spans]) + SLACK
    # the cosine as dot / (|a| |b|); unit vectors serve only to find candidates
    ua, other = unit(a), a if b is None else b
    ub = ua if b is None else unit(b)
    ra, rb = ua @ axes, ub @ axes
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(other, axis=1)
    s, z = spans[block]
    for i in range(0, len(a), 256):
        x = ra[i : i + 256, s:z]
        d = (x * x).sum(axis=1)[:, None] + (rb[:, s:z] ** 2).sum(axis=1)[None, :] - 2 * (x @ rb[:, s:z].T)
        u, v = np.nonzero(d <= budget[block])
        u += i
        if b is None:
            u, v = u[u < v], v[u < v]
        for k in range(0, len(u), 1 << 16):
            p, q = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
            for e in range(block):  # an earlier block offers it
                w, y = spans[e]
                late = ((ra[p, w:y] - rb[q, w:y]) ** 2).sum(axis=1) > budget[e]
                p, q = p[late], q[late]
            ok = np.einsum("ij,ij->i", a[p], other[q]) / (na[p] * nb[q]) >= least
            if ok.any():
                yield p[ok], q[ok]


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row a vector (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    small_batches(spark, 4)
    v = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e"), F.col("label").cast("string").alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~bad & F.exists("e", lambda x: x != 0), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.array(x, "<f4").tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary()), b.column(3)], names=["row", "vec_id", "v", "label"])

    rows = materialize(v.where(usable).mapInArrow(tidied(run), "row bigint, vec_id bigint, v binary, label string"), "vectors")
    classes = materialize(rows.groupBy("label", "v").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("n")), "nodes")
    sizes = [r.n for r in classes.select((F.length("v") / 4).cast("int").alias("n")).distinct().collect()]
    found = None
    for size in sorted(sizes):  # one, as a rule
        own = classes.where(F.length("v") == 4 * size)
        part = _links(own, size, rotation(own, size), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        known = classes.select("label", "v", "n", F.lit(0).cast("bigint").alias("links"), F.col("least").alias("component_id"))
    else:
        found = materialize(found, "met")
        counts = found.where("up is null").groupBy("node").agg(F.sum("links").alias("links"))
        comp = components(found.where("up is not null").select(F.col("node").alias("a"), F.col("up").alias("b")), "joined")
        named = materialize(classes.join(counts, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
        tops = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "tops")
        known = keyed_join(named, tops, ["component"], "nodes").select("label", "v", "n", F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    known = materialize(known.withColumn("same", F.col("n")), "known")
    linked = keyed_join(rows, known, ["label", "v"], "same").select("vec_id", (F.col("links") + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, size: int, axes: np.ndarray, least: float) -> DataFrame:
    """Rows (node, links, up): with up null, links to other nodes by members; else a link of a spanning forest."""
    spans = blocks_of(size)
    width = [((2 - 2 * least) * (z - s) / size + SLACK) ** 0.5 for s, z in spans]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = unit(matrix(b.column(0).to_pylist())) @ axes
            at = np.stack([np.floor(r[:, min(s + k, z - 1)] / w) * (s + k < z) for (s, z), w in zip(spans, width) for k in (0, 1)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), b.column(3), b.column(0), lists], names=["label", "node", "n", "v", "cells"])

    dealt = classes.select("v", "node", "label", "n").mapInArrow(tidied(cells), "label string, node bigint, n bigint, v binary, cells array<int>")
    dealt = materialize(dealt, "cells")
    place = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(spans) - 1)), lambda k: F.struct(F.element_at("cells", 2 * k + 1).alias("x"), F.element_at("cells", 2 * k + 2).alias("y")))).alias("block", "cell")
    key = ["label", "block", "x", "y"]
    # tiles of a cell by its number of nodes
    tiles = dealt.select("label", place).select("label", "block", "cell.*").groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("t"))
    tiles = materialize(tiles, "tiles")
    around = F.array(*(F.struct(F.lit(s * dx).alias("dx"), F.lit(s * dy).alias("dy"), F.lit(k + 1).alias("step"), F.lit(0 if s > 0 else 1).alias("side")) for s in (1, -1) for k, (dx, dy) in enumerate(FORWARD)))
    asked = tiles.select("label", "block", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(around).alias("a")).select("label", "block", "ox", "oy", (F.col("ox") + F.col("a.dx")).alias("x"), (F.col("oy") + F.col("a.dy")).alias("y"), "a.step", "a.side")
    # at most eight others a cell
    near = asked.join(tiles, key).groupBy("label", "block", F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.collect_list(F.struct(F.when(F.col("side") == 0, F.col("ox")).otherwise(F.col("x")).alias("cx"), F.when(F.col("side") == 0, F.col("oy")).otherwise(F.col("y")).alias("cy"), "step", "side", "t")).alias("near"))
    plan = materialize(tiles.join(near, key, "left"), "plan")
    rows = dealt.select("label", "node", "n", "v", place).select("label", "node", "n", "v", "block", "cell.*").join(plan, key).withColumn("tile", F.pmod(F.xxhash64("node"), "t").cast("int"))

    def meeting(cx: Column, cy: Column, i: Column, step: Column, j: Column, side: Column) -> Column:
        return F.struct(cx.alias("cx"), cy.alias("cy"), i.alias("i"), step.alias("step"), j.alias("j"), side.alias("side"))

    # of a meeting (cell, i, step, j): as the first side with every tile j it meets, as the second with every i
    x, y, tile, zero = F.col("x"), F.col("y"), F.col("tile"), F.lit(0)
    lo = F.transform(F.sequence(tile, F.col("t") - 1), lambda j: meeting(x, y, tile, zero, j, zero))
    hi = F.filter(F.transform(F.sequence(zero, tile), lambda i: meeting(x, y, i, zero, tile, F.lit(1))), lambda m: m["i"] < m["j"])
    out_ = F.flatten(F.transform("near", lambda o: F.transform(F.sequence(zero, o["t"] - 1), lambda k: meeting(o["cx"], o["cy"], F.when(o["side"] == 0, tile).otherwise(k), o["step"], F.when(o["side"] == 0, k).otherwise(tile), o["side"]))))
    sent = rows.select("label", "block", "node", "n", "v", F.explode(F.concat(lo, hi, F.coalesce(out_, F.filter(lo, lambda m: F.lit(False))))).alias("m")).select("label", "block", "m.*", "node", "n", "v")
    order = ["label", "block", "cx", "cy", "i", "step", "j"]
    sent = sent.select(*order, "side", "node", "n", "v").repartition(*order).sortWithinPartitions(*order, "side", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 7):
            block, i, step, j = (group.column(k)[0].as_py() for k in (1, 4, 5, 6))
            side, node, n = (group.column(k).to_numpy() for k in (7, 8, 9))
            alone = step == 0 and i == j
            first = len(group) if alone else int(np.searchsorted(side, 1))
            if first == 0 or (not alone and first == len(group)):
                continue
            x = matrix(group.column(10).to_pylist())
            links, low = np.zeros(len(group), np.int64), np.arange(len(group))
            for p, q in meetings(x[:first], None if alone else x[first:], block, axes, least):
                q = q if alone else q + first
                links += np.bincount(p, n[q], len(group)).astype(np.int64) + np.bincount(q, n[p], len(group)).astype(np.int64)
                low = forest(len(group), np.concatenate((p, np.arange(len(group)))), np.concatenate((q, low)))
            hit = np.flatnonzero(links)
            if len(hit):
                tied = hit[low[hit] != hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[hit], node[tied]))), pa.array(np.concatenate((links[hit], np.zeros(len(tied), np.int64)))), pa.array(np.concatenate((np.zeros(len(hit), np.int64), node[low[tied]])), mask=np.arange(len(hit) + len(tied)) < len(hit))], names=["node", "links", "up"])

    return sent.mapInArrow(tidied(meet), "node bigint, links bigint, up bigint")
