"""MinHash near-duplicates with odd sketches.

Every document's set of distinct word shingles is reduced to MinHash samples. Bands of the
samples give buckets of documents that may be similar; an odd sketch (the samples folded
into a parity bitmap) estimates the similarity of a pair of a bucket from the population
count of an XOR, and pairs that the estimate lets through are confirmed on full sets.

Work on large groups stays linear. Rows are told apart by a number of their own, never by
doc_id. Rows with equal sets become one node before any bucket is built. Within a bucket,
first only pairs with a few hubs are tried (its smallest node and those first in fixed
pseudo-random orders). Once the confirmed links are merged, only nodes of one bucket that
are still in different components are compared with each other, in tiles of bounded size, so
no link that would join two components is left out. There the parity bitmap of the whole
set, an exact bound, settles most pairs that no link joins; texts are fetched only for rows
that have a candidate left, once a tile, the tile confirms its own pairs on full sets and
returns a spanning forest of the links, never the pairs. A pair that shares several buckets
is looked at in the first.

Defined results: a null or blank text has an empty set, no link and itself as component. A
text of fewer words than a shingle is one shingle of all its words. Equal rows are linked
like equal texts, also those with one doc_id; rows with one doc_id and different texts are
rows of their own. Rows with a null doc_id link with nothing and have a null component and
``kept`` false; ``deduplicated`` keeps them. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDER_BYTES, components, discard, keyed_join, laid_out, materialize, mix64, release_shuffles, runs, small_batches, text_bytes, texts, tidied, word_hashes, word_spans

SAMPLES, ROWS, WORDS = 128, 4, 8  #: MinHash samples; samples in a band; 64-bit words of an odd sketch
PARITY = 2048  #: bits of the parity bitmap of a whole set
TILE, TILE_SHINGLES = 1024, 1 << 20  #: most rows and, about, shingles of a tile
CHUNK = 1024  #: pairs of a hub that one group confirms
HUBS = 2


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    a = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))
    b = mix64(np.arange(1001, SAMPLES + 1001, dtype=np.uint64))
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (b >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """Each row's sorted distinct 64-bit shingle hashes."""
    body, bounds = text_bytes(column)
    starts, ends = word_spans(body, bounds)
    words = word_hashes(body, starts, ends, fold_case=True)
    first = np.searchsorted(starts, bounds)
    step = np.uint64(0x9E3779B97F4A7C15)

    def chained(n: int) -> np.ndarray:
        h = words[: max(len(words) - n + 1, 0)].copy()
        for i in range(1, n):
            h = mix64(h * step + words[i : i + len(h)])
        return h

    full, out = chained(size), []
    for lo, hi in zip(first[:-1], first[1:]):
        n = hi - lo
        if n >= size:
            found = np.sort(full[lo : hi - size + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif n:
            h = words[lo : lo + 1].copy()
            for i in range(1, n):
                h = mix64(h * step + words[lo + i : lo + i + 1])
            out.append(mix64(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    a, b = _multipliers()
    out = np.full((len(sets), SAMPLES), 0xFFFFFFFF, np.uint32)
    for row, s in zip(out, sets):
        x = (mix64(s) >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(row, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=row)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, WORDS 64-bit words a row: each (position, sample) flips one bit."""
    n, bits = len(samples), 64 * WORDS
    place = mix64(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(bits)
    flat = np.bincount((np.arange(n)[:, None] * bits + place.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flat & 1).astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<i8")


def most_flips(similarity: float) -> int:
    """Set bits in the XOR of two sketches that pairs of this similarity practically never exceed.

    The expected count follows from the samples that differ; eight standard deviations of
    their number are granted.
    """
    mean = SAMPLES * (1 - similarity)
    differ = 2 * min(SAMPLES, mean + 8 * (SAMPLES * similarity * (1 - similarity)) ** 0.5)
    bits = 64 * WORDS
    return int(bits / 2 * (1 - np.exp(-2 * differ / bits)) + 16)


def parity_bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """Whole sets folded into parity bitmaps: an XOR's set bits never outnumber the elements that differ."""
    return [np.packbits((np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).tobytes() for s in sets]


SKETCH = ", ".join(f"o{i} bigint" for i in range(WORDS))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Of rows (row, doc_id, text): row, doc_id, n_shingles, s0 and s1 (128 bits of the set), the odd sketch o0.., the whole set's parity, and bands."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), *((f"o{i}", pa.int64()) for i in range(WORDS)), ("parity", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingle_sets(batch.column(2), size)
                samples = minhash(sets)
                odd = odd_sketches(samples)
                n = len(sets)
                bands = np.zeros((n, SAMPLES // ROWS), np.uint64)
                for i in range(ROWS):
                    bands = mix64(bands * np.uint64(31) + samples[:, i::ROWS] + np.uint64(1))
                bands = mix64(bands + np.arange(SAMPLES // ROWS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                one = np.array([np.bitwise_xor.reduce(s) for s in sets], np.uint64) if n else np.zeros(0, np.uint64)
                two = np.array([mix64(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets], np.uint64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, SAMPLES // ROWS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(WORDS)), pa.array(parity_bitmaps(sets), pa.binary()), flat], schema=schema)

    return docs.mapInArrow(tidied(run), f"row bigint, doc_id bigint, n_shingles bigint, s0 bigint, s1 bigint, {SKETCH}, parity binary, bands array<bigint>")


def flips(a: str, b: str):
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}"))) for i in range(WORDS)))


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b, n), those that sizes and odd sketches let through."""
    cols = ["n_shingles", *(f"o{i}" for i in range(WORDS))]
    x, y = (nodes.select(F.col("row").alias(k), F.struct(*cols).alias(f"s{k}")) for k in "ab")
    low, high = F.least("sa.n_shingles", "sb.n_shingles"), F.greatest("sa.n_shingles", "sb.n_shingles")
    return pairs.join(x, "a").join(y, "b").where((low >= high * similarity * (1 - 1e-9)) & (flips("sa", "sb") <= most_flips(similarity))).select("a", "b", "n")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of rows, those whose full sets have 100 * intersection >= percent * union.

    ``n`` is the size of a bucket that offers the pair, so a hub's pairs are dealt in chunks
    without being counted; in each, ``a`` comes first and the others stream by, so no task
    holds more than one set and a batch.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    needs = dealt.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("row"), F.lit(0).alias("kind")).unionByName(dealt.select("a", "chunk", F.col("b").alias("row"), F.lit(1).alias("kind")))
    have = needs.join(docs.select("row", "text"), "row")
    have = have.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "kind").select("a", "chunk", "kind", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = []
                for a, kind, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), shingle_sets(batch.column(4), size)):
                    if not kind:
                        key, mine = a, s
                    elif key == a and similar(mine, s, percent):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return have.mapInArrow(tidied(run), "a bigint, b bigint")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def candidates(tile: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of a tile's pairs in different components that the bounds let through.

    Columns: key, x, y, side, row, component, n_shingles, o, parity, bands. Rows of tile x
    meet rows of tile y; only the first bucket that a pair shares offers it.
    """
    key, x, y = (tile.column(i)[0].as_py() for i in range(3))
    side, row, comp, n = (tile.column(i).to_numpy() for i in (3, 4, 5, 6))
    odd, bands = (np.array(tile.column(i).combine_chunks().flatten()).reshape(len(row), -1) for i in (7, 9))
    parity = np.frombuffer(b"".join(tile.column(8).to_pylist()), np.uint64).reshape(len(row), -1)
    i, j = np.flatnonzero(side == x), np.flatnonzero(side == y)
    out = [(i[:0], i[:0])]
    for k in range(0, len(i), 64):
        p = i[k : k + 64]
        ok = comp[p][:, None] != comp[j][None, :]
        ok &= np.minimum(n[p][:, None], n[j][None, :]) >= similarity * (1 - 1e-9) * np.maximum(n[p][:, None], n[j][None, :])
        if x == y:
            ok &= row[p][:, None] < row[j][None, :]
        u, v = np.nonzero(ok)
        u, v = p[u], j[v]
        near = np.bitwise_count(odd[u] ^ odd[v]).sum(axis=1) <= most_flips(similarity)
        u, v = u[near], v[near]
        # with a Jaccard of s, at most (1 - s) / (1 + s) of the sizes' sum differ: this bound loses no link
        near = np.bitwise_count(parity[u] ^ parity[v]).sum(axis=1) <= (n[u] + n[v]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        u, v = u[near], v[near]
        first = np.argmax(bands[u] == bands[v], axis=1) if len(u) else u
        near = bands[u, first] == key
        out.append((u[near], v[near]))
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1))


def _still_apart(keyed: DataFrame, comp: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is still apart: of each tile of a bucket a spanning forest, at most a row a row of the tile."""
    similarity = percent / 100
    named = keyed.join(comp.withColumnRenamed("node", "row"), "row", "left").join(nodes.select("row", "n_shingles"), "row")
    named = named.select("key", "row", F.coalesce("component", "row").alias("component"), "n_shingles")
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    mixed = mixed.select("key", F.ceil(F.greatest(F.col("n") / TILE, F.col("size") / TILE_SHINGLES)).alias("t"))
    rows = named.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("row"), "t"))
    # a row of tile i goes to the pairs of tiles (i, j) and (j, i), the smaller first
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("t") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "row", "component", "n_shingles")
    sk = nodes.select("row", F.array(*(f"o{i}" for i in range(WORDS))).alias("o"), "parity", "bands")
    order = ["key", "x", "y"]
    rows = rows.join(sk, "row").select(*order, "side", "row", "component", "n_shingles", "o", "parity", "bands")
    kinds = "key bigint, x bigint, y bigint, side bigint, row bigint, component bigint, n_shingles bigint, o array<bigint>, parity binary, bands array<bigint>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 3):
            u, v = candidates(tile, similarity)
            if len(u):
                yield from tile.take(np.unique(np.concatenate((u, v)))).to_batches()

    asked = materialize(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidied(ask), kinds), "asked")
    release_shuffles(keyed.sparkSession)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 3):
            u, v = candidates(tile, similarity)
            sets = [s for k in range(0, len(tile), 64) for s in shingle_sets(tile.column(10).slice(k, 64), size)]
            low, found = np.arange(len(tile)), []
            for a, b in zip(u.tolist(), v.tolist()):
                if low[a] != low[b] and similar(sets[a], sets[b], percent):
                    found.append((a, b))
                    low[low == max(low[a], low[b])] = min(low[a], low[b])
            if found:
                row = tile.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(row[[x[i] for x in found]]) for i in (0, 1)], names=["a", "b"])

    whole = asked.join(docs.select("row", "text"), "row").select(*asked.columns, "text")
    return materialize(whole.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidied(settle), "a bigint, b bigint"), "late")


def linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of a table's rows (row, doc_id, text): row, doc_id, n_shingles, class_id, component_id, and first, the row that stands for its component."""
    spark = docs.sparkSession
    sk = materialize(sketches(docs.select("row", "doc_id", "text"), size), "sketches")
    named = sk.where("doc_id is not null and n_shingles > 0")
    same = ["s0", "s1", "n_shingles"]
    classes = materialize(named.groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("head"), F.count("*").alias("n")).select(*same, F.col("head.row").alias("node"), F.col("head.doc_id").alias("class_id"), "n"), "classes")
    nodes = materialize(named.join(classes.select(F.col("node").alias("row")), "row", "left_semi"), "nodes")
    members = materialize(sk.select("row", "doc_id", *same), "members")
    discard(sk)

    keyed = nodes.select("row", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("h0"), *(F.min_by("row", F.xxhash64("row", F.lit(i))).alias(f"h{i}") for i in range(1, HUBS))).where("n > 1")
    keyed = materialize(keyed.join(hubs, "key"), "buckets")
    pairs = keyed.select("row", "n", F.explode(F.array(*(f"h{i}" for i in range(HUBS)))).alias("hub")).where("row <> hub")
    pairs = materialize(pairs.groupBy(F.col("hub").alias("a"), F.col("row").alias("b")).agg(F.max("n").alias("n")), "pairs")
    links = materialize(confirmed(_plausible(pairs, nodes, percent / 100), docs, size, percent), "links")
    release_shuffles(spark)
    comp = components(links, "joined")
    more = _still_apart(keyed.select("key", "row"), comp, nodes, docs, size, percent)
    release_shuffles(spark)
    if more.limit(1).count():
        comp = components(links.unionByName(more), "joined")
    named = classes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "named")
    tops = named.groupBy("component").agg(F.min(F.struct("class_id", "node")).alias("top"), F.count("*").alias("classes"))
    tops = materialize(tops.select("component", F.col("top.class_id").alias("component_id"), F.col("top.node").alias("first"), "classes"), "tops")
    settled = materialize(keyed_join(named, tops, ["component"], "classes").select(*same, "class_id", "component_id", "first", "n"), "settled")
    for old in (nodes, keyed, pairs, links, classes):
        discard(old)
    out = keyed_join(members, settled, same, "n", "left")
    there = F.col("doc_id").isNotNull()
    known = there & (F.col("n_shingles") > 0)
    return out.select("row", "doc_id", "n_shingles", *(F.when(known, F.col(c)).when(there, F.col("doc_id")).alias(c) for c in ("class_id", "component_id")), F.when(known, F.col("first")).otherwise(F.col("row")).alias("first"))


def _by_row(rows: DataFrame, key: str) -> DataFrame:
    """The rows laid out by their number: texts are asked for by it up to three times."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return laid_out(rows, key, size // FOLDER_BYTES)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id, kept.

    ``size``: words in a shingle. Two documents are linked if 100 * intersection of their
    shingle sets >= percent * union; component_id is the smallest doc_id reachable by links.
    """
    small_batches(docs.sparkSession, 4)
    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    found = linked(_by_row(rows, "row"), size, percent)
    return found.select("doc_id", "n_shingles", "class_id", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, one with its smallest doc_id; rows without an id, a text or a word all stay."""
    small_batches(docs.sparkSession, 4)
    row = "row"
    while row in docs.columns:
        row += "_"
    table = _by_row(docs.withColumn(row, F.monotonically_increasing_id()), row)
    named = texts(table, F.col(row).alias("row_of")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("row_of").alias("row"))
    gone = linked(named, size, percent).where("row <> first").select(F.col("row").alias(row))
    return table.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
