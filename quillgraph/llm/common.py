"""Helpers that the operators of this subpackage share.

Large intermediate results are written as Parquet below the folder named by
``spark.checkpoint.dir``; only where that setting is absent and all runs in one process
(tests, notebooks) is a folder of our own made.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: ASCII white space that separates words: space and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound what goes to a Python worker at once, whatever the length of the texts; bounds already lower stay."""
    for name, most in (("maxBytesPerBatch", mb << 20), ("maxRecordsPerBatch", 2000)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        now = int(now) if re.fullmatch(r"-?\d+", now) else 0
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_on_exit(spark: SparkSession, path: str) -> None:
    where, store = _folder(spark, path)
    store.deleteOnExit(where)


def materialize(df: DataFrame, name: str, codec: str = "zstd", block_mb: int = 16) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files are removed by ``discard``, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.block.size", block_mb << 20).parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized frame that no plan still to be run reads."""
    where, store = _folder(df.sparkSession, df._written)
    store.delete(where, True)


MOST_FOLDERS, FOLDER_BYTES = 50_000, 32 << 20


def laid_out(df: DataFrame, key: str, folders: int) -> DataFrame:
    """``df`` written in files by a hash of ``key``, so that joins and groups by it move none of its rows again.

    The table's name in the catalogue goes at once; its files stay until the JVM ends.
    """
    spark = df.sparkSession
    name, folders = f"laid_out_{uuid.uuid4().hex}", min(max(folders, parallelism(spark)), MOST_FOLDERS)
    path = f"{shared_dir(spark)}/{name}"
    delete_on_exit(spark, path)
    df.repartition(folders, key).write.bucketBy(folders, key).option("path", path).option("compression", "zstd").option("parquet.block.size", 16 << 20).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    release_shuffles(spark)
    return out


HOT_KEYS, HOT_ROWS = 1000, 256  #: a hot key holds more than 1/HOT_KEYS of the rows, and HOT_ROWS at least


def keyed_join(big: DataFrame, small: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one short row a key and in ``count`` the rows of ``big`` with that key.

    Fewer than HOT_KEYS keys can hold more than 1/HOT_KEYS of the rows each. Their rows of
    ``small`` are broadcast, which that number bounds, and all others meet by a shuffle, so
    no task gets all rows of a hot key. Both are read twice: pass tables.
    """
    least = max(big.count() // HOT_KEYS, HOT_ROWS)
    hot = F.broadcast(small.where(F.col(count) > least).drop(count))
    spread = big.join(hot, key)
    return spread.unionByName(big.join(F.broadcast(small.where(F.col(count) > least).select(*key)), key, "left_anti").join(small.where(F.col(count) <= least).drop(count), key, how))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not at the next collection."""
    spark.sparkContext._jvm.System.gc()


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), with further columns as asked for."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder (null ids: never)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes, end to end, and each row's bounds (rows + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def tidy() -> None:
    """Give freed memory back to the system: idle Python workers would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which tidies up when its partition is done."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` bytes of text in one column, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(lengths) - 1) // size if len(lengths) else lengths
    edge = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(lengths)]
    for a, z in zip(edge[:-1], edge[1:]):
        if z > a:
            yield batch.slice(a, z - a)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that agree in their first ``keys`` columns (without nulls), which the input is sorted by."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        fresh = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
        edge = [0, *(np.flatnonzero(fresh) + 1).tolist(), b.num_rows]
        for a, z in zip(edge[:-1], edge[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 linked by pairs (a, b), the smallest node reachable from each, by label propagation with jumps."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for x in (a, b, low[a], low[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


SAMPLE_BYTES = 128 << 20  #: most text that a model is fitted on


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows (doc_id, text, ...) for a fit, however often an id or a row repeats; in one partition, in the order of a hash."""
    n = rows.count()
    part = min(1.0, most / n) if n else 1.0
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("part")), F.lit(1_000_000)) < part * 1_000_000).limit(2 * most) if part < 1 else rows
    return some.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")


def up_to(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows up to ``size`` bytes in one column, one row at least."""
    for whole in batches:
        for b in slices(whole, column):
            yield b
            size -= pc.sum(pc.fill_null(pc.binary_length(b.column(column)), 0)).as_py() or 0
            if size <= 0:
                return


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_spans(body: np.ndarray, bounds: np.ndarray, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows; a row's bounds always end a word.

    ``member``: by byte, whether it belongs to a word; by default all but ASCII white space.
    """
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if member is None:
        member = np.ones(256, bool)
        member[list(SPACES)] = False
    inside = member[body]
    fresh = np.ones(len(body), bool)
    fresh[1:] = ~inside[:-1]
    edges = bounds[:-1]
    fresh[edges[edges < len(body)]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(len(body), bool)
    last[:-1] = ~inside[1:]
    ends = bounds[1:]
    last[ends[ends > 0] - 1] = True
    return starts, np.flatnonzero(inside & last) + 1


def _eights(body: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as one number; those beyond ``left`` bytes count as 0. ``body`` ends with 8 spare bytes."""
    window = np.lib.stride_tricks.as_strided(body, (len(body) - 7, 8), (1, 1))
    word = np.ascontiguousarray(window[at]).view("<u8").ravel()
    return word & (np.uint64(2**64 - 1) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))))


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z if ``fold_case``: eight bytes a step, scrambled after each."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = np.concatenate((_FOLDED[body] if fold_case else body, np.zeros(8, np.uint8)))
    lengths = ends - starts
    out = mix64(lengths.astype(np.uint64) + STEP)
    for i in range(0, int(min(lengths.max(), 32)), 8):
        live = np.flatnonzero(lengths > i) if i else slice(None)
        out[live] = mix64(out[live] * STEP + _eights(body, starts[live] + i, lengths[live] - i))
    for k in np.flatnonzero(lengths > 32).tolist():  # the rest of long words: each eight bytes scrambled with their place
        at = np.arange(starts[k] + 32, ends[k], 8)
        eights = mix64(_eights(body, at, ends[k] - at) + mix64(np.arange(1, len(at) + 1, dtype=np.uint64) * STEP))
        out[k : k + 1] = mix64(out[k : k + 1] * STEP + eights.sum(dtype=np.uint64))
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (columns a, b): columns node, component.

    Alternates large-star and small-star contraction; each round is written to the shared
    folder, so a lost executor costs one round at most. The centre of a large star is a hot key:
    its edges meet its smallest neighbour by a broadcast, see ``keyed_join``. Nodes without an
    edge do not appear.
    """
    def swept(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    def starred(near: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``near`` with m, the smallest neighbour of u or u itself; and the written table of m."""
        low = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("times")), name)
        return keyed_join(near, low, ["u"], "times"), low

    e = materialize(swept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), name)
    seen = None
    while True:
        near, low = starred(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = materialize(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        discard(low)
        near, low = starred(large)  # all v are below u here, so m is one of them
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        old, e = e, materialize(swept(small), name)
        for done in (old, low, large):
            discard(done)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
