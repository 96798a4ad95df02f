"""Fill-in-the-middle with an index of distinct texts.

Identical texts are grouped by content: rows meet by the SHA-256 of their text and each group
keeps the set of its texts, which must be one (else the job fails). For every text of the
index the ends of its units (runs of ASCII letters, every other code point alone) are computed
once and kept as an Elias-Fano list: the low bits of each end packed, the high bits as a
unary bitmap, in which the i-th end is found by counting set bits. Documents, reduced to id
and SHA-256, join the index; their keyed cuts select two ends, and the output is put together
from the index's text.

Texts cross the network once. The rows of a text that holds more than a thousandth of all rows
are dealt over several parts, each with a copy of the text; documents with equal id and text
are settled once and repeated at the end.

Defined results: a null text is empty; an empty text is plain with no unit. Equal rows give
equal rows; a null doc_id is keyed by the text ``null``. Further columns are ignored, an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, HOT_ROWS, materialize, small_batches, text_bytes, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ENDS = "n bigint, low int, lows binary, highs binary"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ONES = np.array([x.bit_count() for x in range(256)], np.int64)


def packed(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """An ascending list of numbers up to ``universe`` as Elias-Fano: low bits of each, packed low bits, unary high bits."""
    n = len(ends)
    if not n:
        return 0, b"", b""
    low = max(0, (universe // n).bit_length() - 1)
    bits = (ends[:, None] >> np.arange(low)) & 1
    highs = np.zeros((universe >> low) + n + 1, np.uint8)
    highs[(ends >> low) + np.arange(n)] = 1
    return low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(highs, bitorder="little").tobytes()


def selected(i: int, low: int, lows: bytes, highs: bytes) -> int:
    """The i-th number of the list, from 1; 0 before the first."""
    if not i:
        return 0
    high = np.frombuffer(highs, np.uint8)
    counted = np.cumsum(_ONES[high])
    byte = int(np.searchsorted(counted, i))
    left, x = i - int(counted[byte] - _ONES[high[byte]]), int(high[byte])
    for _ in range(left - 1):
        x &= x - 1
    place = 8 * byte + (x & -x).bit_length() - 1
    at, value = (i - 1) * low, 0
    if low:
        whole = int.from_bytes(lows[at >> 3 : ((at + low - 1) >> 3) + 1], "little")
        value = (whole >> (at & 7)) & ((1 << low) - 1)
    return (place - (i - 1) << low) | value


def unit_ends(column: pa.Array) -> list[tuple[np.ndarray, int]]:
    """By text, where its units end and its length, both in code points."""
    body, bounds = text_bytes(column)
    if not len(body):
        return [(np.zeros(0, np.int64), 0)] * (len(bounds) - 1)
    starts = (body & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(starts)))  # code points up to a byte
    letter = _LETTER[body]
    ends = np.ones(len(body), bool)  # a unit ends with this byte
    ends[:-1] = starts[1:] & ~(letter[:-1] & letter[1:])
    ends[bounds[1:][bounds[1:] > 0] - 1] = True
    at = np.flatnonzero(ends)
    cut = np.searchsorted(at, bounds)
    return [(before[at[a:z] + 1] - before[lo], int(before[hi] - before[lo])) for a, z, lo, hi in zip(cut[:-1], cut[1:], bounds[:-1], bounds[1:])]


def _ends_udf():
    @F.pandas_udf(ENDS)
    def ends_of(text: pd.Series) -> pd.DataFrame:
        rows = [(len(e), *packed(e, u)) for e, u in unit_ends(pa.array(text, pa.string()))]
        return pd.DataFrame(rows, columns=["n", "low", "lows", "highs"])

    return ends_of


def _cuts_udf():
    @F.pandas_udf("a bigint, z bigint")
    def cuts(first: pd.Series, second: pd.Series, low: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = [(selected(i, b, lo, hi), selected(k, b, lo, hi)) for i, k, b, lo, hi in zip(first, second, low, lows, highs)]
        return pd.DataFrame(rows, columns=["a", "z"], dtype="int64")

    return cuts


def _with_parts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id, ...) with the part of a hot key that they fall to, else part 0."""
    # fewer than HOT_KEYS keys can be hot, so this broadcast is small
    return rows.join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))).drop("parts")


def joined_index(docs: DataFrame) -> DataFrame:
    """Distinct documents with their text and its list of ends from the index: doc_id, times, text, n, low, lows, highs."""
    small_batches(docs.sparkSession)
    keyed = texts(docs).withColumn("key", F.unhex(F.sha2("text", 256)))
    short = keyed.select("key", "doc_id")
    most = max(docs.count() // HOT_KEYS, HOT_ROWS)
    distinct = materialize(short.groupBy("key", "doc_id").agg(F.count("*").alias("times")), "distinct")
    hot = distinct.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).alias("parts"))
    same = _with_parts(keyed, hot).groupBy("key", "part").agg(F.collect_set("text").alias("same"))
    one = F.when(F.size("same") == 1, F.get("same", F.lit(0))).otherwise(F.raise_error(F.lit("different texts share a SHA-256")).cast("string"))
    text = same.select("key", "part", one.alias("text"))
    # a Python function gives up the partitioning, so only the lists of ends move again; both sides read one exchange of the texts
    ends = text.select("key", "part", _ends_udf()("text").alias("e"))
    return _with_parts(distinct, hot).join(text, ["key", "part"]).join(ends, ["key", "part"]).select("doc_id", "times", "text", "e.*")


def _draw(seed: int, k: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def transformed(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """A row a document: doc_id, n, form, prefix_chars, middle_chars, output."""
    rows = joined_index(docs)
    h = [_draw(seed, k) for k in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "cut": _cuts_udf()(F.least(one, two), F.greatest(one, two), "low", "lows", "highs")})
    cut, a, z = F.col("form") != "plain", F.col("cut.a").cast("int"), F.col("cut.z").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, z - a), F.substring("text", z + 1, F.length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    once = rows.select("doc_id", "times", "n", "form", F.when(cut, F.col("cut.a")).alias("prefix_chars"), F.when(cut, F.col("cut.z") - F.col("cut.a")).alias("middle_chars"), out.alias("output"))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), middle, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), middle, F.substring(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``transformed`` with the SHA-256 of output and of the text restored from it."""
    done = transformed(docs, seed)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
