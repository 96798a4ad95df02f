"""Removal of repeated passages by longest-previous-factor arrays over a sparse suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
smaller doc_id. Sorting every suffix of the corpus is not needed for that: equal strings of
that length contain the same *anchor*, the least-hashed 20-gram in them, so only passages
around anchors that occur more than once can match.

1. Documents are dealt into chunks of some megabytes, laid out once. Each chunk sends its
   anchors' hashes, in buckets; a bucket answers with one bit for each: seen elsewhere or not.
2. Each chunk sends its shared anchors with a hash of their context (all strings of the
   length that contain the anchor). Anchors with equal contexts have equal suffixes and are
   one entry of the suffix order; of its members all but the smallest doc_id's have the whole
   context as their longest previous factor, so they lose it. Within a chunk this is found
   before anything is sent.
3. Of the contexts that differ, the suffixes of ``length`` bytes and more are put in suffix
   order; the previous and next smaller position (the nearest suffixes before and after that
   belong to a smaller document) give each its longest previous factor (``lpf``). Where it
   reaches ``length`` the suffix is covered.
4. An anchor that occurs very often (over ``HOT``) would gather in one task, so its suffixes
   are dealt by all of their first ``length`` bytes instead of by the anchor. They are settled
   in the same way, by suffix order and factors, first in each chunk, which sends only those
   that are not covered there, then in their bucket.
5. Covered intervals meet their documents again, where the rest is hashed or returned.

Everything is compared as UTF-8 bytes on the input, not on what is left. Defined results: a
null text is empty; texts under ``length`` bytes never lose anything nor cause a removal;
rows with equal doc_id don't remove each other's text, and all appear; rows with a null
doc_id stay whole and cause no removal. Further columns are ignored. ``length`` is at least ``GRAM`` + 8;
less is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import laid_out, materialize, mix64, release_shuffles, text_bytes, texts

GRAM = 20
CHUNK_BYTES, BUCKET_ANCHORS = 8 << 20, 1 << 19
BLOCK = 1 << 16
HOT = 1 << 14  #: occurrences of an anchor
SUFFIXES = 1 << 19  #: suffixes that are ordered at once, unless one anchor has more

ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<i8"), ("i", "<i4"), ("q", "<i4"), ("l", "<u2"), ("r", "<u2")])
#: i: the row's place in its chunk's order.
COVER = np.dtype([("i", "<i4"), ("s", "<i4"), ("e", "<i4")])


def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's doc_ids (0 where null), whether they are there, its bytes and bounds; in one order whenever it is asked for."""
    table = table.take(pc.sort_indices(table.column("row")))
    body, bounds = text_bytes(table.column("text"))
    ids = table.column("doc_id")
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), body, bounds


def by_key(rows: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key that occurs, in order, and its rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(keys[a]), rows[order[a:z]]


def anchors(body: np.ndarray, bounds: np.ndarray, use: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of every string of ``length`` bytes within a row."""
    window = length - GRAM + 1
    valid = np.ones(len(body), bool)
    for lo, hi, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), use.tolist()):
        valid[max(lo, hi - length + 1) if ok else lo : hi] = False
    base = 0x9E3779B97F4A7C15
    value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    power = {n: np.uint64(pow(base, n, 1 << 64)) for n in (1, 2, 4, 8)}
    places, hashes = [], []
    for at in range(0, len(body), BLOCK):
        ok = valid[at : at + BLOCK]
        if not ok.any():
            continue
        h = {1: value[body[at : at + BLOCK + length - 1]]}
        for n in (1, 2, 4, 8):
            h[2 * n] = h[n][:-n] * power[n] + h[n][n:]
        gram = h[16][: len(h[GRAM - 16]) - 16] * power[GRAM - 16] + h[GRAM - 16][16:]
        key = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        key = (key & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(key), dtype=np.uint64)
        low, n = key, 1
        while 2 * n <= window:
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        if n < window:
            low = np.minimum(low[: len(low) - (window - n)], low[window - n :])
        found = (low[: len(ok)][ok[: len(low)]] & np.uint64(0xFFFFFF)).astype(np.int64)
        if len(found):
            found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            places.append(found + at)
            hashes.append(gram[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    q, h = np.concatenate(places), np.concatenate(hashes)
    keep = np.concatenate(([True], q[1:] != q[:-1]))
    return q[keep], mix64(h[keep])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def words_at(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as little-endian integers."""
    return np.ndarray((len(body) - 7,), "<u8", np.ascontiguousarray(body), strides=(1,))[at]


def context_hash(body: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    h = mix64(left.astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
    for i in range(0, most, 8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words_at(body, np.minimum(lo + i, hi - 8)))
    return h


def merged(cover: np.ndarray) -> np.ndarray:
    """Intervals of each row, joined where they touch."""
    if len(cover) < 2:
        return cover
    cover = cover[np.lexsort((cover["s"], cover["i"]))]
    fresh = np.concatenate(([True], cover["i"][1:] != cover["i"][:-1]))
    shift = np.cumsum(fresh) << 32
    reach = np.maximum.accumulate(cover["e"] + shift)
    start = fresh | np.concatenate(([True], cover["s"][1:] + shift[1:] > reach[:-1]))
    first = np.flatnonzero(start)
    out = cover[first].copy()
    out["e"] = reach[np.append(first[1:], len(cover)) - 1] - shift[first]
    return out


def classes(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by (h, c, d), and for each the smallest d of its (h, c)."""
    e = e[np.lexsort((e["d"], e["c"], e["h"]))]
    if not len(e):
        return e, e["d"]
    fresh = np.concatenate(([True], (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])))
    return e, e["d"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]


def string_hash(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """To deal strings: equal ones get equal numbers."""
    h = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for i in range(0, length, 8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words_at(body, at + min(i, length - 8)))
    return h


def positions(size: int, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Where the strings of ``length`` in the intervals start, each position once."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi - length + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def string_covers(row: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(row), COVER)
    out["i"], out["s"], out["e"] = row, start, start + length
    return out


def covers(e: np.ndarray) -> np.ndarray:
    out = np.zeros(len(e), COVER)
    out["i"], out["s"], out["e"] = e["i"], e["q"] - e["l"], e["q"] + e["r"]
    return out


def lpf(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix, by its first ``length`` bytes: the most that it shares with one of a smaller document.

    Adjacent suffixes in suffix order share their common prefix, suffixes further apart the
    least of those between. The most is shared with the previous or the next smaller position,
    so only those two count. All suffixes look for them at once: from each neighbour that is
    not smaller they go on to where that neighbour has got to, and take its least along.
    A search ends where less than ``least`` is left: of factors below it only that is known.
    """
    n = len(starts)
    word = [words_at(text, starts + min(i, length - 8)).byteswap() for i in range(0, length, 8)]
    order = np.lexsort(word[::-1])
    shared, same = np.full(n, length, np.int64), np.ones(max(n - 1, 0), bool)
    for i, w in zip(range(0, length, 8), word):
        w = w[order]
        at = np.flatnonzero(same & (w[1:] != w[:-1]))
        x = w[at + 1] ^ w[at]
        shared[at + 1] = min(i, length - 8) + sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        same[at] = False
    doc, best = docs[order], np.zeros(n, np.int64)
    for back in (False, True):
        d, common = (doc[::-1], np.concatenate(([0], shared[:0:-1]))) if back else (doc, np.concatenate(([0], shared[1:])))
        common, smaller = common[:n].copy(), np.arange(-1, n - 1)
        live = np.arange(1, n)
        while len(live := live[common[live] >= least]):
            live = live[(smaller[live] >= 0) & (d[smaller[live]] >= d[live])]
            # all step at once: both are read before either is written
            step = smaller[live]
            least_there, there = common[step], smaller[step]
            common[live] = np.minimum(common[live], least_there)
            smaller[live] = there
        common[smaller < 0] = 0
        best = np.maximum(best, common[::-1] if back else common)
    out = np.zeros(n, np.int64)
    out[order] = best
    return out


def covered(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, deal: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes have a previous factor of ``length``; equal strings have equal ``deal``, by which many are ordered in parts."""
    out = np.zeros(len(starts), bool)
    for _, at in by_key(np.arange(len(starts)), mix64(deal) % np.uint64(-(-len(starts) // SUFFIXES) or 1)):
        out[at] = lpf(text, starts[at], docs[at], length, length) >= length
    return out


def _rows(found: dict[int, np.ndarray]) -> list[dict]:
    return [{"kind": "i", "chunk": k, "bucket": None, "blob": v.tobytes()} for k, v in found.items() if len(v)]


def dealt(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, row, doc_id, text: written once by chunk, so that no later step moves texts."""
    d = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return laid_out(d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "chunk", chunks)


def repeated_spans(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """The dealt documents (chunk, doc_id, text), and the intervals to remove (chunk, blob of COVER)."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    size = texts(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    chunks = max(1, -(-size[0] // CHUNK_BYTES), -(-size[1] // 100_000))
    buckets = max(1, -(-size[0] // (14 * BUCKET_ANCHORS)))
    d = dealt(docs, chunks)
    left, most = length - GRAM, 2 * length - GRAM
    blob = pa.schema([("kind", pa.string()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
    ddl = "kind string, chunk int, bucket int, blob binary"

    STRING = np.dtype([("d", "<i8"), ("i", "<i4"), ("s", "<i4"), ("t", "u1", (length,))])

    def table(rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, schema=blob)

    def found(part: pa.Table):
        """A chunk's rows and anchors, its distinct hashes by bucket, their number, and the bucket of each."""
        ids, there, body, bounds = ordered(part)
        q, h = anchors(body, bounds, there, length)
        hashes, back, times = np.unique(h, return_inverse=True, return_counts=True)
        return ids, body, bounds, q, h, back, hashes, times, bucket_of(hashes, buckets)

    def send(part: pa.Table) -> pa.Table:
        chunk = part.column("chunk")[0].as_py()
        *_, hashes, times, bucket = found(part)
        both = hashes.view(np.uint8).reshape(-1, 8).copy()
        both[:, 6:] = np.minimum(times, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
        return table([{"kind": "h", "chunk": chunk, "bucket": b, "blob": x.tobytes()} for b, x in by_key(both, bucket)])

    def answer(part: pa.Table) -> pa.Table:
        bucket, blobs = part.column("bucket")[0].as_py(), [np.frombuffer(x, np.uint8).reshape(-1, 8) for x in part.column("blob").to_pylist()]
        wide = np.concatenate(blobs)
        times = np.ascontiguousarray(wide[:, 6:]).view("<u2").ravel()
        wide[:, 6:] = 0
        _, back = np.unique(wide.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(back, times)[back]
        at, rows = 0, []
        for chunk, x in zip(part.column("chunk").to_pylist(), blobs):
            own = total[at : at + len(x)]
            rows.append({"kind": "b", "chunk": chunk, "bucket": bucket, "blob": np.packbits(np.concatenate((own > 1, own > HOT))).tobytes()})
            at += len(x)
        return table(rows)

    def share(part: pa.Table, bits: pa.Table) -> pa.Table:
        if not part.num_rows or not bits.num_rows:
            return table([])
        chunk = part.column("chunk")[0].as_py()
        ids, body, bounds, q, h, back, hashes, _, bucket = found(part)
        flags = np.zeros((2, len(hashes)), bool)
        told = dict(zip(bits.column("bucket").to_pylist(), bits.column("blob").to_pylist()))
        for b, at in by_key(np.arange(len(hashes)), bucket):
            flags[:, at] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=2 * len(at)).reshape(2, -1)
        many, hot = flags[0][back], flags[1][back]
        rows = []
        if hot.any():
            p = q[hot]
            doc = np.searchsorted(bounds, p, "right") - 1
            at = positions(len(body), np.maximum(p - left, bounds[doc]), np.minimum(p + length, bounds[doc + 1]), length)
            row, deal = np.searchsorted(bounds, at, "right") - 1, string_hash(body, at, length)
            gone = covered(body, at, ids[row], deal, length)
            rows += _rows({chunk: merged(string_covers(row[gone], (at - bounds[row])[gone], length))})
            for b, k in by_key(np.flatnonzero(~gone), bucket_of(deal[~gone], buckets)):
                x = np.zeros(len(k), STRING)
                x["d"], x["i"], x["s"], x["t"] = ids[row[k]], row[k], (at - bounds[row])[k], body[at[k][:, None] + np.arange(length)]
                rows.append({"kind": "w", "chunk": chunk, "bucket": b, "blob": x.tobytes()})
        many &= ~hot
        q, h = q[many], h[many]
        if not len(q):
            return table(rows)
        doc = np.searchsorted(bounds, q, "right") - 1
        lo, hi = np.maximum(q - left, bounds[doc]), np.minimum(q + length, bounds[doc + 1])
        e = np.zeros(len(q), ENTRY)
        e["h"], e["c"], e["d"], e["i"], e["q"], e["l"], e["r"] = h, context_hash(body, lo, hi, q - lo, most), ids[doc], doc, q - bounds[doc], q - lo, hi - q
        e, least = classes(e)
        behind = e["d"] > least
        mine, e = merged(covers(e[behind])), e[~behind]
        rows += _rows({chunk: mine})
        return table(rows + [{"kind": "e", "chunk": chunk, "bucket": b, "blob": x.tobytes()} for b, x in by_key(e, bucket_of(e["h"], buckets))])

    def settle(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        blobs = [np.frombuffer(x, ENTRY) for x in part.column("blob").to_pylist()]
        e = np.concatenate(blobs)
        owner = np.repeat(np.array(part.column("chunk").to_pylist(), np.int32), [len(x) for x in blobs])
        order = np.lexsort((e["d"], e["c"], e["h"]))
        e, owner = e[order], owner[order]
        fresh = np.concatenate(([True], (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])))
        behind = e["d"] > e["d"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        done, done_at = covers(e[behind]), owner[behind]
        e, owner = e[~behind], owner[~behind]
        new = np.concatenate(([True], e["h"][1:] != e["h"][:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        differ = np.maximum.reduceat(e["d"], first) != np.minimum.reduceat(e["d"], first)
        ask = differ[group]
        rows = []
        for kind, what, at in (("i", done, done_at), ("r", e[ask], owner[ask])):
            rows += [{"kind": kind, "chunk": k, "bucket": bucket, "blob": (merged(x) if kind == "i" else x).tobytes()} for k, x in by_key(what, at)]
        return table(rows)

    def settle_strings(part: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, STRING) for x in part.column("blob").to_pylist()]
        owner = np.repeat(np.array(part.column("chunk").to_pylist(), np.int32), [len(x) for x in blobs])
        w = np.concatenate(blobs)
        text, at = np.ascontiguousarray(w["t"]).ravel(), np.arange(len(w)) * length
        gone = covered(text, at, w["d"], string_hash(text, at, length), length)
        return table(_rows({k: merged(x) for k, x in by_key(string_covers(w["i"][gone], w["s"][gone], length), owner[gone])}))

    LINE = np.dtype([("h", "<u8"), ("d", "<i8"), ("i", "<i4"), ("s", "<i4"), ("n", "<i4"), ("k", "<i4"), ("t", "u1", (most + 4,))])

    def fetch(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not part.num_rows or not asked.num_rows:
            return table([])
        chunk = part.column("chunk")[0].as_py()
        _, _, body, bounds = ordered(part)
        body, rows = np.concatenate((body, np.zeros(most + 8, np.uint8))), []
        for bucket, x in zip(asked.column("bucket").to_pylist(), asked.column("blob").to_pylist()):
            e = np.frombuffer(x, ENTRY)
            out = np.zeros(len(e), LINE)
            out["h"], out["d"], out["i"], out["s"], out["n"], out["k"] = e["h"], e["d"], e["i"], e["q"] - e["l"], e["l"].astype(np.int32) + e["r"], chunk
            out["t"][:, :most] = body[(bounds[e["i"]] + out["s"])[:, None] + np.arange(most)]
            rows.append({"kind": "c", "chunk": chunk, "bucket": bucket, "blob": out.tobytes()})
        return table(rows)

    def factors(part: pa.Table) -> pa.Table:
        lines = np.concatenate([np.frombuffer(x, LINE) for x in part.column("blob").to_pylist()])
        lines = lines[np.argsort(lines["h"], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], lines["h"][1:] != lines["h"][:-1], [True])))
        total = np.concatenate(([0], np.cumsum(lines["n"] - length + 1)))[edges]
        out, a = [], 0
        while a < len(edges) - 1:
            z = max(a + 1, int(np.searchsorted(total, total[a] + SUFFIXES, "right")) - 1)
            x = lines[edges[a] : edges[z]]
            n = x["n"] - length + 1
            line = np.repeat(np.arange(len(x)), n)
            step = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            text, at = np.ascontiguousarray(x["t"]).ravel(), line * (most + 4) + step
            hit = covered(text, at, x["d"][line], string_hash(text, at, length), length)
            out.append((string_covers(x["i"][line[hit]], x["s"][line[hit]] + step[hit], length), x["k"][line[hit]]))
            a = z
        c, k = (np.concatenate([o[i] for o in out]) for i in (0, 1))
        return table(_rows({v: merged(x) for v, x in by_key(c, k)}))

    sent = d.groupBy("chunk").applyInArrow(send, ddl)
    bits = sent.groupBy("bucket").applyInArrow(answer, ddl)
    shared = materialize(d.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(share, ddl), "shared")
    release_shuffles(spark)
    settled = materialize(shared.where("kind = 'e'").groupBy("bucket").applyInArrow(settle, ddl), "settled")
    release_shuffles(spark)
    lines = d.groupBy("chunk").cogroup(settled.where("kind = 'r'").groupBy("chunk")).applyInArrow(fetch, ddl)
    last = lines.groupBy("bucket").applyInArrow(factors, ddl)
    often = shared.where("kind = 'w'").groupBy("bucket").applyInArrow(settle_strings, ddl)
    spans = reduce_union([shared.where("kind = 'i'"), settled.where("kind = 'i'"), last, often])
    return d, spans.select("chunk", "blob")


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` kept (binary)."""
    d, spans = repeated_spans(docs, length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_text else [])])

    def cut(part: pa.Table, gone: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        if gone.num_rows:
            for row, s, e in merged(np.concatenate([np.frombuffer(x, COVER) for x in gone.column("blob").to_pylist()])).tolist():
                by.setdefault(row, []).append((s, e))
        rows: list[tuple] = []
        if part.num_rows:
            ids, there, body, bounds = ordered(part)
            view = memoryview(np.ascontiguousarray(body))
            for row, (i, ok, lo, hi) in enumerate(zip(ids.tolist(), there.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())):
                cuts = by.get(row, [])
                edge = [0, *(x for c in cuts for x in c), hi - lo]
                parts = [view[lo + a : lo + z] for a, z in zip(edge[::2], edge[1::2])]
                sha = hashlib.sha256()
                for p in parts:
                    sha.update(p)
                rows.append((i if ok else None, hi - lo, sum(e - s for s, e in cuts), len(cuts), sha.hexdigest(), *((b"".join(parts),) if keep_text else ())))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return d.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, ddl)
