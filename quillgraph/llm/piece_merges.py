"""SentencePiece ids of pair-merging models by vectorised rounds, and texts from ids.

A slice of texts is one flat array of code points. It is cut where no piece of the
vocabulary holds the two neighbouring characters side by side, which no merge can cross (in
most vocabularies that is before every blank); the distinct units are encoded once. Their
symbols lie in one flat array with a rank for every pair of neighbours. A round takes each
unit's smallest pair rank, merges its leftmost occurrences in all units at once, drops the
symbols that were swallowed and looks up only the pairs that changed; units without a pair
leave. Rounds end when none is left.

All occurrences of a unit's best pair merge in one round only where that can't differ from
merging one by one: no piece of the same or a better rank begins or ends with the new piece.
Else the leftmost occurrence merges alone.

Code points without a piece become the byte pieces of their UTF-8 form. Decoding gathers the
pieces' bytes. The library itself encodes or decodes only what this form does not know: models
with another normalisation (told by probes when the model is loaded) and ids whose byte
pieces are not UTF-8 or that hold the unknown piece.

Defined results: a null text is empty, an empty text has the begin and end ids alone; every
row is encoded by its text alone, so repeated rows and ids and null ids stay as they are; an
empty table gives an empty table; further columns are ignored. Null ids decode to a null text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts, tidied

BLANK = "▁"
NONE = np.int32(2**31 - 1)
SLICE = 2 << 20  #: bytes of text encoded at once, one text at least
#: Texts that a model with another normalisation encodes in another way.
PROBES = ("", " ", "  ", "a", " a  b ", "\ta\n\n b\r\n", "ﬁ ① ＡＢ é é", "x y　z​", BLANK, "a" + BLANK + BLANK + "b", "\0a", "<s></s><unk><0x0A>", "aaaa" * 9, "日本語テキスト", "\U0001f600�", "İıſßẞ")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's vocabulary as arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.n, self.begin, self.end = n, lib.bos_id(), lib.eos_id()
        self.bytes = np.full(256, -1, np.int64)
        for i, p in enumerate(pieces):
            if lib.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
        self._symbols({p: i for i, p in enumerate(pieces) if not special[i]})
        self._ranks([lib.get_score(i) for i in range(n)])
        self._decoder(pieces)
        self.known = bool(self.bytes.min() >= 0 and not any(map(lib.is_unused, range(n))))
        self.known = self.known and all(x.tolist() == lib.encode(t) for x, t in zip(self._slice(list(PROBES)), PROBES))

    def _symbols(self, ids: dict[str, int]) -> None:
        """Symbols are pieces, then further characters of pieces, then all other code points."""
        more = sorted({c for p in ids for c in p} - ids.keys())
        self.ids = ids | {c: self.n + k for k, c in enumerate(more)}
        self.first_point = self.n + len(more)
        self.span = self.first_point + 0x110000
        self.of_point = np.arange(self.first_point, self.span, dtype=np.int64)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        self.point_of = {i: ord(c) for c, i in self.ids.items() if i >= self.n}
        inside = sorted({c for p in ids if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no piece of several characters
        self.kind[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.beside = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for p in ids:
            k = self.kind[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True
        self.pieces = ids

    def _ranks(self, score: list[float]) -> None:
        """Every pair of symbols that joins to a piece, by key, with the piece and its rank (equal scores: equal ranks)."""
        levels = {s: k for k, s in enumerate(sorted(set(score), reverse=True))}
        rank = np.array([levels[s] for s in score], np.int32)
        found, best = [], {}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    found.append((a * self.span + b, i))
                for part in (a, b):
                    if part is not None:
                        best[part] = min(best.get(part, NONE), rank[i])
        found.sort()
        self.keys = np.array([k for k, _ in found], np.int64)
        self.joined = np.array([i for _, i in found], np.int32)
        self.rank = rank
        times = np.bincount(rank, minlength=len(levels))
        #: whether several occurrences may merge at once
        self.calm = np.array([times[rank[i]] == 1 and best.get(i, NONE) > rank[i] for i in range(self.n)])
        # an open table over the keys: a slot is taken by one key, those that find theirs taken are searched
        self.mask = (1 << max(int(len(found) * 8).bit_length(), 4)) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)
        at = self._hash(self.keys)
        self.slot[at[::-1]] = np.arange(len(found))[::-1]
        lost = self.slot[at] != np.arange(len(found))
        self.crowded = np.zeros(self.mask + 1, bool)
        self.crowded[at[lost]] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no piece) and piece of every pair."""
        key = a * self.span + b
        at = self._hash(key)
        row = self.slot[at]
        hit = self.keys[row] == key
        hit &= row >= 0
        again = np.flatnonzero(~hit & self.crowded[at])
        if len(again):
            place = np.minimum(np.searchsorted(self.keys, key[again]), len(self.keys) - 1)
            good = self.keys[place] == key[again]
            row[again[good]], hit[again[good]] = place[good], True
        piece = self.joined[np.where(hit, row, 0)]
        return np.where(hit, self.rank[piece], NONE), piece

    def _decoder(self, pieces: list[str]) -> None:
        lib = self.library
        raw = []
        for i, p in enumerate(pieces):
            raw.append(b"" if lib.is_control(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(BLANK, " ").encode())
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.control = np.array([lib.is_control(i) for i in range(self.n)])
        self.opens = np.array([p.startswith(BLANK) and not self.control[i] for i, p in enumerate(pieces)])
        self.odd = np.array([lib.is_unknown(i) for i in range(self.n)])

    def merged(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of every unit after all merges, unit by unit, and their number; ``size``: symbols of each unit, one at least."""
        n = len(size)
        sym, unit = symbols.astype(np.int64), np.repeat(np.arange(n), size)
        rank = np.full(len(sym), NONE, np.int32)
        piece = np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        rank[inner], piece[inner] = self._pairs(sym[inner], sym[inner + 1])
        done_sym, done_unit = [], []
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            least = np.minimum.reduceat(rank, start)
            lengths = np.diff(np.append(start, len(sym)))
            live = np.repeat(least != NONE, lengths)
            if not live.all():
                done_sym.append(sym[~live])
                done_unit.append(unit[~live])
                sym, unit, rank, piece = sym[live], unit[live], rank[live], piece[live]
                lengths, least = lengths[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # occurrences that overlap: every second one of a row of them, from the left
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            row = np.maximum.accumulate(np.where(fresh, at, 0))
            first = np.concatenate(([True], unit[at[1:]] != unit[at[:-1]]))
            at = at[np.where(self.calm[piece[at]], (at - row) % 2 == 0, False) | first]
            # an occurrence that is not calm goes alone: it is its unit's first
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, unit, rank, piece = sym[keep], unit[keep], rank[keep], piece[keep]
            new = at - np.arange(len(at))
            left = new[new > 0] - 1
            if len(left) and len(new) > 1:
                left = left[np.concatenate(([True], left[1:] != left[:-1]))]
            changed = np.concatenate((new, left))
            rank[changed] = NONE
            changed = changed[changed + 1 < len(sym)]
            changed = changed[unit[changed] == unit[changed + 1]]
            rank[changed], piece[changed] = self._pairs(sym[changed], sym[changed + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        return sym[np.argsort(unit, kind="stable")], np.bincount(unit, minlength=n)

    def _spelled(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: those that are no piece become the byte pieces of their code point."""
        odd = np.flatnonzero(symbols >= self.n)
        if not len(odd):
            return symbols, size
        spelled = [self.bytes[list(chr(s - self.first_point if s >= self.first_point else self.point_of[s]).encode())] for s in symbols[odd].tolist()]
        many = np.ones(len(symbols), np.int64)
        many[odd] = list(map(len, spelled))
        out = np.repeat(symbols, many)
        out[np.repeat(symbols >= self.n, many)] = np.concatenate(spelled)
        total = np.concatenate(([0], np.cumsum(many)))
        edge = np.concatenate(([0], np.cumsum(size)))
        return out, np.diff(total[edge])

    def _slice(self, group: list[str]) -> list[np.ndarray]:
        marked = [BLANK + t if t else "" for t in group]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        edge = np.concatenate(([0], np.cumsum(lengths)))
        raw = "".join(marked).replace(" ", BLANK).encode("utf-32-le")
        points = np.frombuffer(raw, "<u4")
        if not len(points):
            return [np.zeros(0, np.int64) for _ in group]
        kind = self.kind[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside[kind[:-1], kind[1:]]
        cut[edge[:-1][lengths > 0]] = True
        begin = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.append(begin, len(points)) * 4)
        units = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        of_unit = units.indices.to_numpy(zero_copy_only=False)
        _, bounds, data = units.dictionary.buffers()
        own = np.frombuffer(bounds, np.int64)[: len(units.dictionary) + 1]
        letters = np.frombuffer(data, "<u4")[own[0] // 4 : own[-1] // 4]
        ids, size = self._spelled(*self.merged(self.of_point[letters], np.diff(own) // 4))
        at = np.cumsum(size) - size
        count = size[of_unit]
        total = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.repeat(at[of_unit] - total[:-1], count) + np.arange(total[-1])]
        ends = total[np.searchsorted(begin, edge)]
        return [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, group: list[str], begin: bool = True, end: bool = True) -> list[np.ndarray]:
        """Ids of each text."""
        found = self._slice(group) if self.known else [np.array(self.library.encode(t), np.int64) for t in group]
        head, tail = np.array([self.begin] * begin, np.int64), np.array([self.end] * end, np.int64)
        return [np.concatenate((head, x, tail)).astype("<u4") for x in found]

    def decode(self, group: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids."""
        out = []
        for ids in group:
            if not self.known or not len(ids) or ids.max() >= self.n or self.odd[ids].any():
                out.append(self.library.decode(ids.tolist()))
                continue
            size = self.size[ids]
            total = np.cumsum(size)
            body = self.pool[np.repeat(self.at[ids] - total + size, size) + np.arange(total[-1])].tobytes()
            told = ids[~self.control[ids]][:1]
            try:
                text = body.decode()
            except UnicodeDecodeError:
                out.append(self.library.decode(ids.tolist()))
                continue
            out.append(text[1:] if len(told) and self.opens[told[0]] else text)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One model a worker process."""
    return Pieces(path)


def _mapped(rows: DataFrame, kind: str, made: str, size: int, run: Callable[[Pieces, pa.RecordBatch], list[pa.Array]], path: str) -> DataFrame:
    """``rows`` (doc_id and one more column) mapped slice by slice; ``made``: the columns that ``run`` gives beside doc_id."""
    small_batches(rows.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch, 1, size) if kind == "text" else [batch.slice(i, 64) for i in range(0, batch.num_rows, 64)]:
                names = ["doc_id", *(c.strip().split(" ")[0] for c in made.split(","))]
                yield pa.RecordBatch.from_arrays([part.column(0), *run(model, part)], names=names)

    return rows.mapInArrow(tidied(mapped), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {made}")


def _ids(group: list[np.ndarray]) -> pa.Array:
    edge = np.concatenate(([0], np.cumsum([len(g) for g in group])))
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *group]).astype(np.int32)))


def encoded(docs: DataFrame, model: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    def run(m: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        return [_ids(m.encode(part.column(1).to_pylist(), begin, end))]

    return _mapped(texts(docs), "text", "ids array<int>", SLICE, run, model or default_model())


def decoded(ids: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every list of ids (columns doc_id, ids)."""
    def run(m: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        lists = part.column(1)
        return [pa.array([None if x is None else m.decode([np.array(x, "<u4")])[0] for x in lists.to_pylist()], pa.string())]

    return _mapped(ids.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), "ids", "text string", SLICE, run, model or default_model())


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def run(m: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        ids = m.encode(part.column(1).to_pylist())
        return [pa.array(map(len, ids), pa.int64()), pa.array(hashlib.sha256(x).hexdigest() for x in ids), pa.array(hashlib.sha256(t.encode()).hexdigest() for t in m.decode(ids))]

    return _mapped(texts(docs), "text", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", SLICE, run, model or default_model())
