"""Byte-level BPE ids with the tokenizers library, for executors.

The library splits a text by a fixed pattern and merges each piece on its own; pieces repeat
a lot. Here the split is done for a whole batch with array operations and every distinct
piece goes to the library's model once; its ids are kept in arrays of bounded size. Pieces of
up to 32 characters are found by a 63-bit hash, scrambled after every step, longer ones by
their content. That path is taken for texts in Latin script and common punctuation, where
the classes of characters are known; every other text, and one that holds the content of an
added token (such as ``<|endoftext|>``, one id), goes to the library whole. So does every
text if the vocabulary's file asks for another way of splitting than the one known here.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

from .common import mix64

PIECES = 2_000_000  #: most pieces kept by a worker
SHORT, LONG_CHARS = 32, 16 << 20  #: characters of pieces found by a hash; of all longer ones kept, about
BATCH_CHARS = 1 << 20

LETTER, DIGIT, SPACE, OTHER, FOREIGN = range(5)


def _classes() -> np.ndarray:
    """The class of every code point below 0x2100; those that need the library are FOREIGN."""
    import unicodedata

    kind = np.full(0x2101, FOREIGN, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]:
        name = unicodedata.category(chr(c))
        kind[c] = LETTER if name[0] == "L" else DIGIT if name[0] == "N" else OTHER
    kind[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return kind


def _printable() -> dict[int, str]:
    """How the vocabulary writes bytes: printable ones as themselves, the others from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def splits_as_known(file: dict) -> bool:
    """Whether a vocabulary's file asks for byte-level pairs, split by that kind's own pattern, and nothing more."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = not file.get("normalizer") and not file.get("truncation") and not file.get("padding")
    pieces = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    pairs = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return bool(plain and pieces and pairs)


class Encoder:
    """Ids of texts; 16 bits each where the vocabulary allows it, else 32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = splits_as_known(json.loads(self.library.to_str()))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.code, self.dtype = ("H", np.dtype("<u2")) if self.library.get_vocab_size() <= 1 << 16 else ("I", np.dtype("<u4"))
        self.kind, self.bytes = _classes(), _printable()
        self.forget()

    def forget(self) -> None:
        self.long, self.long_chars = {}, 0
        self.keys, self.at, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.known:
            return [self.whole(t) for t in texts]
        out: list[np.ndarray] = []
        group, size = [], 0
        for t in texts:
            if group and size + len(t) > BATCH_CHARS:
                out += self._batch(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        return out + self._batch(group) if group else out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edge = np.concatenate(([0], np.cumsum(lengths)))
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(points):
            return [np.zeros(0, self.dtype) for _ in texts]
        kind = self.kind[np.minimum(points, len(self.kind) - 1)]
        strange = np.unique(np.searchsorted(edge, np.flatnonzero(kind == FOREIGN), "right") - 1).tolist()
        if held := [a for a in self.added if a in joined]:
            strange = sorted({*strange, *(i for i, t in enumerate(texts) if any(a in t for a in held))})
        start = self._starts(points, kind, edge[:-1][lengths > 0], edge[1:][lengths > 0])
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(points))
        h = self._keys(joined, points, begin, end)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self._learn(joined, kind, keys, begin[first], end[first])
        row = np.searchsorted(self.keys, keys)
        count = self.count[row][inverse]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(self.at[row][inverse] - total[:-1], count) + np.arange(total[-1])]
        cut = total[np.searchsorted(begin, edge)]
        out = [ids[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
        for i in strange:
            out[i] = self.whole(texts[i])
        return out

    def _starts(self, points: np.ndarray, kind: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin: at changes of class, with one blank drawn to what follows it."""
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[firsts] = edge[ends] = True
        change = edge.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        start = change[:n].copy()
        # the last of some white space before a word stands alone or goes to the word
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        start |= last
        drawn = np.zeros(n, bool)
        drawn[1:] = last[:-1] & (points[:-1] == 0x20)
        start &= ~drawn
        # 's 't 'm 'd 're 've 'll after anything but a blank
        mark = np.flatnonzero((points == 0x27) & start & change[1:])
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
        if len(mark):
            one = points[mark + 1]
            far = np.minimum(mark + 2, n - 1)
            two = np.where((mark + 2 < n) & ~edge[far], points[far], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for hit, size in ((mark[short], 2), (mark[long & ~short], 3)):
                start[hit + 1] = False
                after = hit[hit + size < n] + size
                start[after[(kind[after] == LETTER)]] = True
        return start

    def _keys(self, joined: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A key of each piece: a hash below 2^63 for short ones, a number of its own above for every long one."""
        if len(self.keys) > PIECES or self.long_chars > LONG_CHARS:
            self.forget()
        length = end - begin
        out, step = mix64(length.astype(np.uint64)), np.uint64(0x9E3779B97F4A7C15)
        point = np.concatenate((np.minimum(points, len(self.kind) - 1).astype(np.uint64), np.zeros(4, np.uint64)))
        for i in range(0, SHORT, 4):
            live = np.flatnonzero(length > i)
            if not len(live):
                break
            at, left, four = begin[live] + i, length[live] - i, np.zeros(len(live), np.uint64)
            for k in range(4):
                four |= np.where(left > k, point[at + k], 0) << np.uint64(16 * k)
            out[live] = mix64(out[live] * step + four)
        out &= np.uint64(2**63 - 1)
        for k in np.flatnonzero(length > SHORT).tolist():
            text = joined[begin[k] : end[k]]
            if text not in self.long:
                self.long[text] = len(self.long)
                self.long_chars += len(text)
            out[k] = 2**63 + self.long[text]
        return out

    def _learn(self, joined: str, kind: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        row = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        old = row < len(self.keys)
        new[old] = self.keys[row[old]] != keys[old]
        if not new.any():
            return
        tokenize, table, ids, edge = self.library.model.tokenize, self.bytes, array(self.code), [0]
        foreign = np.concatenate(([0], np.cumsum(kind == FOREIGN)))
        known = foreign[end[new]] == foreign[begin[new]]
        for a, z, ok in zip(begin[new].tolist(), end[new].tolist(), known.tolist()):
            if ok:  # those of foreign texts are not used
                ids.extend([t.id for t in tokenize(joined[a:z].encode().decode("latin-1").translate(table))])
            edge.append(len(ids))
        edge = np.array(edge, np.int64)
        place = np.searchsorted(self.keys, keys[new])
        self.keys, self.at, self.count = np.insert(self.keys, place, keys[new]), np.insert(self.at, place, len(self.pool) + edge[:-1]), np.insert(self.count, place, np.diff(edge))
        self.pool = np.concatenate((self.pool, np.frombuffer(ids, self.dtype)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, whatever number of tasks it runs."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
