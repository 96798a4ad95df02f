"""The beginning of MD5 digests of every left text with every right one, many at once in numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

AT_ONCE = 1 << 15  #: digests made at once
SINGLE = 55  #: bytes of a message of one block at most
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _heads(words: list[np.ndarray]) -> np.ndarray:
    """First four bytes of the digests of blocks, as a number; the sixteen words of the blocks are broadcast together.

    The first word is done after 61 of the 64 rounds.
    """
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in _START)
    for i in range(61):
        kind = i // 16
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        mixed = (c ^ d) & b ^ d if kind == 0 else (b ^ c) & d ^ c if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        mixed = mixed + a + (word + _SINES[i])
        turn = _TURNS[kind][i % 4]
        a, d, c, b = d, c, b, (mixed << np.uint32(turn) | mixed >> np.uint32(32 - turn)) + b
    return (b + np.uint32(_START[0])).byteswap()


def _by_length(texts: list[bytes]) -> dict[int, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _blocks(texts: list[bytes], at: int) -> np.ndarray:
    """Words of blocks that hold texts of one length at a place, and nothing else."""
    n = len(texts[0])
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, at : at + n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
    return out.view("<u4").astype(np.uint32)


def below(left: list[bytes], right: list[bytes], limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of left and right texts whose MD5, of both with a bar between, begins with four bytes below the left one's limit (to 2**32)."""
    for n, lefts in _by_length(left).items():
        for m, rights in _by_length(right).items():
            size = n + 1 + m
            if size > SINGLE:
                for i in lefts:
                    heads = np.array([int.from_bytes(hashlib.md5(left[i] + b"|" + right[j]).digest()[:4], "big") for j in rights])
                    found = rights[heads < limits[i]]
                    yield np.full(len(found), i), found
                continue
            fore = _blocks([left[i] + b"|" for i in lefts], 0)
            aft = _blocks([right[j] + b"\x80" for j in rights], n + 1)
            aft[:, 14] |= np.uint32(size * 8)
            alike = (aft == aft[0]).all(axis=0)
            step = max(1, AT_ONCE // len(rights))
            for at in range(0, len(lefts), step):
                some = fore[at : at + step]
                same = (some == some[0]).all(axis=0)
                words = [(some[:1, k, None] if same[k] else some[:, k, None]) | (aft[None, :1, k] if alike[k] else aft[None, :, k]) for k in range(16)]
                i, j = np.nonzero(np.broadcast_to(_heads(words), (len(some), len(rights))) < limits[lefts[at : at + step], None])
                yield lefts[at + i], rights[j]
