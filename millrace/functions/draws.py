"""Reproducible draws: a hash of a key in place of a random generator, so that any engine can replay them."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the parts only."""
    text = F.concat_ws(":", *(F.lit(p).cast("string") if isinstance(p, int) else p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def r6(value: Column) -> Column:
    """Rounded to six digits: sums may be added up in any order."""
    return F.round(value, 6)


#: Hashes that are worked on at a time, so that they stay in a core's cache.
AT_ONCE = 1 << 15
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).tolist()
_ADDED = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def draws(before: str, numbers: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``draw`` of the texts before + number + after, as a table (numbers, after) of unsigned 32-bit integers; ``after`` is an array of bytes.

    Texts of up to 55 bytes are hashed together, AT_ONCE at a time; longer ones one by one.
    """
    out = np.zeros((len(numbers), len(after)), np.uint32)
    head, lengths = before.encode(), np.char.str_len(after)
    tail = after.view(np.uint8).reshape(len(after), -1) if after.dtype.itemsize else np.zeros((len(after), 0), np.uint8)
    digits = np.array([len(str(x)) for x in numbers], np.int64)
    for many in np.unique(digits):
        own = np.flatnonzero(digits == many)
        first = len(head) + int(many)
        if first + tail.shape[1] > 55:
            for i in own:
                for j, end in enumerate(after):
                    out[i, j] = int.from_bytes(hashlib.md5(head + str(numbers[i]).encode() + bytes(end)).digest()[:4], "big")
            continue
        fixed = np.zeros((len(after), 64), np.uint8)
        fixed[:, : len(head)] = np.frombuffer(head, np.uint8)
        fixed[:, first : first + tail.shape[1]] = tail
        fixed[np.arange(len(after)), first + lengths] = 0x80
        fixed[:, 56:64] = (8 * (first + lengths)).astype("<u8")[:, None].view(np.uint8)
        words = np.ascontiguousarray(fixed.view("<u4").T)
        moving = np.zeros((len(own), 64), np.uint8)
        moving[:, len(head) : first] = np.array([str(numbers[i]).encode() for i in own]).view(np.uint8).reshape(len(own), -1)
        moving = moving.view("<u4").T
        rows = max(1, AT_ONCE // max(1, len(after)))
        for lo in range(0, len(own), rows):
            some = own[lo : lo + rows]
            out[some] = _first_words([words[w][None, :] | moving[w, lo : lo + rows, None] if moving[w].any() else words[w][None, :] for w in range(16)], (len(some), len(after)))
    return out


def _first_words(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of messages of one block each."""
    a, b, c, d = (np.full(shape, x) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_or(b, ~d, out=f)
            f ^= c
        a += f
        a += words[_WORDS[i]] + _ADDED[i]
        np.right_shift(a, np.uint32(32 - _SHIFTS[i]), out=t)
        a <<= np.uint32(_SHIFTS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return (a + _START[0]).byteswap()
