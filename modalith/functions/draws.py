"""The md5 draws of a bootstrap in arrays: what functions/stats.draw says for one slot, for many at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Slots hashed at once: the arrays of a round stay in a core's cache.
BLOCK = 8192
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


@cache
def _rounds() -> list[tuple[int, int, int, int]]:
    """(round of four, word, shift, constant) of the 64 steps of md5."""
    step = (lambda k: k, lambda k: (5 * k + 1) % 16, lambda k: (3 * k + 5) % 16, lambda k: 7 * k % 16)
    return [(k // 16, step[k // 16](k), SHIFTS[k // 16][k % 4], int(abs(math.sin(k + 1)) * 2**32) & 0xFFFFFFFF) for k in range(64)]


def _md5_head(words: list[int | np.ndarray], size: int) -> np.ndarray:
    """The first 32 bits, read as a big-endian number, of the md5 of one-block messages; words are alike in all (int) or not."""
    u = np.uint32
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(size, x, u) for x in start)
    f, t = np.empty(size, u), np.empty(size, u)
    for kind, w, shift, constant in _rounds():
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[w]
        if isinstance(word, int):
            np.add(f, u((constant + word) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, u(constant), out=f), np.add(f, word, out=f)
        np.left_shift(f, u(shift), out=t), np.right_shift(f, u(32 - shift), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # the oldest array takes the new value
        a, b, c, d = d, a, b, c
    return (a + u(start[0])).byteswap()


def _heads(seed: str, b: np.ndarray, j: np.ndarray, digits: tuple[int, int]) -> np.ndarray:
    """_md5_head of seed:b:j for arrays of numbers that have so many digits each."""
    prefix = f"{seed}:".encode()
    text = prefix + bytes(digits[0]) + b":" + bytes(digits[1])
    if len(text) > 55:
        raise ValueError("a draw's message must fit one block of md5")
    block = text + b"\x80" + bytes(55 - len(text)) + (8 * len(text)).to_bytes(8, "little")
    words: list[int | np.ndarray] = [int.from_bytes(block[k : k + 4], "little") for k in range(0, 64, 4)]
    for left, end, count in ((b, len(prefix) + digits[0], digits[0]), (j, len(text), digits[1])):
        for at in range(end - 1, end - count - 1, -1):
            rest = left // np.uint32(10)
            digit = (left - rest * np.uint32(10) + np.uint32(48)) << np.uint32(8 * (at % 4))
            old = words[at // 4]
            words[at // 4] = digit + (np.uint32(old) if isinstance(old, int) else old)
            left = rest
    return _md5_head(words, len(b))


def _classes(start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, digits) of ranges of numbers with as many digits."""
    while start < stop:
        end = min(stop, 10 ** len(str(start)))
        yield start, end, len(str(start))
        start = end


def taken(seed: str, first: int, last: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(draws, clusters) in blocks: which of n clusters each of the n slots of the draws from first to before last takes;
    slot j of draw b takes md5(seed:b:j) mod n."""
    if n >= 2**32:
        raise ValueError("draws are numbers below 2**32")
    for b0, b1, b_digits in _classes(first, last):
        for j0, j1, j_digits in _classes(0, n):
            span = j1 - j0
            for at in range(0, (b1 - b0) * span, BLOCK):
                place = np.arange(at, min(at + BLOCK, (b1 - b0) * span), dtype=np.int64)
                row = place // span
                b = (row + b0).astype(np.uint32)
                yield b, _heads(seed, b, (place - row * span + j0).astype(np.uint32), (b_digits, j_digits)) % np.uint32(n)


def weights(seed: str, first: int, last: int, n: int, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(b, w) of the draws from first to before last: how often draw b takes each of n clusters. At most `most` counts, or
    those of one draw, are held at once."""
    step = max(1, most // n)
    for start in range(first, last, step):
        end = min(last, start + step)
        w = np.zeros((end - start) * n, np.int32)
        for b, i in taken(seed, start, end, n):
            np.add.at(w, (b.astype(np.int64) - start) * n + i, 1)
        yield from zip(range(start, end), w.reshape(end - start, n))
