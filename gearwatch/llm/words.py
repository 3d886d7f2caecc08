"""Words of many texts at once as numpy arrays: where they lie in the bytes and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that one call works on; a longer text is a call of its own.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240601))
#: A random number for each byte value, and the odd base of the polynomial hashes.
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

SPACES = np.zeros(256, np.uint8)
SPACES[[9, 10, 11, 12, 13, 32]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes for text with marks: 0 letters, digits and bytes above ASCII, 1 white space, 2 any other mark.
MARKS = np.full(256, 2, np.uint8)
MARKS[128:] = 0
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = 0
MARKS[[9, 10, 11, 12, 13, 32]] = 1


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of each number over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words(buf: np.ndarray, classes: np.ndarray = SPACES, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes of one class, white space left out."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    kind = classes[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(buf)]])
    word = kind[starts] != 1
    if not hashed:
        return starts[word], ends[word], np.zeros(0, np.uint64)
    place = np.arange(len(buf)) - np.repeat(starts, ends - starts)
    total = np.add.reduceat(BYTE_CODE[buf] * powers(BASE, int((ends - starts).max()))[place], starts)
    return starts[word], ends[word], mix(total[word])


def batches(texts: Sequence[str], lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, text starts): runs of texts of about ``CHUNK`` bytes, a line feed after each text."""
    at = 0
    while at < len(texts):
        raw, size, stop = [], 0, at
        while stop < len(texts) and (size < CHUNK or stop == at):
            raw.append((texts[stop] or "").encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            stop += 1
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        yield at, stop, LOWER[buf] if lower else buf, starts
        at = stop


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if k <= 8:
        for j in range(k):
            out = out * BASE + hashes[j : j + n]
        return mix(out)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * powers(inverse, n))
