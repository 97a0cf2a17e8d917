"""Arrow string columns as flat numpy arrays: words, hashes and windows of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
# Polynomials modulo two primes: modulo a power of two some texts would collide whatever the base.
_PRIMES = (2147483647, 2147483629)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[tuple[int, int, int], np.ndarray] = {}


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    """Powers 0 to n of ``base``, and some more, modulo ``prime``."""
    size = max(CHUNK_BYTES, 1 << (n - 1).bit_length())
    if (base, prime, size) not in _powers:
        table = np.ones(1, dtype=np.uint64)
        while len(table) <= size:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)])
        if size > CHUNK_BYTES:  # for one very long text: not kept
            return table
        _powers[base, prime, size] = table
    return _powers[base, prime, size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the texts' limits in it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[limits[0]:limits[-1]], limits - limits[0]


def chunks(data: np.ndarray, limits: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first, last (exclusive), bytes, limits."""
    first, n = 0, len(limits) - 1
    while first < n:
        last = int(np.searchsorted(limits, limits[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[limits[first]:limits[last]], limits[first:last + 1] - limits[first]
        first = last


class Hasher:
    """62-bit hashes of any byte ranges of ``data``, scrambled; another ``seed`` gives other hashes.

    Two ranges that differ collide with a chance of about their length over 2^62.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        draw = np.random.default_rng([20240229, seed])
        self._parts = []
        for prime in _PRIMES:
            base, values = int(draw.integers(1 << 20, prime - 1)), draw.integers(1, prime, 256, dtype=np.uint64)
            n, p = max(1, len(data)), np.uint64(prime)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values[data] * _power_table(base, prime, n)[:len(data)] % p, out=sums[1:])
            self._parts.append((p, sums, _power_table(pow(base, -1, prime), prime, n)))

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        (p, sums, inverse), (q, others, reverse) = self._parts
        low = (sums[ends] - sums[starts]) % p * inverse[starts] % p
        high = (others[ends] - others[starts]) % q * reverse[starts] % q
        return mixed(low | (high << np.uint64(31)))


def words(data: np.ndarray, limits: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words ``[^\\x20\\x09-\\x0D]+``, or of other bytes ``between`` words."""
    if not len(data):
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, nothing
    inside = ~between[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = limits[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(limits, starts, side="right") - 1


def word_hashes(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    starts, ends, owner = words(data, limits)
    return Hasher(data).ranges(starts, ends), owner


def run_starts(owner: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(owner):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and their texts.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    n = len(hashes)
    if not n:
        return hashes, owner
    begins = run_starts(owner)
    lengths = np.diff(np.append(begins, n))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, n)):
        step = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        total[:n - k] += hashes[k:] * step if k else hashes * step
    place = np.arange(n) - np.repeat(begins, lengths)
    kept = place <= np.repeat(lengths, lengths) - size
    out, out_owner = mixed(total[kept]), owner[kept]
    short = np.flatnonzero(lengths < size)
    if len(short):
        extra = np.array([int(sum(int(hashes[begins[i] + k]) * pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)
                                  for k in range(lengths[i]))) % (1 << 64) for i in short], dtype=np.uint64)
        out = np.concatenate([out, mixed(extra + lengths[short].astype(np.uint64))])
        out_owner = np.concatenate([out_owner, owner[begins[short]]])
        order = np.argsort(out_owner, kind="stable")
        out, out_owner = out[order], out_owner[order]
    return out, out_owner
