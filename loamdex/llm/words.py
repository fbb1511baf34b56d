"""Words and word shingles of whole Arrow columns as 64-bit numbers, without a Python step per word.

A word is a run of characters other than U+0020 and U+0009 to U+000D; A-Z count as a-z.  A word's number is a
polynomial over random byte values (mod 2**64) followed by a bijective mix; two different words agree with a chance
of about 2**-64.  Shingle numbers are built from the word numbers the same way.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; longer texts are cut at white space and put together again.
PIECE = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_SPAN_VALUES = (_VALUES.copy(), _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_VALUES[_SEPARATOR] = 0
_VALUES[65:91] = _VALUES[97:123]
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) mod 2**64; a very long text's powers are not kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 64), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 2 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and where each row begins (one more entry than rows); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashed(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of one piece, and the places where they start. begins: places where a row begins."""
    blank = _SEPARATOR[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = blank[:-1]
    edge[begins] = True
    starts = np.flatnonzero(edge & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.add.reduceat(_VALUES[data] * _power(_P, len(data)), starts)
    return mix(sums * _power(_P_INVERSE, len(data))[starts]), starts


def span_numbers(data: np.ndarray, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """Numbers of the spans of bytes that begin at ``starts`` (the first is 0) and end where the next begins; ``which`` of two independent ones."""
    sums = np.add.reduceat(_SPAN_VALUES[which][data] * _power(_P, len(data)), starts)
    return mix(sums * _power(_P_INVERSE, len(data))[starts])


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all rows one after another, where each row's words begin (one more entry than rows), and each word's first byte and
    its row's first byte within the column's bytes."""
    data, offsets = texts(column)
    found, places, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):  # cut behind white space or where a row begins
            back = end
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            blanks = np.flatnonzero(_SEPARATOR[data[max(at, end - 4096) : end]])
            back = max(row if row > at else at, (max(at, end - 4096) + blanks[-1] + 1) if len(blanks) else at)
            if back == at:  # one very long word: up to its end
                ahead = np.flatnonzero(_SEPARATOR[data[end:]])
                nearest = offsets[np.searchsorted(offsets, end, "left")]
                back = min(nearest, end + ahead[0] + 1 if len(ahead) else len(data))
            end = int(back)
        lo, hi = np.searchsorted(offsets[:-1], [at, end])
        h, s = _hashed(data[at:end], offsets[:-1][lo:hi] - at)
        found.append(h)
        places.append(s + at)
        at = end
    numbers = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = np.concatenate(places) if places else np.zeros(0, np.int64)
    return numbers, np.searchsorted(starts, offsets), starts, offsets


def shingle_numbers(numbers: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all k-word shingles row after row, and where each row's begin.  A row with fewer words (but one at least) has a single
    shingle: all its words."""
    count = np.diff(begins)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_begins = np.concatenate([[0], np.cumsum(n)])
    total = len(numbers)
    sums = np.zeros(total, np.uint64)
    for j in range(min(k, total)):
        sums[: total - j] += numbers[j:] * np.uint64(pow(0xD1342543DE82EF95, j + 1, 2**64))
    if total:
        short = np.flatnonzero((count > 0) & (count < k))
        for r in short:
            own = numbers[begins[r] : begins[r + 1]]
            sums[begins[r]] = sum(int(x) * pow(0xD1342543DE82EF95, j + 1, 2**64) for j, x in enumerate(own)) % 2**64 ^ (len(own) << 56)
    take = np.repeat(begins[:-1], n) + (np.arange(out_begins[-1]) - np.repeat(out_begins[:-1], n))
    return mix(sums[take]), out_begins


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back to the system when its rows are done: workers live on between stages, and what they keep counts."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, text: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at, have = 0, 0
    for i, n in enumerate(sizes):
        if i > at and have + n > most:
            yield batch.slice(at, i - at)
            at, have = i, 0
        have += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)
