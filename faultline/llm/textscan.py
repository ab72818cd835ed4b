"""Vectorised scans of Arrow text columns, used inside Arrow batches.

Texts are worked on as one byte buffer with offsets, in slices of bounded size, so a task's memory
does not grow with its partition. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text worked on at once; a longer single text is worked on alone
SLICE_BYTES = 2 << 20
_TABLE = np.random.RandomState(7).randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_PLACES: list[np.ndarray] = [np.empty(0, np.uint64)]


def _places(n: int) -> np.ndarray:
    """An odd random number for every place in a word; unlike powers of one base they have no pattern."""
    if len(_PLACES[0]) < n:
        steps = np.arange(max(n, 2 * len(_PLACES[0]), 1 << 10), dtype=np.uint64)
        _PLACES[0] = mix(steps * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return _PLACES[0]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay within the limit (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


#: bytes of letters and digits; every byte of a character outside ASCII counts
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where a character of a script written without spaces begins, in UTF-8: Thai, Lao, Burmese, Khmer,
    kana and ideographs. Its length follows from its first byte."""
    second = np.append(data[1:], 0)
    within = lambda lo, hi: (second >= lo) & (second <= hi)
    return (
        ((data >= 0xE3) & (data <= 0xE9))
        | ((data == 0xE0) & within(0xB8, 0xBB))
        | ((data == 0xE1) & (within(0x80, 0x82) | within(0x9E, 0x9F)))
        | ((data == 0xEF) & within(0xA4, 0xAB))
        | ((data == 0xF0) & within(0xA0, 0xBF))
    )


def word_spans(
    data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray | None = None, split_unspaced: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of word bytes: any but space, tab, LF, VT, FF and CR by default.

    With ``split_unspaced`` every character of a script without spaces is a word of its own.
    """
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13))) if word_bytes is None else word_bytes[data]
    inside[-1] = False
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if split_unspaced and (data >= 0xE0).any():
        alone = np.flatnonzero(unspaced(data))
        first[alone] = True
        first[np.minimum(alone + np.where(data[alone] >= 0xF0, 4, 3), len(data))] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    ends = np.flatnonzero(before & (first | ~inside))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending spans of bytes; equal spans have equal hashes wherever they stand.

    Every byte counts by its value times a random number for its place in the span, so texts built by a
    rule are as unlikely to meet as any others.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    lo = int(starts[0])
    until_next = np.diff(starts, append=len(data))
    place = np.arange(lo, len(data)) - np.repeat(starts, until_next)
    sums = np.zeros(len(data) - lo + 1, np.uint64)
    np.cumsum(_TABLE[data[lo:]] * _places(int(until_next.max()))[place], out=sums[1:])
    value = sums[ends - lo] - sums[starts - lo]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every n-gram; a row of fewer words has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)))
    odd = [np.uint64((0x2545F4914F6CDD1D * (2 * j + 1)) & (2**64 - 1)) for j in range(n)]
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        grams += mix(words[j : len(words) - n + 1 + j] + odd[j])
    whole = np.flatnonzero(rows[: len(grams)] == rows[n - 1 :]) if len(grams) else np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    tails = np.empty(len(short), np.uint64)
    for i, r in enumerate(short):
        own = words[first[r] : first[r + 1]]
        with np.errstate(over="ignore"):
            tails[i] = sum((mix(own[j : j + 1] + odd[j]) for j in range(len(own))), np.zeros(1, np.uint64))[0] + np.uint64(len(own))
    positions = np.concatenate((whole, first[short]))
    values = mix(np.concatenate((grams[whole], tails)))
    owner = np.concatenate((rows[whole], short)) if len(whole) else short
    return values, owner.astype(np.int64), positions


def distinct_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every row, sorted by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]
