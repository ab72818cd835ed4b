"""Token ids of whole text columns by the tokenizers library, each distinct word encoded once.

A byte-level tokenizer cuts a text into words by a fixed pattern and merges inside words only. The cuts
are found on arrays of code points; the library encodes the words not met before, and the ids of a text
are put together from those of its words. Any other kind of tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from faultline.llm.textscan import slices

LETTER, NUMBER, OTHER, SPACE = range(4)
#: words, and bytes of words, kept between slices before the table is begun anew
KEEP_WORDS = 1_000_000
KEEP_BYTES = 32 << 20
#: bytes of text worked on at once
SLICE = 2 << 20
_RANGES: list[tuple[int, int, int]] = []
_CACHES: dict[str, WordCache] = {}


def char_ranges() -> list[tuple[int, int, int]]:
    """(class, first, last) of all letters, numbers and white space, as the tokenizers library sees them.

    The library has its own edition of Unicode, so it is asked itself, once in a process.
    """
    if not _RANGES:
        from tokenizers import Regex, pre_tokenizers

        chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(chars)
            _RANGES.extend((cls, *(x if x < 0xD800 else x + 0x800 for x in (lo, hi - 1))) for _, (lo, hi) in runs)
    return _RANGES


def char_classes(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cls, lo, hi in ranges:
        table[lo : hi + 1] = cls
    return table


def cuts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the words of the texts: contractions, then letters, numbers or others with one space
    before them, then white space without the last character that goes with what follows."""
    n = len(points)
    cls = classes[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    after = np.flatnonzero(start[1:] & ~first[1:n] & (cls[1:] != SPACE) & (cls[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    at = lambda q: points[np.minimum(q, n - 1)]
    inside = lambda q: (q < n) & ~first[np.minimum(q, n)]
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[inside(quote + 1)]
    one, two = at(quote + 1), np.where(inside(quote + 2), at(quote + 2), 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    rest = quote + 1 + size
    start[rest[inside(rest)]] = True
    return np.flatnonzero(start)


class WordCache:
    """Ids of texts; made once in a worker. ``ranges``: what ``char_ranges`` gave, so that a task need not ask."""

    def __init__(self, path: str, ranges: list[tuple[int, int, int]] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        )
        self.classes = char_classes(ranges or char_ranges()) if self.by_word else None
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self._begin()

    def _begin(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.lengths = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        parts = (texts[i : i + 10_000] for i in range(0, len(texts), 10_000))
        return [e.ids for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        raw = data.tobytes()
        if not self.by_word or any(m in raw for m in self.marks):
            found = self._whole([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        n_texts = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n_texts, np.int64)
        points, char_offsets = data, offsets
        at = None
        if (data >= 128).any():
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            char_offsets = np.searchsorted(at, offsets)
        starts = cuts(points, char_offsets, self.classes)
        if at is not None:
            starts = at[starts]
        # the words tile the text, so its bytes are the values of an Arrow column of words
        tiles = pa.py_buffer(np.append(starts, len(data)))
        words = pa.LargeStringArray.from_buffers(len(starts), tiles, pa.py_buffer(raw)).dictionary_encode()
        which, distinct = words.indices.to_numpy(), words.dictionary
        if len(self.known) > KEEP_WORDS or self.known.nbytes > KEEP_BYTES:
            self._begin()
        place = pc.index_in(distinct, self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = distinct.take(pa.array(new))
            found = self._whole(fresh.to_pylist())
            place[new] = np.arange(len(new)) + len(self.known)
            self.known = pa.concat_arrays([self.known, fresh])
            self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, found), np.int64, len(found))))
            self.pool = np.concatenate((self.pool, np.array([i for x in found for i in x], np.uint32)))
        begins = np.cumsum(self.lengths) - self.lengths
        word = place[which]
        sizes = self.lengths[word]
        ends_at = np.cumsum(sizes)
        ids = self.pool[np.repeat(begins[word] - (ends_at - sizes), sizes) + np.arange(ends_at[-1])]
        per_text = np.bincount(np.searchsorted(offsets, starts, "right") - 1, weights=sizes, minlength=n_texts)
        return ids, per_text.astype(np.int64)


def word_cache(path: str, ranges: list[tuple[int, int, int]]) -> WordCache:
    """The cache of this worker process, kept for the tasks after this one."""
    if path not in _CACHES:
        _CACHES.clear()
        _CACHES[path] = WordCache(path, ranges)
    return _CACHES[path]


def encode_slices(cache: WordCache, data: np.ndarray, offsets: np.ndarray):
    """First and end row, ids and counts for slices of bounded size."""
    for lo, hi in slices(offsets, SLICE):
        ids, counts = cache.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, ids, counts
