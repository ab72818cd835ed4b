"""Benchmark items found in training texts: rare n-gram seeds, then local alignment of words.

A seed is an n-gram of an item that chance alone would hardly put into the corpus: the product of the
corpus frequencies of its words, times the size of the corpus, is at most ``EXPECTED``. A leak copied
into many documents therefore keeps its seeds. Seeds join places of the texts to items; around the
places Smith-Waterman alignment scores what is there against the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.textscan import WORD_BYTES, gram_hashes, lower_ascii, slices, span_hashes, text_buffer, word_spans

#: words of a seed
SEED_WORDS = 4
#: chance occurrences in the whole corpus up to which an n-gram is called rare
EXPECTED = 1.0
#: items worked on in one pass over the corpus
BLOCK_ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: share of the best possible score of an item from which a passage counts as a copy
SHARE = 0.5
SCHEMA = "doc_id long, item_id long, score double, start long, end long"


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """For slices of a text column: first row, end row, bytes, word hashes and word spans."""
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets):
        part = lower_ascii(data[offsets[lo] : offsets[hi]])
        spans = word_spans(part, offsets[lo : hi + 1] - offsets[lo], WORD_BYTES, split_unspaced=True)
        yield lo, hi, part, span_hashes(part, spans[0], spans[1]), spans


def _find(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position of every value in the sorted keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def _word_counts(vocabulary):
    """Counts of the items' words, and at -1 of all words, in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, total = vocabulary.value, np.zeros(len(vocabulary.value), np.int64), 0
        for batch in batches:
            for _, _, _, words, _ in _words(batch.column(0)):
                total += len(words)
                at = _find(known, words)
                counts += np.bincount(at[at >= 0], minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(counts))), pa.array(np.append([total], counts))], ["word", "count"])

    return run


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and first and end word in the second one."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        ramp = np.arange(len(b) + 1) * -GAP
        above, top = np.zeros(len(b) + 1, np.int64), (0, 0)
        for x in a:
            row = np.zeros(len(b) + 1, np.int64)
            row[1:] = np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP)
            row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + ramp) - ramp, 0)
            at = int(row.argmax())
            if row[at] > top[0]:
                top = int(row[at]), at
            above = row
        return top

    score, end = best(item, words)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], words[:end][::-1])
    return score, end - back, end


def _windows(grams, owner, at, index):
    """(document, item, first and last diagonal) of every cluster of seeds of an item in a document."""
    seeds, seed_item, seed_at, slack = index
    left = np.searchsorted(seeds, grams, "left")
    many = np.searchsorted(seeds, grams, "right") - left
    hit = np.flatnonzero(many)
    many = many[hit]
    ends = np.cumsum(many)
    which = np.repeat(left[hit] - (ends - many), many) + np.arange(many.sum())
    doc, item = np.repeat(owner[hit], many), seed_item[which]
    line = np.repeat(at[hit], many) - seed_at[which]
    order = np.lexsort((line, item, doc))
    doc, item, line = doc[order], item[order], line[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (line[1:] - line[:-1] > slack[item[1:]])
    first = np.flatnonzero(new)
    return zip(doc[first], item[first], line[first], line[np.append(first[1:], len(doc)) - 1] if len(doc) else [], strict=True)


def _passages(sent, n: int, share: float):
    """The best passage of every (row, item) that scores enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, items, *index = sent.value
        for batch in batches:
            ids, out = batch.column(0), []
            for lo, hi, part, words, (starts, ends, rows) in _words(batch.column(1)):
                grams, owner, at = gram_hashes(words, rows, hi - lo, n)
                first_word = np.searchsorted(rows, np.arange(hi - lo + 1))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for d, i, low, high in _windows(grams, owner, at, index):
                    own, slack = items[i], index[-1][i]
                    begin, end = max(first_word[d], low - slack), min(first_word[d + 1], high + len(own) + slack)
                    score, x, y = align(own, words[begin:end])
                    value = score / (MATCH * len(own))
                    if value >= share and value > best.get((d, i), (0.0,))[0]:
                        best[d, i] = value, begin + x, begin + y - 1
                if not best:
                    continue
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                sizes = np.concatenate(([0], np.cumsum([len(x.as_py() or "") for x in batch.column(1).slice(lo, hi - lo)])))
                for (d, i), (value, x, y) in best.items():
                    span = int(chars[starts[x]] - sizes[d]), int(chars[ends[y]] - sizes[d])
                    out.append((ids[lo + int(d)].as_py(), int(item_ids[i]), value, *span))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "start", "end"])

    return run


def leaks(docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, share: float = SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, start, end): the passage of a document that copies a benchmark item best.

    Words are runs of ASCII letters and digits and of characters outside ASCII, A-Z lower-cased. ``score``
    is the alignment score over the best an item can have, ``share`` or more; start and end are code
    points. Word counts cover all documents, and every text is searched whole. Items with fewer than ``n``
    words prove nothing and match nothing, as do null and empty texts. An item without any rare n-gram
    is sought by its rarest ones. A null item id is left out; a null doc_id stays null. Repeated rows of
    docs each get their rows, repeated items count once. Extra columns are ignored; empty tables give
    no rows. Items are worked on in blocks of ``block_items``, each of which is small enough to be sent
    to every task, whatever the number of items; the documents are never shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    found = None
    n_blocks = max(1, -(-items.count() // block_items))
    for block in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "text").toPandas()
        texts = pa.array(own["text"].tolist(), pa.string())
        words, rows = [], []
        for lo, _, _, w, spans in _words(texts):
            words.append(w)
            rows.append(spans[2] + lo)
        words = np.concatenate(words) if words else np.empty(0, np.uint64)
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        vocabulary = np.unique(words)
        counts = docs.select("text").mapInArrow(_word_counts(spark.sparkContext.broadcast(vocabulary)), "word long, count long")
        counts = counts.groupBy("word").agg(F.sum("count").alias("count")).toPandas()  # one row per word of the block
        seen = np.zeros(len(vocabulary) + 1)
        seen[counts["word"].to_numpy(np.int64) + 1] = counts["count"]
        total = max(1.0, seen[0])
        chance = np.log(np.maximum(seen[1:], 1) / total)[np.searchsorted(vocabulary, words)]
        sums = np.concatenate(([0.0], np.cumsum(chance)))
        grams, owner, at = gram_hashes(words, rows, len(own), n)
        first = np.searchsorted(rows, np.arange(len(own) + 1))
        long_enough = (first[1:] - first[:-1])[owner] >= n
        grams, owner, at = grams[long_enough], owner[long_enough], at[long_enough]
        expected = np.log(total) + sums[np.minimum(at + n, len(chance))] - sums[at]
        least = np.full(len(own), np.inf)
        np.minimum.at(least, owner, expected)
        rare = expected <= np.maximum(np.log(EXPECTED), least[owner])
        order = np.argsort(grams[rare], kind="stable")
        keys, whose, where = grams[rare][order], owner[rare][order], (at - first[owner])[rare][order]
        arrays = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        # every inserted word costs a gap, so a copy that still scores ``share`` has no more of them
        slack = np.array([int(np.ceil((1 - share) * MATCH * len(x) / -GAP)) + n for x in arrays], np.int64)
        sent = spark.sparkContext.broadcast((own["item_id"].to_numpy(np.int64), arrays, keys, whose, where, slack))
        part = docs.mapInArrow(_passages(sent, n, share), SCHEMA)
        found = part if found is None else found.union(part)
    return found
