"""Periodic runs of words, found in a dictionary of basic factors, and texts with the runs collapsed.

A word is a stretch of characters other than space, tab, LF, VT, FF and CR. A run of period q is a longest
stretch of words in which words q apart are equal and no smaller period holds.

The dictionary names every factor of 1, 2, 4 ... words: the name of a factor of 2L words is the pair of the
names of its halves, so equal names mean equal words, without hashing. Two successive occurrences of a factor
of L words that lie within 2L words are at most L apart. Inside a run of period q <= L every factor's successor
is q words on (its root is primitive), so the starts of a run are a progression of neighbours with one
distance; the stretch they cover is the run, and at no smaller distance does the factor recur, so q is its
smallest period. Levels up to the first L >= q therefore find every run of two periods and more beyond L.
A factor that occurs once in its document can have no longer factor that recurs, so only repeated factors go
on to the next level, which leaves little after two levels of usual text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.textscan import slices, text_buffer, word_spans

# fixed values: least periods in a run and least words
MIN_PERIODS = 4
MIN_WORDS = 6

RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word; equal words, and only those, have equal numbers."""
    if not len(starts):
        return np.empty(0, np.int64)
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2] = starts, ends
    bounds[-1] = ends[-1]
    # words and the gaps between them tile the buffer, so no byte is copied
    tiles = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return tiles.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)


def find_runs(names: np.ndarray, rows: np.ndarray, min_periods: int = MIN_PERIODS, min_words: int = MIN_WORDS):
    """(row, start, length, period) of every run, by row, start and period.

    ``names`` are the words of several texts one after the other and ``rows`` their texts in ascending order;
    starts count from the first word of the whole. No run spans two texts. ``min_periods`` is 3 or more.
    """
    if min_periods < 3:
        raise ValueError("a run needs three periods or more")
    found, length = [], 1
    longest = int(np.bincount(rows).max()) // min_periods if len(rows) else 0  # no longer period fits
    at, name, n = np.arange(len(names)), names, len(names)
    while len(at):
        key = rows[at] * (int(name.max()) + 1) + name
        order = np.argsort(key, kind="stable")  # by text and factor, then by place
        twin = key[order[1:]] == key[order[:-1]]
        # distance to the factor's successor, 0 where it does not recur within the window
        gap = np.zeros(len(at), np.int64)
        gap[order[:-1]] = np.where(twin, at[order[1:]] - at[order[:-1]], 0)
        hit = np.flatnonzero((gap > 0) & (gap <= length))
        if len(hit):
            p, d = at[hit], gap[hit]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(p)) - 1
            found.append(np.column_stack((p[first], p[last] - p[first] + d[first] + length, d[first])))
        if length >= longest:
            break
        # a factor twice as long recurs only if both its halves do
        recurs = np.zeros(len(at), bool)
        recurs[order[:-1]] |= twin
        recurs[order[1:]] |= twin
        number = np.zeros(n + 1, np.int64)
        number[at[recurs]] = name[recurs] + 1
        left = at[recurs]
        right = np.minimum(left + length, n)
        keep = (number[right] > 0) & (rows[np.minimum(right, n - 1)] == rows[left])
        left, right = left[keep], right[keep]
        if not len(left):
            break
        pair = number[left] * (int(number.max()) + 1) + number[right]
        at, name = left, np.unique(pair, return_inverse=True)[1]
        length *= 2
    if not found:
        return (np.empty(0, np.int64),) * 4
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= min_words) & (runs[:, 1] >= min_periods * runs[:, 2])]
    runs = np.unique(runs, axis=0)  # small periods are proposed on several levels
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return rows[runs[:, 0]], runs[:, 0], runs[:, 1], runs[:, 2]


def kept_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts + periods, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """The words of every row joined by one space."""
    sizes = ends - starts + 1  # each word with the space after it
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    source = np.arange(total) + np.repeat(starts - (stops - sizes), sizes)
    text = data[np.minimum(source, max(len(data) - 1, 0))] if total else np.empty(0, np.uint8)
    text[stops - 1] = 32
    counts = np.bincount(rows, minlength=n_rows)
    row_end = np.concatenate(([0], stops))[np.cumsum(counts)] if n_rows else np.empty(0, np.int64)
    text = np.delete(text, row_end[counts > 0] - 1)  # no space after the last word of a row
    offsets = np.concatenate(([0], row_end - np.cumsum(counts > 0))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def _runs_column(rows, starts, lengths, periods, first_word, n_rows: int) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))).astype(np.int32)
    fields = [pa.array(starts - first_word[rows] if len(rows) else starts), pa.array(lengths), pa.array(periods)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def collapse_runs(
    docs: DataFrame,
    text_col: str = "text",
    min_periods: int = MIN_PERIODS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """docs with ``n_words``, ``runs`` (by start, then period) and ``collapsed`` in the place of the text.

    A run is kept if it has ``min_words`` words and ``min_periods`` periods. ``collapsed`` holds the words joined
    by one space, without those that a run holds after its first period. Nothing is shuffled: each task works
    through its rows in slices of bounded size, a longer text alone. A null or empty text has no words, no runs
    and an empty ``collapsed``. All other columns, null ids and repeated rows are kept as they are; columns with
    the names of the new ones are replaced. An empty table gives an empty table.
    """
    made = {"n_words", "runs", "collapsed"}
    rest = [c for c in docs.columns if c != text_col and c not in made]
    docs = docs.select(*rest, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([docs.schema[c] for c in rest]).add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(rest)))
            for lo, hi in slices(offsets):
                n = hi - lo
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, rows = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
                found = find_runs(word_names(part, starts, ends), rows, min_periods, min_words)
                counts = np.bincount(rows, minlength=n)
                keep = kept_words(len(rows), *found[1:])
                cols = [
                    pa.array(counts),
                    _runs_column(*found, np.cumsum(counts) - counts, n),
                    _joined(part, starts[keep], ends[keep], rows[keep], n).cast(pa.string()),
                ]
                own = [batch.column(i).slice(lo, n) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*own, *cols], [*rest, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def strongest_run(runs: str = "runs"):
    """The run with the greatest length / period, compared exactly; ties: the first by start, then period."""
    return F.aggregate(
        runs,
        F.lit(None).cast(RUN),
        lambda best, x: F.when(
            best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x
        ).otherwise(best),
    )


def planted(docs: DataFrame) -> DataFrame:
    """docs whose text repeats where the crc32 h of the decimal doc_id is divisible by 10.

    With g = h div 10 and n words, every word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^ \\x09-\\x0D]+"), 0)
    chosen = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.struct(words.alias("w"), F.floor(h / 10).alias("g")))

    def repeated(s):
        n = F.size(s["w"])
        a = (s["g"] % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + s["g"] % 8))).cast("int")
        cycle = F.flatten(F.array_repeat(F.slice(s["w"], a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(s["w"], 1, a), F.slice(cycle, 1, n - a)), " ")

    # the words are bound once; an empty text stays
    text = F.when(F.size(chosen["w"]) > 0, F.transform(F.array(chosen), repeated)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document of (doc_id, text, runs, collapsed): numbers of its strongest run and digests of all runs."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = docs.withColumn("_top", strongest_run())
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"),
        F.col("_top.length").alias("length"),
        F.col("_top.period").alias("period"),
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
