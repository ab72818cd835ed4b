"""Toxicity by a chain of linear classifiers.

Each category has a logistic regression over the words that occur in a text and over the probabilities
of the categories before it. While training, those probabilities are out of fold: they come from models
that did not see the row, so a later model learns how reliable an earlier one really is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.textscan import WORD_BYTES, distinct_per_row, lower_ascii, slices, span_hashes, text_buffer, word_spans

#: size of the hashed vocabulary
FEATURES = 1 << 16
#: labelled rows the chain is fitted on at most, those with the smallest hash of their id
TRAIN_ROWS = 20_000
FOLDS = 3
#: weight of the squared coefficients against the sum of the rows' losses
PENALTY = 0.1
#: standard errors from which a word counts as telling; words met once or twice never do
TELLING = 2.5
ITERATIONS = 60
#: a text is rejected when the probability of the last category reaches this
THRESHOLD = 0.5


@dataclass
class Link:
    """One model of the chain: coefficients of the words and of the categories before, and the bias."""

    category: str
    words: np.ndarray
    before: np.ndarray
    bias: float

    def probability(self, features: np.ndarray, rows: np.ndarray, n_rows: int, before: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, weights=self.words[features], minlength=n_rows) + before @ self.before + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, end row, the hashed words that occur and their rows."""
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets):
        part = lower_ascii(data[offsets[lo] : offsets[hi]])
        starts, ends, rows = word_spans(part, offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
        words = span_hashes(part, starts, ends) % np.uint64(FEATURES)
        found, rows = distinct_per_row(words, rows)
        yield lo, hi, found.astype(np.int64), rows


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    value, grad = loss(x)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        q, used = grad.copy(), []
        for s, y in reversed(memory):
            a = s @ q / (s @ y)
            q -= a * y
            used.append((a, s, y))
        if memory:
            s, y = memory[-1]
            q *= s @ y / (y @ y)
        for a, s, y in reversed(used):
            q += (a - y @ q / (s @ y)) * s
        step, slope = 1.0 if memory else 1 / max(1.0, np.abs(grad).sum()), grad @ q
        while True:
            new_value, new_grad = loss(x - step * q)
            if new_value <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-12:
            memory = [*memory[-9:], (s, y)]
        done = value - new_value <= 1e-6 * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x


def _telling(features: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Words whose log odds ratio with the label is ``TELLING`` standard errors or more from zero."""
    with_word = [np.bincount(features, weights=(labels == v)[rows], minlength=FEATURES) + 0.5 for v in (1, 0)]
    without = [(labels == v).sum() + 1 - c for v, c in zip((1, 0), with_word, strict=True)]
    ratio = np.log(with_word[0] * without[1] / (with_word[1] * without[0]))
    error = np.sqrt(sum(1 / c for c in (*with_word, *without)))
    return np.abs(ratio) >= TELLING * error


def _fit(category: str, features: np.ndarray, rows: np.ndarray, before: np.ndarray, labels: np.ndarray) -> Link:
    n, k = len(labels), before.shape[1]
    kept = _telling(features, rows, labels)
    inside = kept[features]
    features, rows = features[inside], rows[inside]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, weights=x[features], minlength=n) + before @ x[FEATURES : FEATURES + k] + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        miss = p - labels
        value = np.logaddexp(0, z).sum() - labels @ z + PENALTY / 2 * (x[:-1] @ x[:-1])
        grad = np.concatenate((np.bincount(features, weights=miss[rows], minlength=FEATURES), before.T @ miss, [miss.sum()]))
        grad[:-1] += PENALTY * x[:-1]
        return value, grad

    x = minimise(loss, np.zeros(FEATURES + k + 1), ITERATIONS)
    return Link(category, x[:FEATURES], x[FEATURES : FEATURES + k], float(x[-1]))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], train_rows: int = TRAIN_ROWS, folds: int = FOLDS) -> list[Link]:
    """One model per category, in order, on the words that tell it apart in the rows it is fitted on.

    ``labels`` has doc_id and a 0/1 column per category.

    Rows with a null id or a null label are not used; of repeated labels of an id the largest value counts.
    Words are taken from whole texts in tasks; the word numbers of at most ``train_rows`` documents come to
    the driver, where the models are fitted. Without any labelled text the chain is empty.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *categories).dropna()
    chosen = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id")  # train_rows ids at most

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found, rows in _features(batch.column(1)):
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=hi - lo)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "words"])

    found = texts.mapInArrow(words, "doc_id long, words array<int>").dropDuplicates(["doc_id"])
    table = found.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()
    n = table.num_rows
    if not n:
        return []
    lists = table["words"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    features, rows = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(n), sizes)
    fold = np.arange(n) % folds
    chain: list[Link] = []
    before = np.zeros((n, 0))
    for category in categories:
        wanted = table[category].to_numpy().astype(float)
        held_out = np.zeros(n)
        for k in range(folds):
            inside, own = fold[rows] != k, fold != k
            place = np.cumsum(own) - 1
            link = _fit(category, features[inside], place[rows[inside]], before[own], wanted[own])
            held_out = np.where(own, held_out, link.probability(features, rows, n, before))
        chain.append(_fit(category, features, rows, before, wanted))
        before = np.column_stack((before, held_out))
    return chain


def score(docs: DataFrame, chain: Sequence[Link], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> ..., toxic) for every row; toxic: the last probability reaches the threshold.

    A text without words (null, empty, blank) gets what the biases say and is never called toxic. Without a
    chain nothing is toxic. Rows are scored one by one on their whole texts without a shuffle, so ties,
    repeated rows and null ids need no care; extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not chain:
        return docs.select("doc_id", F.lit(False).alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(list(chain))
    names = ["doc_id", *[f"p_{link.category}" for link in chain], "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found, rows in _features(batch.column(1)):
                before = np.zeros((hi - lo, 0))
                for link in sent.value:
                    before = np.column_stack((before, link.probability(found, rows, hi - lo, before)))
                toxic = (before[:, -1] >= threshold) & (np.bincount(rows, minlength=hi - lo) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, before.T.copy()), pa.array(toxic)], names)

    return docs.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} double" for c in names[1:-1]], "toxic boolean"]))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs scored by the chain low_quality, toxic, fitted on the labels given (quality, toxic)."""
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxicity"))
    return score(docs, fit_chain(docs, labels, ["low_quality", "toxicity"]))
