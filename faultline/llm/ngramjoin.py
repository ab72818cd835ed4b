"""Exact Jaccard self-join of documents on word n-grams, filtered under several global token orders.

Every text becomes the set of its distinct n-grams. Under any one order of all tokens, two sets with
Jaccard similarity t or more share a token among the first ``size - ceil(t * size) + 1`` of each. The
orders put tokens that are frequent in the corpus last and differ in how they order the rest, so a pair
has to pass the prefix test of each order before it is verified on its whole sets. The test asks not for
one shared token but for as many as the sizes call for.

Neighbours in shuffled lines and the document in which a token stands first in order are tried first. Pairs that
are then still in different components are sought under every token by how far it stands from the start of
either set: at the first common token of a pair, what is left of the sets bounds what they have in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.store import in_filter, key_filter, stored
from faultline.llm.textscan import gram_hashes, lower_ascii, mix, slices, span_hashes, text_buffer, word_spans

#: frequency classes are kept for this many hash buckets of tokens, whatever the size of the corpus
BUCKET_BITS = 18
#: a token whose bucket holds more than this many times the mean (plus a constant) is called frequent
FREQUENT = 2.0
#: parts that the documents of one frequent token are dealt into
SALTS = 64
#: bins of the token counts that bound how much two sets can have in common
BINS = 256
#: lines in which each document is held against its neighbours before all pairs across components are
LINES = 2
#: bytes of text whose tokens are worked out at once; some 50 bytes of working memory go with each
SLICE_BYTES = 1 << 19
#: documents under one token up to which all their pairs are listed; beyond, first the pairs of sizes and ranks
SMALL = 16


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some ``SLICE_BYTES`` of text, so that what is copied of them stays as small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _token_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, end row, n-gram hashes and their rows inside the slice."""
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets, SLICE_BYTES):
        part = lower_ascii(data[offsets[lo] : offsets[hi]])
        starts, ends, rows = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        tokens, owner, _ = gram_hashes(span_hashes(part, starts, ends), rows, hi - lo, n)
        yield lo, hi, tokens, owner


def _ordered(tokens: np.ndarray, rows: np.ndarray, n_rows: int, order: int, classes: np.ndarray):
    """Distinct tokens of every row in the given global order: tokens, rows, rank in the row, sizes."""
    row_bits = max(1, int(n_rows).bit_length())
    place = mix(tokens + np.uint64((order * 0x632BE59BD9B4E019 + 1) & (2**64 - 1)))
    cls = classes[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
    key = (rows.astype(np.uint64) << np.uint64(64 - row_bits)) | (cls << np.uint64(58 - row_bits))
    key |= place >> np.uint64(row_bits + 6)
    by = np.argsort(key)
    tokens, rows, key = tokens[by], rows[by], key[by]
    same = key[1:] == key[:-1]
    if (same & (tokens[1:] != tokens[:-1])).any():  # the key holds a part of the hash only
        by = np.lexsort((tokens, key))
        tokens, rows = tokens[by], rows[by]
    new = np.ones(len(key), bool)
    new[1:] = ~same | (tokens[1:] != tokens[:-1])
    tokens, rows = tokens[new], rows[new]
    sizes = np.bincount(rows, minlength=n_rows)
    rank = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
    return tokens, rows, rank, sizes


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0).cast(pa.int64())


def _set_keys(n: int):
    """Per document the size and two checksums of its set; per task the token counts by hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(1 << BUCKET_BITS, np.uint8)
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in _parts(batches):
            ids = _ids(batch)
            for lo, hi, tokens, owner in _token_sets(batch.column(1), n):
                tokens, rows, _, sizes = _ordered(tokens, owner, hi - lo, 0, flat)
                counts += np.bincount((tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                keys = [_checksum(t, sizes).view(np.int64) for t in (tokens, mix(tokens))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(hi - lo, np.int32)), ids.slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), *map(pa.array, keys)],
                    ["kind", "id", "n", "a", "b"],
                )
        at = np.flatnonzero(counts)
        zero = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(counts[at]), zero, zero], ["kind", "id", "n", "a", "b"]
        )

    return run


def _prefixes(n: int, percent: int, sent):
    """The prefix tokens of every document under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        for batch in _parts(batches):
            for lo, hi, tokens, owner in _token_sets(batch.column(1), n):
                tokens, rows, rank, sizes = _ordered(tokens, owner, hi - lo, 0, classes)
                key = _checksum(tokens, sizes)
                once = np.zeros(hi - lo, bool)  # equal sets of a slice are listed once
                once[np.unique(key, return_index=True)[1]] = True
                need = sizes - (percent * sizes + 99) // 100 + 1
                keep = (rank < need[rows]) & once[rows]
                tokens, rows = tokens[keep], rows[keep]
                frequent = classes[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (tokens.view(np.int64), key[rows].view(np.int64), sizes[rows].astype(np.int32), rank[keep].astype(np.int32), frequent)],
                    ["token", "a", "n", "rank", "frequent"],
                )

    return run


def _lists(values: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _chosen(batch: pa.RecordBatch, bitmap: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of the documents that the bitmap lets through."""
    ids = _ids(batch)
    keep = pa.array(in_filter(bitmap, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))
    return ids.filter(keep), batch.column(1).filter(keep)


def _checksum(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens * np.uint64(3) + np.uint64(3)), out=sums[1:])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def _marks(n: int, sent, wanted):
    """Short signatures: the token counts in hash bins, ``BINS`` or more for larger sets, whose common part
    bounds the number of common tokens from above. They are null where a count doesn't fit a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bitmap = sent.value, wanted.value
        for batch in _parts(batches):
            ids, texts = _chosen(batch, bitmap)
            for lo, hi, tokens, owner in _token_sets(texts, n):
                t, r, _, sizes = _ordered(tokens, owner, hi - lo, 0, classes)
                width = np.maximum(BINS, 1 << np.ceil(np.log2(np.maximum(1, sizes / 4))).astype(np.int64))
                ends = np.cumsum(width)
                counts = np.bincount((ends - width)[r] + (t & (width[r] - 1).astype(np.uint64)).astype(np.int64), minlength=ends[-1])
                fits = np.maximum.reduceat(counts, ends - width) < 128
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.append(~fits, False))
                bins = pa.ListArray.from_arrays(offsets, pa.array(np.minimum(counts, 127).astype(np.int8)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(_checksum(t, sizes).view(np.int64)), pa.array(sizes.astype(np.int32)), bins], ["node", "a", "n", "bins"]
                )

    return run


def _whole_sets(n: int, percent: int, orders: int, sent, wanted):
    """The whole sets, and their prefixes under the further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bitmap = sent.value, wanted.value
        for batch in _parts(batches):
            ids, texts = _chosen(batch, bitmap)
            for lo, hi, tokens, owner in _token_sets(texts, n):
                lists = []
                for order in range(1, orders):
                    t, r, rank, sizes = _ordered(tokens, owner, hi - lo, order, classes)
                    first = rank < (sizes - (percent * sizes + 99) // 100 + 1)[r]
                    lists.append(_lists(t[first].view(np.int64), r[first], hi - lo))
                t, r, _, sizes = _ordered(tokens, owner, hi - lo, 0, classes)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(_checksum(t, sizes).view(np.int64)), _lists(t.view(np.int64), r, hi - lo), *lists],
                    ["node", "a", "tokens", *[f"p{k}" for k in range(1, orders)]],
                )

    return run


def _close(n1: str, n2: str, percent: int):
    """Whether two sizes allow the similarity."""
    return (F.col(n1) * 100 >= F.col(n2) * percent) & (F.col(n2) * 100 >= F.col(n1) * percent)


def _enough(shared, n1, n2, percent: int):
    """Whether two prefixes have so many tokens in common that the whole sets can be similar.

    Of two sets, the one whose prefix ends first has no further common token inside it, so all common
    tokens are the shared ones and at most those behind that prefix.
    """
    behind = F.greatest(*[F.floor((n * percent + 99) / 100) - 1 for n in (n1, n2)])
    return (shared + behind) * (100 + percent) >= (n1 + n2) * percent


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bins allow the similarity."""
    for x in "uv":
        pairs = pairs.join(marks.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("a", "n", "bins")]), [x, f"a{x}"])

    def folded(x: str, y: str):
        half = F.size(y)
        fold = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get(x, i).cast("int") + F.get(x, i + half))
        return F.when(F.size(x) > half, fold).otherwise(F.transform(x, lambda c: c.cast("int")))

    both = F.zip_with(folded("binsu", "binsv"), folded("binsv", "binsu"), lambda x, y: F.least(x, y))
    most = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    most = F.coalesce(most, F.least("nu", "nv"))
    return pairs.filter(most * 100 >= (F.col("nu") + F.col("nv") - most) * percent).select("u", "au", "v", "av")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """Pairs (u, v) that share enough prefix tokens under every further order and have the wanted similarity."""
    names = ["a", "tokens", *[f"p{k}" for k in range(1, orders)]]
    for x in "uv":
        pairs = pairs.join(sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in names]), [x, f"a{x}"])
    for k in range(1, orders):
        shared = F.size(F.array_intersect(f"p{k}u", f"p{k}v"))
        pairs = pairs.filter(_enough(shared, F.size("tokensu"), F.size("tokensv"), percent))
    common = F.size(F.array_intersect("tokensu", "tokensv"))
    return pairs.filter(common * 100 >= (F.size("tokensu") + F.size("tokensv") - common) * percent).select("u", "v")


def _pair(first: str, second: str) -> list:
    """The columns (u, au, v, av) of a pair of structs, the larger node first."""
    u, v = F.greatest(first, second), F.least(first, second)
    return [u["node"].alias("u"), u["a"].alias("au"), v["node"].alias("v"), v["a"].alias("av")]


def _chain(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of neighbours when the documents of every token stand in a shuffled line.

    A frequent token's line is cut into salted parts, whose ends are put in a line of their own.
    """
    part = F.when(F.col("frequent"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)
    place = F.xxhash64("node", F.pmod("token", F.lit(3)) + 3 * seed)
    rows = rows.select("token", "frequent", part.alias("part"), F.struct("node", "a").alias("s"), "n", place.alias("h"))

    def neighbours(df: DataFrame, w) -> DataFrame:
        df = df.select("s", "n", F.lag("s").over(w).alias("s2"), F.lag("n").over(w).alias("n2"))
        return df.filter(_close("n", "n2", percent)).select(*_pair("s", "s2"))

    inner = neighbours(rows, Window.partitionBy("token", "part").orderBy("h", "s"))
    heads = rows.filter("frequent").groupBy("token", "part").agg(F.min(F.struct("h", "s", "n")).alias("x"))
    outer = neighbours(heads.select("token", "part", "x.*"), Window.partitionBy("token").orderBy("part"))
    return inner.union(outer).distinct()


def _hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of every document and the one in which a token stands nearest to the start, so that has the fewest
    tokens of its own. Documents that share most of their tokens and differ in the rest meet there."""
    first = rows.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("rank", "n", "node", "a")).alias("x")).filter("m > 2")
    first = first.select("token", F.struct("x.node", "x.a").alias("s2"), F.col("x.n").alias("n2"))
    met = rows.select("token", F.struct("node", "a").alias("s"), "n").join(first, "token")
    return met.filter((F.col("s") != F.col("s2")) & _close("n", "n2", percent)).select(*_pair("s", "s2")).distinct()


def _ahead(percent: int):
    """Whether two sets of nu and nv tokens can be similar if the token at their ranks is the first they have in common."""
    left = F.least(F.col("nu") - F.col("ranku"), F.col("nv") - F.col("rankv"))
    return left * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes in different components that can be similar, of rows (token, node, a, n, rank, root).

    All pairs under tokens of few documents are listed, and counted by what they share.
    Under a token of many documents, first the sizes, ranks and numbers of such tokens that stand there are paired,
    however many documents have them, and then the documents of those pairs that allow the similarity if the pair
    shares no token of few documents.
    """
    mixed = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    mixed = stored(rows.join(mixed.select("token", "m"), "token"), "mixed")
    # so many tokens of many documents a pair has in common at most
    heavy = mixed.filter(F.col("m") > SMALL).groupBy("node", "a").agg(F.count("*").alias("k"))
    mixed = mixed.join(heavy, ["node", "a"], "left").fillna(0, ["k"]).withColumnRenamed("node", "")
    side = lambda df, x: df.select("token", *[F.col(c).alias(f"{c}{x}") for c in df.columns if c not in ("token", "m")])
    ends = ["u", "au", "v", "av"]

    few = mixed.filter(F.col("m") <= SMALL)
    few = side(few, "u").join(side(few, "v"), "token").filter((F.col("u") > F.col("v")) & (F.col("rootu") != F.col("rootv")) & _close("nu", "nv", percent))
    few = few.groupBy(*ends, "nu", "nv", "ku", "kv").agg(F.count("*").alias("shared"))
    few = few.filter(_enough(F.col("shared") + F.least("ku", "kv"), F.col("nu"), F.col("nv"), percent)).select(*ends)

    many = stored(mixed.filter(F.col("m") > SMALL), "many")
    cells = many.groupBy("token", "n", "rank", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    cell = [["nu", "ranku", "ku"], ["nv", "rankv", "kv"]]
    enough = _enough(F.least("ku", "kv"), F.col("nu"), F.col("nv"), percent)
    order = F.struct(*cell[0]) <= F.struct(*cell[1])
    several = F.least("lou", "lov") < F.greatest("hiu", "hiv")
    cells = side(cells, "u").join(side(cells, "v"), "token").filter(order & several & _close("nu", "nv", percent) & _ahead(percent) & enough)
    cells = stored(cells.select("token", *cell[0], *cell[1]), "cells")
    many = cells.join(side(many, "u"), ["token", *cell[0]]).join(side(many, "v"), ["token", *cell[1]])
    many = many.filter((F.col("rootu") != F.col("rootv")) & ((F.struct(*cell[0]) != F.struct(*cell[1])) | (F.col("u") > F.col("v"))))
    ordered = [F.when(F.col("u") > F.col("v"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(ends, ["v", "av", "u", "au"], strict=True)]
    return few.union(many.select(*ordered)).distinct()


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than ``n`` words
    is one token, its whole sequence; a null, empty or blank text has none, links with nothing and is its
    own component. Two texts link when ``100 * common >= percent * union``; component_id is the smallest
    id reachable. Equal sets are one node, known by its smallest id. Repeated rows each get a row. A row
    without id keeps a null id and takes the component of the documents with an equal set, null if there
    are none. Extra columns are ignored. An empty table gives no rows.

    The frequency classes come from counts over all documents in a table of fixed size; which class a
    token falls into changes the amount of work, never the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = stored(docs.mapInArrow(_set_keys(n), "kind int, id long, n long, a long, b long"), "sets")
    keys = scan.filter("kind = 0").select("id", "n", "a", "b")
    counts = scan.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = FREQUENT * total / (1 << BUCKET_BITS) + 8
    hot = counts.filter(F.col("n") > limit).toPandas()  # one row per bucket at most
    classes = np.zeros(1 << BUCKET_BITS, np.uint8)
    classes[hot["id"].to_numpy(np.int64)] = np.minimum(63, 1 + np.log2(np.maximum(1, hot["n"].to_numpy(float) / limit)) * 2).astype(np.uint8)
    sent = spark.sparkContext.broadcast(classes)

    nodes = stored(keys.filter("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("node")).filter("node is not null"), "nodes")

    prefixes = docs.mapInArrow(_prefixes(n, percent, sent), "token long, a long, n int, rank int, frequent boolean")
    same = Window.partitionBy("token")
    rare = prefixes.filter("not frequent").withColumn("lo", F.min("a").over(same)).withColumn("hi", F.max("a").over(same))
    shared = rare.filter("lo < hi").drop("lo", "hi").union(prefixes.filter("frequent")).distinct()
    shared = stored(shared, "shared")
    tokens = stored(shared.join(nodes.select("a", F.col("n").cast("int").alias("n"), "node"), ["a", "n"]), "tokens")

    repeated = not keys.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty()

    def scan_of(nodes_wanted: DataFrame, body, schema: str, label: str) -> DataFrame:
        bitmap = spark.sparkContext.broadcast(key_filter(nodes_wanted, "node"))
        found = docs.mapInArrow(body(bitmap), schema)
        return stored(found.dropDuplicates(["node", "a"]) if repeated else found, label)

    marks = scan_of(tokens, lambda b: _marks(n, sent, b), "node long, a long, n int, bins array<byte>", "marks")
    lists = "".join(f", p{k} array<long>" for k in range(1, orders))

    def linked(pairs: DataFrame) -> DataFrame:
        possible = stored(_possible(pairs, marks, percent), "possible")
        ends = possible.select(F.explode(F.array("u", "v")).alias("node"))
        sets = scan_of(ends, lambda b: _whole_sets(n, percent, orders, sent, b), f"node long, a long, tokens array<long>{lists}", "whole")
        return stored(_verified(possible, sets, percent, orders), "links")

    lines = [_chain(tokens, seed, percent) for seed in range(LINES)]
    edges = linked(reduce(DataFrame.union, [*lines, _hubs(tokens, percent)]).distinct())
    roots = stored(components(edges, "u", "v"), "roots")
    # what is left: all pairs under a common token whose ends are not yet in one component
    rows = tokens.join(roots.withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node"))
    rest = _across(rows.select("token", "node", "a", "n", "rank", "root"), percent)
    edges = edges.union(linked(rest))
    roots = stored(components(edges, "u", "v"), "roots")

    own = keys.join(nodes, ["n", "a", "b"], "left").join(roots, "node", "left")
    return own.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "node", "id").alias("component_id"),
    )
