"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A table has three parts of ``WIDTH`` cells; each digest falls into one cell of each part, and a cell holds
how many digests fell into it, their xor and the xor of their checks. Subtracting the cells of two versions
leaves the digests that differ, which are peeled off one pure cell after the other. When that gets stuck,
the paragraphs are dealt into many tables by a hash, more with every attempt, and peeled again.
Everything here is DataFrame expressions on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: cells in each of the three parts of a table
WIDTH = 12
#: rounds of peeling; a table of this size that can be peeled needs fewer
ROUNDS = 12
#: digests dealt into one table at the first retry; each further one halves it
LOAD = 12
RETRIES = 3
#: blocks of neighbouring ids for each shuffle partition
BLOCKS = 4
NO_ID = -(1 << 63)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _xor(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[field]))


def _item(digest: Column, seed: int, sign: Column) -> Column:
    """A digest with its check, its sign and the numbers of its three cells."""
    cells = [(F.pmod(F.xxhash64(digest, F.lit(seed), F.lit(j)), F.lit(WIDTH)) + j * WIDTH).cast("int") for j in range(3)]
    return F.struct(
        digest.alias("key"), F.xxhash64(digest, F.lit(97)).alias("check"), sign.alias("n"), *[c.alias(f"c{j}") for j, c in enumerate(cells)]
    )


def _added(cells: Column, items: Column, sign: int) -> Column:
    """The cells after adding (1) or taking away (-1) the items."""

    def changed(old: Column, own: Column) -> Column:
        n = F.aggregate(own, F.lit(0), lambda a, x: a + x["n"])
        return F.struct(
            (old["n"] + n * sign).alias("n"),
            old["key"].bitwiseXOR(_xor(own, "key")).alias("key"),
            old["check"].bitwiseXOR(_xor(own, "check")).alias("check"),
        )

    def each(bound: Column) -> Column:
        return F.transform(
            cells, lambda old, i: _let(F.filter(bound, lambda x: (x["c0"] == i) | (x["c1"] == i) | (x["c2"] == i)), lambda own: changed(old, own))
        )

    return _let(items, each)


def _empty() -> Column:
    return F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check")), 3 * WIDTH)


def digests(text: Column) -> Column:
    """64-bit digests of the distinct paragraphs of a text that are not empty."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p)))


def table(keys: Column, seed: int = 0) -> Column:
    """The cells of a set of digests."""
    return _added(_empty(), F.transform(keys, lambda d: _item(d, seed, F.lit(1))), 1)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check"))
    )


def peeled(cells: Column, seed: int = 0) -> Column:
    """The digests in a difference of tables, signed; null where peeling gets stuck."""

    def after(state: Column, items: Column) -> Column:
        found = F.transform(items, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))
        cells = F.when(F.size(items) > 0, _added(state["cells"], items, -1)).otherwise(state["cells"])
        return F.struct(cells.alias("cells"), F.concat(state["found"], found).alias("found"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"], F.lit(97)) == c["check"]))
        return _let(F.array_distinct(F.transform(pure, lambda c: _item(c["key"], seed, c["n"]))), lambda items: after(state, items))

    def rest(s: Column) -> Column:
        return F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))

    nothing = F.array().cast("array<struct<key:bigint,n:int>>")
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), nothing.alias("found")), step)
    return _let(end, lambda s: F.when(~rest(s), s["found"]))


def _retried(a: Column, b: Column, attempt: int) -> Column:
    """The number of digests that differ, from many tables of about LOAD / 2 ** (attempt - 1) digests each."""
    groups = F.ceil((F.size(a) + F.size(b)) / (LOAD / 2 ** (attempt - 1))).cast("int") + 1

    def part(keys: Column, g: Column) -> Column:
        return table(F.filter(keys, lambda d: F.pmod(F.xxhash64(d, F.lit(1000 + attempt)), groups) == g), attempt)

    def counted(found: Column) -> Column:
        return F.when(~F.exists(found, lambda n: n.isNull()), F.aggregate(found, F.lit(0), lambda s, n: s + n))

    found = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.size(peeled(minus(part(a, g), part(b, g)), attempt)))
    return _let(found, counted)


def difference(a: Column, b: Column, first: Column) -> Column:
    """How many digests the sets a and b (arrays of distinct digests) do not have in common.

    ``first`` is the peeled difference of their small tables, null if that got stuck. What no retry can peel
    is counted exactly.
    """
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.coalesce(F.when(first.isNotNull(), F.size(first)), *[_retried(a, b, i + 1) for i in range(RETRIES)], exact)


def likeness(a: Column, b: Column, first: Column) -> Column:
    """Share of common digests among all digests of both sets; 1 for two empty sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(_let(difference(a, b, first), lambda apart: (total - apart) / (total + apart)))


def written(cells: Column) -> Column:
    """A table as text: count, xor and check of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"]))), ",")


def _block(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    array = F.lit(bounds).cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) < value, at + s).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``next``, the text of the following id, for the last row that of the first.

    Rows are put into blocks of neighbouring ids, bounded by quantiles of all ids, so texts are shuffled once
    and no task sees more than its block. The last row of each block gets the first one of the next.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID)))
    n = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0]
    bounds = sorted(set(found or []))
    docs = docs.withColumn("_block", _block(bounds, F.col("_key")))
    least = F.broadcast(docs.groupBy("_block").agg(F.min("_key").alias("_key")))  # one row per block
    firsts = docs.join(least, ["_block", "_key"]).groupBy("_block").agg(F.min("text").alias("first"), F.count("text").alias("texts"), F.count("*").alias("rows"))
    firsts = firsts.withColumn("first", F.when(F.col("texts") == F.col("rows"), F.col("first")))  # nulls come first
    numbers = firsts.select("_block").withColumn("after", F.lead("_block").over(Window.orderBy("_block")))
    numbers = numbers.withColumn("after", F.coalesce("after", F.min("_block").over(Window.partitionBy())))
    following = numbers.join(firsts.select(F.col("_block").alias("after"), F.col("first").alias("_first")), "after").select("_block", "_first")
    w = Window.partitionBy("_block").orderBy("_key", "text")
    docs = docs.withColumn("_lead", F.lead(F.struct("text")).over(w))
    docs = docs.join(following, "_block", "left")
    after = F.when(F.col("_lead").isNotNull(), F.col("_lead.text")).otherwise(F.col("_first"))
    return docs.withColumn("next", after).drop("_key", "_block", "_lead", "_first")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness.

    The edited text has the last floor(n/2) code points replaced by as many of the first ones of the next
    row's text, or all of them. Rows are ordered by (id, text), nulls first; the row after the last is the
    first. ``near_edited`` and ``near_next`` are the shares of paragraph digests that the text has in common
    with the edited and with the next text, recovered from subtracted tables. A null or empty text has no
    paragraphs; two texts without any are alike (1.0). Repeated rows each get a row; a null id stays null;
    extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    cut = lambda c, k: F.substring(c, F.lit(1), k)
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(cut("text", n - half), cut("next", half))})
    rows = rows.withColumns({f"d_{c}": digests(F.col(c)) for c in ("text", "edited", "next")})
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited", "next")
    rows = rows.withColumns({f"t_{c}": table(F.col(f"d_{c}")) for c in ("text", "edited", "next")})
    rows = rows.withColumns({f"p_{c}": peeled(minus(F.col("t_text"), F.col(f"t_{c}"))) for c in ("edited", "next")})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("t_text")).alias("fingerprint"),
        written(F.col("t_edited")).alias("edited_fingerprint"),
        *[likeness(F.col("d_text"), F.col(f"d_{c}"), F.col(f"p_{c}")).alias(f"near_{c}") for c in ("edited", "next")],
    )
