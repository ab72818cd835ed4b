"""Near-duplicate lines: MinHash of character shingles, banding, exact verification, union-find.

In every bucket of a band, lines are first held against a few neighbours. Of buckets that still hold more than
one component, small ones list all their pairs; in large ones lines are held against those of shuffled orders,
and all pairs that are left are found by an exact prefix join.

Everything here is DataFrame expressions. A line's shingles are the ``SHINGLE`` characters from every
word start on, and from every ``STRIDE``-th character inside longer words, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.store import stored
from faultline.operators.scale import is_small

SHINGLE, STRIDE = 10, 8
#: bands of two values each, at most six rotations of 64 bits; lines of similarity 0.8 meet in one with probability 0.998
BANDS = 6
#: lines under this many characters are never duplicates
MIN_CHARS = 20
PERCENT = 80
#: buckets up to this many lines list all their pairs
SMALL = 64
#: lines of one bucket that stand in one row of neighbours
ROW = 1000
#: rounds, and shuffled orders of a round, in which lines of different components meet neighbours before all pairs are sought
ROUNDS, ORDERS = 2, 3


def shingles(line: Column) -> Column:
    """The line's character shingles."""
    return F.regexp_extract_all(F.lower(line), F.lit(rf"(?s)(?=(\S.{{0,{SHINGLE - 1}}}))\S{{1,{STRIDE}}}\s*"), F.lit(1))


def _turned(x: Column, k: int) -> Column:
    """The hash rotated by 11 k bits: each rotation orders hashes by other bits, and a line's least and
    greatest hash in it are two min-hashes nearly independent of those of the others."""
    if k == 0:
        return x
    return F.shiftleft(x, 11 * k).bitwiseOR(F.shiftrightunsigned(x, 64 - 11 * k))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, pos, line, k1, k2): every line long enough, with its place and a 128-bit key."""
    rid = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = docs.select("doc_id", rid.alias("rid"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.filter(F.length(F.trim("line")) >= MIN_CHARS)
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64("line", F.lit(7))})


def _neighbours(buckets: DataFrame) -> DataFrame:
    """Pairs of keys to verify: per bucket and part, each line with the one before it and with the first;
    the first lines of the parts in the same way."""

    def pairs(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("k1")
        rows = rows.withColumns({"before": F.lag("k1").over(w), "first": F.first("k1").over(w)})
        rows = rows.select("k1", F.explode(F.array("before", "first")).alias("other"))
        return rows.filter("k1 <> other").select(F.greatest("k1", "other").alias("u"), F.least("k1", "other").alias("v"))

    part = F.pmod(F.xxhash64("k1"), F.ceil(F.col("n") / ROW))
    rows = buckets.withColumn("part", part)
    heads = rows.groupBy("band", "part").agg(F.min("k1").alias("k1"))
    return pairs(rows, ["band", "part"]).union(pairs(heads, ["band"])).distinct()


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(k1, k2, hashes, size, m0 ... m3) of the lines at the places given (doc_id, rid, pos, k1, k2): the shingles'
    hashes, how many they are, and bitmaps of 256 places in all."""
    by_doc = places.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("pos", "k1", "k2")).alias("at"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.rid") == F.col("b.rid"))
    rows = rows.alias("a").join(by_doc.alias("b"), same).select(F.split("a.text", "\n").alias("lines"), F.explode("b.at").alias("at"))
    rows = rows.select("at.k1", "at.k2", F.get("lines", F.col("at.pos")).alias("line")).dropDuplicates(["k1", "k2"])
    rows = rows.select("k1", "k2", F.array_distinct(F.transform(shingles(F.col("line")), lambda s: F.xxhash64(s))).alias("hashes"))
    maps = [f"aggregate(hashes, 0L, (a, h) -> a | if(pmod(h, 4) = {i}, shiftleft(1L, cast(pmod(shiftright(h, 2), 64) as int)), 0L))" for i in range(4)]
    return rows.withColumns({"size": F.size("hashes")} | {f"m{i}": F.expr(m) for i, m in enumerate(maps)})


def _close(nu: str, nv: str) -> Column:
    """Whether two sizes allow the similarity."""
    return (F.col(nu) * 100 >= F.col(nv) * PERCENT) & (F.col(nv) * 100 >= F.col(nu) * PERCENT)


def _possible(nu: Column | str, nv: Column | str):
    """Whether the bitmaps m0 ... m3 of u and v allow the similarity. A place that only one of two bitmaps has stands
    for a shingle that only that line has."""
    only = lambda x, y: sum(F.bit_count(F.col(f"m{i}{x}").bitwiseAND(F.bitwise_not(f"m{i}{y}"))) for i in range(4))
    most = F.least(F.col(nu) - only("u", "v"), F.col(nv) - only("v", "u"))
    return most * (100 + PERCENT) >= (F.col(nu) + F.col(nv)) * PERCENT


def _allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of keys whose sizes and bitmaps allow the similarity; the sets themselves stay where they are."""
    for x in "uv":
        pairs = pairs.join(sets.select(F.col("k1").alias(x), F.col("size").alias(f"s{x}"), *[F.col(f"m{i}").alias(f"m{i}{x}") for i in range(4)]), x)
    return pairs.filter(_close("su", "sv") & _possible("su", "sv")).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(uk, vk): the pairs (u, v) of keys whose sets are alike. Few pairs do not set all sets moving."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("k1")).distinct()
    if is_small(ends):
        sets = sets.join(F.broadcast(ends), "k1", "left_semi")
    for x in "uv":
        pairs = pairs.join(sets.select(F.col("k1").alias(x), F.struct("k1", "k2").alias(f"{x}k"), F.col("hashes").alias(f"{x}h")), x)
    common = F.size(F.array_intersect("uh", "vh"))
    return pairs.filter(common * 100 >= (F.size("uh") + F.size("vh") - common) * PERCENT).select("uk", "vk")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(k1, band, n, root) of the buckets that hold more than one component."""
    known = roots.groupBy(F.col("node.k1").alias("k1")).agg(F.min("root.k1").alias("root"))
    rows = buckets.select("k1", "band", "n").join(known, "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    several = rows.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    return rows.join(several, "band")


def _within(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of keys in different components that can be alike, of all lines of each bucket."""
    marks = sets.select("k1", F.col("size").alias("s"), *[f"m{i}" for i in range(4)])
    rows = mixed.select("k1", "band", "root").join(marks, "k1")
    side = lambda x: rows.select("band", *[F.col(c).alias(f"{c}{x}") for c in rows.columns if c != "band"])
    met = side("u").join(side("v"), "band").filter((F.col("k1u") > F.col("k1v")) & (F.col("rootu") != F.col("rootv")) & _close("su", "sv") & _possible("su", "sv"))
    return met.select(F.col("k1u").alias("u"), F.col("k1v").alias("v")).distinct()


def _shuffled(mixed: DataFrame, seed: int) -> DataFrame:
    """Pairs of keys in different components that are neighbours when the lines of a bucket are shuffled. A
    large bucket is dealt into parts, others in every order."""
    orders = F.array(*[F.lit(seed * ORDERS + i) for i in range(ORDERS)])
    rows = mixed.withColumn("order", F.explode(orders))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("k1", "order"), F.ceil(F.col("n") / ROW)))
    w = Window.partitionBy("band", "order", "part").orderBy(F.xxhash64("k1", "band", "order"), "k1")
    rows = rows.select("k1", "root", F.lag("k1").over(w).alias("other"), F.lag("root").over(w).alias("root2")).filter("root <> root2")
    return rows.select(F.greatest("k1", "other").alias("u"), F.least("k1", "other").alias("v")).distinct()


def _across(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of keys in different components that can be alike, of all lines in buckets with several components.

    Shingles are ordered: those of one component only come first, as no pair has them in common, the others by how
    many of these lines have them, the rarest first. Of two alike sets, the first
    ``size - ceil(2t / (1 + t) size) + 1`` shingles of the smaller and the first ``size - ceil(t size) + 1`` of
    the larger have one in common. A template's shingles come last, so lines that share only the
    template do not meet, however many they are. A pair is made under the first shingle that both have, once, and
    only if what is left of the sets from there on, the number of shared first shingles and the bitmaps allow the
    similarity.
    """
    left = mixed.select("k1", "root").distinct()
    marks = sets.join(left, "k1").select("k1", "k2", "root", F.col("size").alias("n"), *[f"m{i}" for i in range(4)], "hashes")
    spread = marks.select("k1", "k2", "root", F.explode("hashes").alias("s"))
    counts = spread.groupBy("s").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    ranked = spread.drop("root").join(counts.select("s", "c"), "s").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("order"))
    ranked = ranked.join(marks.drop("hashes"), ["k1", "k2"]).withColumn("own", F.col("n") - F.size("order"))
    size = F.col("n")
    short = (size - F.ceil(size * (2 * PERCENT) / (100 + PERCENT)) + 1).cast("int")
    long = (size - F.ceil(size * PERCENT / 100) + 1).cast("int")
    ranked = ranked.withColumns({"short": short, "long": long}).filter("own < long")
    firsts = {f"{x}s": F.transform(F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col(x) - F.col("own"))), lambda y: y["s"]) for x in ("short", "long")}
    marks = ["k1", "root", "n", "short", "long", "shorts", "longs", *[f"m{i}" for i in range(4)]]
    prefix = ranked.withColumns(firsts).select(*marks, "own", F.posexplode("longs").alias("at", "s"))
    prefix = stored(prefix.select(*marks, (F.col("own") + F.col("at")).alias("rank"), "s"), "prefixes")
    side = lambda x: prefix.select("s", *[F.col(c).alias(f"{c}{x}") for c in (*marks, "rank")])
    ordered = (F.col("nu") < F.col("nv")) | (F.col("nu") == F.col("nv")) & (F.col("k1u") < F.col("k1v"))
    enough = lambda most: most * (100 + PERCENT) >= (F.col("nu") + F.col("nv")) * PERCENT
    ahead = enough(F.least(F.col("nu") - F.col("ranku"), F.col("nv") - F.col("rankv")))
    both = F.array_intersect("shortsu", "longsv")
    # behind the prefix that ends first, no common shingle is missed by the count
    shared = enough(F.size(both) + F.greatest(F.col("nu") - F.col("shortu"), F.col("nv") - F.col("longv")))
    allowed = ordered & (F.col("rootu") != F.col("rootv")) & (F.col("nu") * 100 >= F.col("nv") * PERCENT) & ahead & _possible("nu", "nv")
    met = side("u").filter("ranku < shortu").join(side("v"), "s").filter(allowed & (F.get(both, F.lit(0)) == F.col("s")) & shared)
    return met.select(F.greatest("k1u", "k1v").alias("u"), F.least("k1u", "k1v").alias("v")).distinct()


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, pos): the lines to drop. Of every component of alike lines one stays, at the smallest
    (doc_id, pos). ``rid`` is a hash of the text, so rows that share an id are told apart by their text."""
    lines = _lines(docs)
    place = F.struct("doc_id", "pos", "rid")
    places = lines.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.count("*").alias("copies"))
    # one row per shingle, combined in the task that made it: minima of longs stay in generated code
    spread = lines.select("k1", "k2", F.explode_outer(shingles(F.col("line"))).alias("s"))
    spread = spread.withColumn("s", F.when(F.col("s").isNotNull(), F.xxhash64("s")))
    ends = [f(_turned(F.col("s"), i)).alias(f"{f.__name__}{i}") for i in range(BANDS) for f in (F.min, F.max)]
    bands = {f"b{i}": F.xxhash64(F.lit(i), f"min{i}", f"max{i}") for i in range(BANDS)}
    signed = spread.groupBy("k1", "k2").agg(*ends).select("k1", "k2", *[b.alias(k) for k, b in bands.items()])
    texts = places.join(signed, ["k1", "k2"])
    texts = stored(texts, "lines")

    rows = texts.select("k1", F.explode(F.array(*bands)).alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(rows.join(sizes.hint("shuffle_hash"), "band"), "buckets")
    pairs = stored(_neighbours(buckets), "pairs")

    ends = pairs.select(F.explode(F.array("u", "v")).alias("k1")).distinct()
    places = stored(texts.join(ends.hint("shuffle_hash"), "k1").select("place.*", "k1", "k2"), "places")
    sets = stored(_texts(docs, places), "sets")
    alike = stored(_verified(stored(_allowed(pairs, sets), "allowed"), sets), "alike")
    roots = stored(components(alike, "uk", "vk"), "roots")

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        return stored(components(roots.select("node", "root").union(links), "node", "root"), "roots")

    links = stored(_verified(stored(_within(_mixed(buckets.filter(F.col("n") <= SMALL), roots), sets), "within"), sets), "links")
    roots = roots if links.isEmpty() else joined(roots, links)
    large = buckets.filter(F.col("n") > SMALL)
    for seed in range(ROUNDS):
        links = stored(_verified(stored(_allowed(_shuffled(_mixed(large, roots), seed), sets), "allowed"), sets), "links")
        if links.isEmpty():
            break
        roots = joined(roots, links)
    links = stored(_verified(stored(_across(stored(_mixed(large, roots), "mixed"), sets), "across"), sets), "links")
    roots = roots if links.isEmpty() else joined(roots, links)

    groups = texts.select(F.struct("k1", "k2").alias("node"), "place", "copies").join(roots.hint("shuffle_hash"), "node", "left")
    # a line without copies and links is its own group and stays
    groups = stored(groups.filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "node")), "groups")
    best = groups.groupBy("root").agg(F.min("place").alias("best"), F.sum("copies").alias("copies")).filter("copies > 1")
    best = stored(groups.select("node.*", "root").join(best, "root").select("k1", "k2", "best"), "best")
    found = lines.select("k1", "k2", place.alias("place")).join(best.hint("shuffle_hash"), ["k1", "k2"])
    return found.filter(F.col("place") != F.col("best")).select("place.*")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicate lines, and with ``n_dropped``, how many lines each text lost.

    Lines are the parts between line feeds. Those under ``MIN_CHARS`` characters always stay. Exact copies
    count as alike; others are alike from a Jaccard similarity of ``PERCENT`` percent of their shingles
    on. Of every component one line stays: the one at the smallest (id, position), a null id before all
    others. Rows that agree in id and text are one document and keep the same lines. A null text stays
    null, an empty one empty; a text may lose all its lines and become empty. All other columns are
    kept as they are, whatever their names; an empty table stays empty.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = stored(duplicate_lines(own).distinct(), "dropped")
    gone = gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_d_id"), F.col("rid").alias("_d_rid"), F.col("gone").alias("_d_gone"))
    gone = F.broadcast(gone) if is_small(gone) else gone
    text = F.col(text_col).cast("string")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_d_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_d_rid"))
    out = docs.join(gone, same, "left")
    out = out.withColumn("_d_lines", F.when(F.col("_d_gone").isNotNull(), F.split(text, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_d_lines") - 1), "_d_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_d_lines", i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("_d_gone").isNull(), text).otherwise(kept))
    return out.withColumn("n_dropped", F.coalesce(F.size("_d_gone"), F.lit(0))).drop("_d_id", "_d_rid", "_d_gone", "_d_lines")
