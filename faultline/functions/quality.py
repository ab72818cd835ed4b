"""Text overlap scores over (pair_id, hypothesis, reference) rows, on whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_N = 4
ROUGE_BETA = 1.2  # fixed value


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space."""
    parts = F.split(F.trim(F.lower(F.regexp_replace(text, r"\s+", " "))), " ")
    return F.filter(parts, lambda x: x != "")


def _grams_of(words: Column, n: int) -> Column:
    def gram(i):
        return F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram"))

    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    none = F.array().cast("array<struct<n:int,gram:string>>")
    return F.when(F.size(words) >= n, F.transform(starts, gram)).otherwise(none)


def _grams(words: Column) -> Column:
    """All 1- to 4-grams with their length."""
    return F.concat(*[_grams_of(words, n) for n in range(1, MAX_N + 1)])


def bleu4(pairs: DataFrame) -> DataFrame:
    """BLEU-4 per pair: clipped n-gram precision, brevity penalty, 0 if any precision is 0.

    n-grams are counted by shuffling on (pair, gram), so one long text spreads over many tasks.
    """
    words = pairs.select(
        "pair_id", tokens(F.col("hypothesis")).alias("h"), tokens(F.col("reference")).alias("r")
    )
    sides = F.array(
        F.struct(F.lit(1).alias("hyp"), F.col("h").alias("w")), F.struct(F.lit(0).alias("hyp"), F.col("r").alias("w"))
    )
    grams = (
        words.select("pair_id", F.explode(sides).alias("s"))
        .select("pair_id", "s.hyp", F.explode(_grams(F.col("s.w"))).alias("g"))
        .groupBy("pair_id", "g.n", "g.gram")
        .agg(F.sum("hyp").alias("h"), F.sum(1 - F.col("hyp")).alias("r"))
    )
    per_n = grams.groupBy("pair_id", "n").agg(
        F.sum(F.least("h", "r")).alias("clipped"), F.sum("h").alias("total")
    )
    logs = per_n.filter(F.col("clipped") > 0).groupBy("pair_id").agg(
        F.count("*").alias("k"), F.sum(F.log(F.col("clipped") / F.col("total"))).alias("s")
    )
    sizes = words.select("pair_id", F.size("h").alias("nh"), F.size("r").alias("nr"))
    penalty = F.least(F.lit(1.0), F.exp(1 - F.col("nr") / F.greatest("nh", F.lit(1))))
    score = F.when((F.col("nh") > 0) & (F.col("k") == MAX_N), penalty * F.exp(F.col("s") / MAX_N)).otherwise(0.0)
    return sizes.join(logs, "pair_id", "left").select("pair_id", score.alias("bleu4"))


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token lists, one bit per token of the first."""
    out = []
    for x, y in zip(a, b):
        places: dict[str, int] = {}
        for i, word in enumerate(x):
            places[word] = places.get(word, 0) | (1 << i)
        full = (1 << len(x)) - 1
        free = full
        for word in y:
            hit = free & places.get(word, 0)
            free = ((free + hit) | (free - hit)) & full
        out.append(len(x) - free.bit_count())
    return pd.Series(out, dtype="int32")


def rouge_l(pairs: DataFrame, beta: float = ROUGE_BETA) -> DataFrame:
    """ROUGE-L F score per pair."""
    words = pairs.select(
        "pair_id", tokens(F.col("hypothesis")).alias("h"), tokens(F.col("reference")).alias("r")
    ).withColumn("lcs", _lcs("h", "r"))
    rec, prec = F.try_divide("lcs", F.size("r")), F.try_divide("lcs", F.size("h"))
    b2 = beta * beta
    score = F.try_divide((1 + b2) * rec * prec, rec + b2 * prec)
    return words.select("pair_id", "lcs", F.coalesce(score, F.lit(0.0)).alias("rouge_l"))
