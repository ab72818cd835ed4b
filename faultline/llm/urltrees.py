"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.store import stored

#: labelled rows the trees are fitted on at most, those with the smallest hash of their url
TRAIN_ROWS = 20_000
TREES, DEPTH = 15, 4
#: rows that the overall block rate counts for in the rate of a suffix
SMOOTHING = 10.0
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy",
    "host_entropy", "parameters", "fragment", "suffix_rate", "suffix_share",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (after the first ``://`` up to /, ? or #, A-Z lower-cased) and path (up to ? or #)."""
    c = F.col(url).cast("string")
    rest = F.when(F.instr(c, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return urls.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path); null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        own = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = own & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.char_length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    shares = F.filter(shares, lambda p: p > 0)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, rf"[^{pattern}]", "")).cast("double")


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the host's last label as ``suffix``."""
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "length": F.char_length(u).cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "depth": _count(F.col("path"), "/"),
            "labels": _count(F.col("host"), "."),
            "digits": _count(u, "0-9") / n,
            "host_digits": _count(F.col("host"), "0-9"),
            "hyphens": _count(u, r"\-_"),
            "entropy": _entropy(u),
            "host_entropy": _entropy(F.col("host")),
            "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0.0),
            "fragment": F.contains(u, F.lit("#")).cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """urls (with ``url``) with host, path, rule, verdict and ``p_block``, the trees' probability.

    The urls that a rule decides are the labelled ones; the trees are fitted on at most ``train_rows``
    distinct ones of them. Suffix statistics (smoothed block rate and share of the labelled urls by the
    host's last label) come from all labelled rows. A rule's verdict stands, the trees judge the rest: block
    from 0.5 on. A null url, or one without ``://``, has an empty host and path and is judged by the
    trees. Where the labelled urls do not hold both verdicts there is nothing to learn: p_block is then
    their share of blocks (0 without any). Other columns are kept; host, path, rule, verdict and p_block
    take the place of columns so named. Repeated rows each get a row; an empty table gives no rows.
    """
    rule, verdict = rule_columns(rules)
    urls = with_parts(urls).withColumns({"rule": rule, "verdict": verdict})
    labelled = urls.filter(F.col("verdict").isNotNull())
    block = (F.col("verdict") == "block").cast("double")
    suffix = F.substring_index("host", ".", -1)
    stats = labelled.groupBy(suffix.alias("_suffix")).agg(F.sum(block).alias("_blocks"), F.count("*").alias("_rows"))
    stats = stored(stats, "suffixes")
    blocks, total = stats.agg(F.sum("_blocks"), F.sum("_rows")).first()
    base = (blocks / total) if total else 0.0
    stats = stats.select(
        "_suffix",
        ((F.col("_blocks") + SMOOTHING * base) / (F.col("_rows") + SMOOTHING)).alias("suffix_rate"),
        (F.col("_rows") / F.lit(float(total or 1))).alias("suffix_share"),
    )

    def inputs(df: DataFrame) -> DataFrame:
        df = with_features(df).join(stats, F.col("suffix") == F.col("_suffix"), "left")
        df = df.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(base)), "suffix_share": F.coalesce("suffix_share", F.lit(0.0))})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df)

    if not total or blocks in (0, total):
        return urls.withColumns({"p_block": F.lit(float(base)), "verdict": F.coalesce("verdict", F.lit("allow" if base < 0.5 else "block"))})
    train = labelled.select("url", "host", "path", block.alias("label")).distinct().orderBy(F.xxhash64("url"), "url").limit(train_rows)
    train = stored(inputs(train).select("_features", "label"), "labelled")
    model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(train)
    scored = model.transform(inputs(urls)).withColumn("p_block", F.get(vector_to_array("probability"), 1))
    judged = F.coalesce("verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", judged).drop(*FEATURES, "suffix", "_suffix", "_features", "rawPrediction", "probability", "prediction")
