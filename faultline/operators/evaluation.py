"""Accuracy, agreement and confidence statistics over cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.scale import global_running_sum

# fixed values
BOOTSTRAPS = 10_000
ABSENT = 99
#: all steps that a draw from 32 bits can reach: more than 12 is rarer than 2 ** -32
POISSON_STEPS = 12
TEMPERATURES = [math.exp(math.log(0.05) + i * (math.log(50.0) - math.log(0.05)) / 119) for i in range(120)]


def truth_candidates(entity: Column, level: Column) -> Column:
    """Names that count as a hit: pods also without the number, services also without digits or '-'."""
    pod = F.array(entity, F.regexp_replace(entity, r"-\d+", ""))
    service = F.array(entity, F.regexp_replace(entity, r"[\d-]+$", ""))
    return F.array_distinct(F.when(level == "pod", pod).when(level == "service", service).otherwise(F.array(entity)))


def is_hit(prediction: Column, candidates: Column) -> Column:
    """A candidate is part of the prediction."""
    return F.exists(candidates, lambda c: F.contains(prediction, c))


def is_match(prediction: Column, candidates: Column) -> Column:
    """Either holds the other, trimmed and in lower case."""
    p = F.lower(F.trim(prediction))
    return F.exists(
        candidates,
        lambda c: F.contains(p, F.lower(F.trim(c))) | F.contains(F.lower(F.trim(c)), p),
    )


def truth_rank(predictions: DataFrame, truths: DataFrame, keys=("incident_id",)) -> DataFrame:
    """First rank whose name contains a truth candidate, 99 if none does."""
    joined = predictions.join(truths.select("incident_id", "candidates"), "incident_id")
    hit = is_hit(F.col("name"), F.col("candidates"))
    return joined.groupBy(*keys).agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(ABSENT)).cast("long").alias("truth_rank"))


def accuracy(ranks: DataFrame, keys=(), prefix: str = "") -> DataFrame:
    """Cases and share of cases with the truth among the first 1, 3 and 5 names."""
    r = F.col(f"{prefix}truth_rank")
    at = lambda k: F.avg((r <= k).cast("double"))
    return ranks.groupBy(*keys).agg(
        F.count("*").alias("n"), at(1).alias("ac1"), at(3).alias("ac3"), at(5).alias("ac5")
    )


def precision_at(predictions: DataFrame, truths: DataFrame, k_max: int = 5) -> DataFrame:
    """Hits among the first k over min(truths, k), for k = 1..k_max, and their mean, per case."""
    size = truths.groupBy("incident_id").agg(F.count("*").alias("_nt"))
    hits = predictions.join(truths, ["incident_id", "name"]).groupBy("incident_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in range(1, k_max + 1)]
    )
    pr = [
        F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.least("_nt", F.lit(k)) for k in range(1, k_max + 1)
    ]
    mean = sum(pr[1:], pr[0]) / k_max
    return size.join(hits, "incident_id", "left").select(
        "incident_id", *[p.alias(f"pr{i + 1}") for i, p in enumerate(pr)], mean.alias("pr_avg")
    )


def rank_accuracy(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """Mean over truths of (n - max(0, rank - truths)) / n, an absent truth counts 0."""
    n = predictions.groupBy("incident_id").agg(F.count("*").alias("_n"))
    joined = truths.join(predictions, ["incident_id", "name"], "left").join(n, "incident_id")
    nt = F.count("*").over(Window.partitionBy("incident_id"))
    part = (F.col("_n") - F.greatest(F.lit(0), F.col("rank") - F.col("_nt"))) / F.col("_n")
    return (
        joined.withColumn("_nt", nt)
        .groupBy("incident_id")
        .agg(F.avg(F.when(F.col("rank").isNotNull(), part).otherwise(0.0)).alias("acc"))
    )


def hit_rates(ranks: DataFrame, keys=()) -> DataFrame:
    """HR@1..5 and reciprocal rank counted up to rank 3."""
    r = F.col("truth_rank")
    return ranks.groupBy(*keys).agg(
        *[F.avg((r <= k).cast("double")).alias(f"hr{k}") for k in range(1, 6)],
        F.avg(F.when(r <= 3, 1 / r).otherwise(0.0)).alias("mrr3"),
    )


def class_scores(rows: DataFrame) -> DataFrame:
    """Per class support, precision and recall of (truth, predicted) rows."""
    cells = rows.groupBy("truth", "predicted").agg(F.count("*").alias("c"))
    both = F.array(
        F.struct(F.col("truth").alias("class"), F.lit(1).alias("is_truth")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).alias("is_truth")),
    )
    long = cells.select("c", (F.col("truth") == F.col("predicted")).alias("ok"), F.explode(both).alias("s"))
    per = long.groupBy("s.class").agg(
        F.sum(F.when(F.col("s.is_truth") == 1, F.col("c")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_truth") == 0, F.col("c")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("ok") & (F.col("s.is_truth") == 1), F.col("c")).otherwise(0)).alias("tp"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return per.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))


def weighted_scores(per_class: DataFrame) -> DataFrame:
    """Support-weighted precision and recall, and the F1 of the two."""
    s = F.sum("support")
    out = per_class.agg(
        (F.sum(F.col("support") * F.col("precision")) / s).alias("pre"),
        (F.sum(F.col("support") * F.col("recall")) / s).alias("rec"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("pre") * F.col("rec"), F.col("pre") + F.col("rec")), F.lit(0.0))
    return out.withColumn("f1", f1)


def macro_scores(per_class: DataFrame) -> DataFrame:
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    real = per_class.filter("support > 0 or predicted > 0")
    return real.agg(
        F.avg("precision").alias("macro_pre"), F.avg("recall").alias("macro_rec"), F.avg(f1).alias("macro_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
    )


def vote_winners(votes: DataFrame) -> DataFrame:
    """Majority at (n + 1) // 2 votes; without one the case needed arbitration and has no winner."""
    counts = votes.groupBy("case_id", "vote").agg(F.count("*").alias("c"))
    top = counts.groupBy("case_id").agg(
        F.sum("c").alias("n"), F.max("c").alias("best"), F.min_by("vote", F.struct(-F.col("c"), F.col("vote"))).alias("first")
    )
    need = F.floor((F.col("n") + 1) / 2)
    runner_up = counts.join(top.select("case_id", "best"), "case_id").groupBy("case_id").agg(
        F.count_if(F.col("c") == F.col("best")).alias("leaders")
    )
    tie = (F.col("best") < need) | (F.col("leaders") > 1)
    return top.join(runner_up, "case_id").select(
        "case_id", "n", tie.alias("is_tie"), F.when(~tie, F.col("first")).alias("winner")
    )


def auc(scored: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half, from (score, label).

    Rows are first counted per distinct score; the negatives below each score come from a
    distributed running sum, so no pair is ever formed.
    """
    counts = scored.groupBy("score").agg(
        F.sum(F.col("label").cast("long")).alias("pos"), F.sum(1 - F.col("label").cast("long")).alias("neg")
    )
    below = global_running_sum(counts, ["score"], "neg", "below")
    wins = F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    return below.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"),
    )


def poisson_weight(*key: Column) -> Column:
    """Poisson(1) draw from a hash of the key, the same in every engine that has md5."""
    text = F.concat_ws("-", *[k.cast("string") for k in key])
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
    total, term, weight = 0.0, math.exp(-1), F.lit(0)
    for i in range(POISSON_STEPS):
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= i + 1
    return weight


def paired_bootstrap(cases: DataFrame, n_boot: int = BOOTSTRAPS) -> DataFrame:
    """Interval of the mean paired difference and the share of resamples without a gain.

    cases is (case_id, delta). Every resample weighs each case by a Poisson(1) draw; the draws are
    summed per resample before the shuffle, so only resamples x tasks rows move.
    """
    draws = cases.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    w = poisson_weight(F.col("case_id"), F.col("boot"))
    means = draws.groupBy("boot").agg((F.sum(w * F.col("delta")) / F.greatest(F.sum(w), F.lit(1))).alias("m"))
    stats = means.agg(
        F.percentile("m", F.lit(0.025)).alias("low"),
        F.percentile("m", F.lit(0.975)).alias("high"),
        F.avg((F.col("m") <= 0).cast("double")).alias("p_no_gain"),
    )
    facts = cases.agg(
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("improved"),
        F.count_if(F.col("delta") < 0).alias("regressed"),
    )
    return facts.withColumn("_k", F.lit(1)).join(stats.withColumn("_k", F.lit(1)), "_k").drop("_k")


def temperature_nll(records: DataFrame, temperatures: Column) -> DataFrame:
    """Mean negative log likelihood of the true position per temperature; records (logits, truth)."""
    grid = records.withColumn("_top", F.array_max("logits")).withColumn("temperature", F.explode(temperatures))
    norm = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("_top")) / F.col("temperature")))
    own = (F.get("logits", F.col("truth")) - F.col("_top")) / F.col("temperature")
    p = F.greatest(F.exp(own) / norm, F.lit(1e-12))
    return grid.groupBy("temperature").agg(F.avg(-F.log(p)).alias("nll"))


def fit_temperature(records: DataFrame, grid: list[float] = TEMPERATURES, fine: int = 200) -> DataFrame:
    """Best temperature on a logarithmic grid, then on a fine grid from half to twice of it."""
    coarse = temperature_nll(records, F.array(*map(F.lit, grid)))
    best = coarse.agg(F.min_by("temperature", F.struct("nll", "temperature"))).scalar()
    records = records.withColumn("_b", best)
    step = F.col("_b") * 1.5 / (fine - 1)
    points = F.transform(F.sequence(F.lit(0), F.lit(fine - 1)), lambda i: F.col("_b") / 2 + i * step)
    refined = temperature_nll(records, points)
    return refined.agg(
        F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll")
    )


def confidence(df: DataFrame, logits: str, temperature: float = 1.0) -> DataFrame:
    """Add margins, entropy and top probability of a logit vector.

    Every intermediate vector is a column of its own, so that no lambda repeats it per element.
    """
    df = df.withColumn("_top", F.array_max(logits))
    df = df.withColumn("_e", F.transform(logits, lambda x: F.exp((x - F.col("_top")) / temperature)))
    df = df.withColumn("_total", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    df = df.withColumn("_p", F.transform("_e", lambda x: x / F.col("_total")))
    df = df.withColumn("_sl", F.sort_array(logits, asc=False)).withColumn("_sp", F.sort_array("_p", asc=False))

    def margin(ranked: str) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return (first - second) / F.greatest(first - F.element_at(ranked, -1), F.lit(1e-9))

    entropy = F.aggregate("_p", F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(1e-12))))
    return (
        df.withColumn("logit_margin", margin("_sl"))
        .withColumn("prob_margin", margin("_sp"))
        .withColumn("conf_entropy", 1 - entropy / F.log(F.size(logits).cast("double")))
        .withColumn("top_prob", F.get("_sp", F.lit(0)))
        .drop("_top", "_e", "_total", "_p", "_sl", "_sp")
    )


def min_max_scaled(df: DataFrame, vector: str) -> DataFrame:
    """Scale a vector column to 0..1; a constant vector becomes null values."""
    bounds = df.withColumn("_lo", F.array_min(vector)).withColumn("_span", F.array_max(vector) - F.col("_lo"))
    scaled = F.transform(vector, lambda v: F.try_divide(v - F.col("_lo"), F.col("_span")))
    return bounds.withColumn(vector, scaled).drop("_lo", "_span")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
