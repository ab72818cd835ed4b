"""Shape classes of metric windows, their scores and their descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import fixed
from faultline.operators.series import percent_change

# fixed values: the 11 shape classes by number
PATTERNS = [
    "Level shift up",
    "Level shift down",
    "Steady increase",
    "Steady decrease",
    "Single spike",
    "Single dip",
    "Transient level shift up",
    "Transient level shift down",
    "Multiple spikes",
    "Multiple dips",
    "Fluctuations",
]

# fixed values: severity limits on the deviation score and their tags
SEVERITY = [(5.0, "critical", "[CRITICAL]"), (3.0, "severe", "[SEVERE]"), (2.0, "moderate", "[MODERATE]")]
MILD = ("mild", "[MILD]")

#: a sentence per shape class; names in braces are filled per series
HEAD = "{service}, {kpi}: "
USUAL = " Usual level {base_mean} (σ {base_std}), score {score}."
TEMPLATES = {
    "Level shift up": HEAD + "since {start} the level is {shift_pct}% higher, {post_mean} after {pre_mean}, for {minutes} min so far." + USUAL,
    "Level shift down": HEAD + "since {start} the level is {shift_pct}% lower, {post_mean} after {pre_mean}, for {minutes} min so far." + USUAL,
    "Steady increase": HEAD + "climbs from {first} to {last} (+{trend_pct}%) in {minutes} min from {start} on; top {vmax}, {n_sigma}σ over {base_mean}, score {score}.",
    "Steady decrease": HEAD + "sinks from {first} to {last} (-{trend_pct}%) in {minutes} min from {start} on; bottom {vmin}, {n_sigma}σ under {base_mean}, score {score}.",
    "Single spike": HEAD + "one peak of {vmax} near {start}, {n_sigma}σ over {base_mean}; it began at {first} and was over in {minutes} min.",
    "Single dip": HEAD + "one low of {vmin} near {start}, {n_sigma}σ under {base_mean}; it began at {first} and was over in {minutes} min.",
    "Transient level shift up": HEAD + "went from {first} up to {vmax} near {start} and came back in part within {minutes} min, {n_sigma}σ at most." + USUAL,
    "Transient level shift down": HEAD + "went from {first} down to {vmin} near {start} and came back in part within {minutes} min, {n_sigma}σ at most." + USUAL,
    "Multiple spikes": HEAD + "{peaks} peaks in {minutes} min from {start} on, the highest {vmax}; load may come in bursts." + USUAL,
    "Multiple dips": HEAD + "{dips} lows in {minutes} min from {start} on, the deepest {vmin}; the service may be starved at times." + USUAL,
    "Fluctuations": HEAD + "moves between {vmin} and {vmax} (span {vrange}, variation {cv}) for {minutes} min from {start} on, without a pattern." + USUAL,
}
TAIL = " Severity: {tag}."


def pattern_class() -> Column:
    """Class number from the shape facts of a window (see ``series.shape``).

    A level shift has a different mean in each half and gets there in one large step.
    """
    spread = F.col("vmax") - F.col("vmin")
    trend = F.try_divide(F.col("last") - F.col("first"), spread)
    shift = F.try_divide(F.col("post_mean") - F.col("pre_mean"), F.col("vstd"))
    high, low = F.col("n_high"), F.col("n_low")
    jump = F.try_divide(F.col("max_step"), spread)
    joined_high = F.col("high_span") == high - 1
    joined_low = F.col("low_span") == low - 1
    return (
        F.when((F.abs(shift) >= 1.2) & (jump >= 0.5), F.when(shift > 0, 0).otherwise(1))
        .when(trend >= 0.8, 2)
        .when(trend <= -0.8, 3)
        .when((high == 1) & (low == 0), 4)
        .when((low == 1) & (high == 0), 5)
        .when((high > low) & joined_high, 6)
        .when((low > high) & joined_low, 7)
        .when(high > low, 8)
        .when(low > high, 9)
        .otherwise(10)
        .cast("long")
    )


def deviation_scores(shapes: DataFrame, min_score: float = 1.0) -> DataFrame:
    """Class, score and severity; needs base_mean and base_std. Scores up to ``min_score`` drop out.

    An even class is scored at its maximum, an odd one at its minimum.
    """
    value = F.when(F.col("class_no") % 2 == 0, F.col("vmax")).otherwise(F.col("vmin"))
    std = F.when(F.col("base_std") == 0, 1e-6).otherwise(F.col("base_std"))
    raw = F.abs((value - F.col("base_mean")) / std) / 2
    severity = F.lit(MILD[0])
    for limit, name, _ in reversed(SEVERITY):
        severity = F.when(F.col("score") >= limit, name).otherwise(severity)
    return (
        shapes.withColumn("class_no", pattern_class())
        .withColumn("score", F.round(raw.try_cast("decimal(38,12)"), 2).cast("double"))
        .filter(F.col("score") > min_score)
        .withColumn("pattern", F.element_at(F.array(*map(F.lit, PATTERNS)), (F.col("class_no") + 1).cast("int")))
        .withColumn("severity", severity)
    )


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(text), values[name]]
    return F.concat(*parts, F.lit(rest))


def describe(scored: DataFrame) -> DataFrame:
    """Add the class-specific sentence. Needs kpi, service, start (text), minutes and the scores."""
    down = F.col("class_no").isin(1, 3)
    sign = F.when(down, -1.0).otherwise(1.0)
    vmean = F.abs("vmean")
    cv = F.when(vmean > 1e-10, F.col("vstd") / vmean).otherwise(F.col("vstd"))
    values = {
        "kpi": F.col("kpi"),
        "service": F.col("service"),
        "start": F.col("start"),
        "minutes": F.col("minutes").cast("string"),
        "peaks": F.col("peaks").cast("string"),
        "dips": F.col("dips").cast("string"),
        "shift_pct": fixed(sign * percent_change(F.col("post_mean"), F.col("pre_mean")), 1),
        "trend_pct": fixed(sign * percent_change(F.col("last"), F.col("first")), 1),
        "n_sigma": fixed(F.col("score") * 2, 1),
        "score": fixed("score", 2),
        "cv": fixed(cv, 2),
        "vrange": fixed(F.col("vmax") - F.col("vmin"), 4),
        **{
            c: fixed(c, 4)
            for c in ("vmax", "vmin", "first", "last", "pre_mean", "post_mean", "base_mean", "base_std")
        },
    }
    tag = F.lit(MILD[1])
    for _, name, text in SEVERITY:
        tag = F.when(F.col("severity") == name, text).otherwise(tag)
    values["tag"] = tag
    sentence = F.lit(None).cast("string")
    for name, template in TEMPLATES.items():
        sentence = F.when(F.col("pattern") == name, _filled(template + TAIL, values)).otherwise(sentence)
    return scored.withColumn("description", sentence)


def cross_metric_alerts(scored: DataFrame) -> DataFrame:
    """Services with at least two anomalous metrics in one incident."""
    counts = scored.groupBy("incident_id", "service").agg(F.count("*").alias("n_metrics"))
    return counts.filter(F.col("n_metrics") >= 2)
