"""Text built from analysis results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import fixed


def trace_descriptions(positions: DataFrame, min_score: float = 2.0) -> DataFrame:
    """One sentence per structural or timeout trace; the timeouts list every position out of range.

    The list is bounded by the number of distinct call paths of one trace.
    """
    from faultline.operators.spans import trace_verdicts

    high = F.col("mean") + 3 * F.col("std")
    low = F.col("mean") - 3 * F.col("std")
    above = F.col("rt") > high
    path = F.array_join(F.slice(F.split("call_path", "#"), F.lit(2), F.size(F.split("call_path", "#"))), "->")
    excess = F.floor(F.when(above, F.col("rt") - high).otherwise(low - F.col("rt")))
    piece = F.concat(
        path, F.lit(" took "), F.col("rt"), F.lit(" ms, "),
        F.when(above, "above").otherwise("below"),
        F.lit(" the normal limit by "), excess, F.lit(" ms"),
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("out"), F.struct("call_path", piece.alias("piece")))))
    verdicts = trace_verdicts(positions, min_score, listed.alias("d")).filter("verdict <> 'none'")
    details = F.array_join("d.piece", "; ")
    text = F.when(
        F.col("verdict") == "structural", F.concat(F.lit("structural anomaly, trace "), "trace_id")
    ).otherwise(F.concat(F.lit("call timeout, trace "), "trace_id", F.lit(": "), details))
    return verdicts.select("trace_id", text.alias("description"))


def embedded_json(text: Column) -> Column:
    """The JSON object inside a text: a fenced block, else the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces)


# fixed values: openings of lines that carry no content
FILLERS = [
    "we are given",
    "i need to",
    "let me",
    "okay",
    "hmm",
    "the user",
    "based on the above",
    "therefore",
    "final answer",
    "output:",
    "answer:",
]


def kept_lines(text: Column, fillers: list[str] | None = None) -> Column:
    """Non-empty trimmed lines that do not begin with a filler."""
    starts = "^(" + "|".join(fillers or FILLERS) + ")"
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike(starts))


def knowledge_paragraph(totals: DataFrame, flags: DataFrame) -> DataFrame:
    """Status, top-5 metrics, top-10 contributions and services of each incident as one text.

    totals is (incident_id, metric, total), flags (incident_id, is_anomalous).
    """
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("total")).alias("o"), F.col("metric"), fixed("total", 4).alias("t")))
    )
    rows = totals.groupBy("incident_id").agg(ranked.alias("r")).join(flags, "incident_id")
    top = F.slice("r", 1, 5)
    numbered = F.transform(top, lambda x, i: F.concat(F.lit("("), i + 1, F.lit(") "), x["metric"]))
    shares = F.transform(F.slice("r", 1, 10), lambda x: F.concat_ws(" ", x["metric"], x["t"]))
    services = F.array_distinct(F.transform(top, lambda x: F.substring_index(x["metric"], "_", 1)))
    status = F.when(F.col("is_anomalous"), "The system is in an anomalous state.").otherwise(
        "The metric correlations are within normal bounds."
    )
    text = F.concat(
        status,
        F.lit("\nTop metrics: "), F.array_join(numbered, ", "),
        F.lit("\nContribution: "), F.array_join(shares, ", "),
        F.lit("\nServices: "), F.array_join(services, ", "),
    )
    return rows.select("incident_id", text.alias("text"))


#: a whole string, one structural character, a literal, white space, or a quote that nothing closes
_JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^"{}\[\],:\s]+|\s+|"'


def repaired_json(text: Column) -> Column:
    """The text of a JSON object or array that was cut off, closed behind its last complete value.

    Tokens run through an automaton that keeps the brackets still open and, for objects, whether a key or a value
    is next. A value is complete at its end quote or bracket, a number or word only when something follows it; what
    stands behind the last complete value, a key without its value included, is dropped, and open brackets are
    closed. A whole text stays as it is, up to its end. Null if nothing was opened.
    """
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit("").alias("open"),
        F.lit("v").alias("next"),
        F.lit(False).alias("over"),
        F.lit(0).alias("end"),
        F.lit("").alias("closers"),
    )

    def step(s: Column, token: Column) -> Column:
        first, at = F.substring(token, 1, 1), s["at"] + F.char_length(token)
        lone = token == '"'
        opening = F.when(token == "{", "}").when(token == "[", "]")
        closing = token.isin("}", "]")
        space = F.trim(token, F.lit(" \t\n\r")) == ""
        string = (first == '"') & ~lone
        still = F.when(opening.isNotNull(), F.concat(opening, s["open"])).when(closing, F.substring(s["open"], F.lit(2), F.char_length(s["open"]))).otherwise(s["open"])
        expected = (
            F.when(token == "{", "k").when((token == "[") | (token == ":"), "v").when(closing, "")
            .when(token == ",", F.when(s["open"].startswith("}"), "k").otherwise("v"))
            .when(string, F.when(s["next"] == "k", ":").otherwise(""))
            .when(space, F.when(s["next"] == "word", "").otherwise(s["next"]))
            .otherwise("word")
        )
        here = opening.isNotNull() | closing | (string & (s["next"] == "v"))
        before = ((token == ",") | space) & s["next"].isin("word", "") & (F.char_length(s["open"]) > 0)
        over = s["over"] | lone | (closing & (F.char_length(still) == 0))
        moved = F.struct(
            at.alias("at"), still.alias("open"), expected.alias("next"), over.alias("over"),
            F.when(here, at).when(before, s["at"]).otherwise(s["end"]).alias("end"),
            F.when(here, still).when(before, s["open"]).otherwise(s["closers"]).alias("closers"),
        )
        return F.when(s["over"] | lone, F.struct(s["at"], s["open"], s["next"], F.lit(True).alias("over"), s["end"], s["closers"])).otherwise(moved)

    tokens = F.regexp_extract_all(text, F.lit(_JSON_TOKEN), 0)
    done = F.transform(F.array(F.aggregate(tokens, start, step)), lambda s: F.when(s["end"] > 0, F.concat(F.substring(text, F.lit(1), s["end"]), s["closers"])))
    return F.get(done, F.lit(0))
