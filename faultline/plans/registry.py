"""Named queries over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans.oracle_views import VIEWS
from faultline.sources.telemetry import Telemetry

QUERIES: dict[str, Callable[[Telemetry], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any view of ``oracle_views`` and add its own."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = full_sql(sql)
        return fn

    return register


def _decimal_round(sql: str) -> str:
    """Let ``round(x, 6)`` round on the decimal value, as ``functions.numbers.r6`` does."""
    out, pos = [], 0
    while (at := sql.find("round(", pos)) >= 0:
        depth, i = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = _decimal_round(sql[at + 6 : i - 1])
        if inner.endswith(", 6"):
            inner = f"TRY_CAST({inner[:-3]} AS DECIMAL(38,12)), 6"
            out.append(f"{sql[pos:at]}CAST(round({inner}) AS DOUBLE)")
        else:
            out.append(f"{sql[pos:at]}round({inner})")
        pos = i
    return "".join(out) + sql[pos:]


def full_sql(body: str) -> str:
    """Put the shared views that the body needs in front of it."""
    body = _decimal_round(body)
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(VIEWS[view])
                needed.append(view)

    visit(body)
    parts = [f"{view} AS ({VIEWS[view].strip()})" for view in needed]
    body = body.strip()
    own = not re.match(r"(?is)select\b|\(select\b", body)
    if own:
        return "WITH RECURSIVE " + ",\n".join([*parts, body])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Telemetry(spark, sf_dir))

    run.__name__ = name
    return run
