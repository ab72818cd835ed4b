"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c, name: str | None = None, digits: int = 6) -> Column:
    """Round half up on the decimal value, so that the order of a floating sum does not show."""
    out = F.round(_col(c).try_cast("decimal(38,12)"), digits).cast("double")
    return out.alias(name) if name else out


def safe_div(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_col(a), _col(b))


def fixed(c, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half up on the decimal value."""
    value = F.round(_col(c).try_cast("decimal(38,12)"), digits)
    return value.cast(f"decimal(24,{digits})").cast("string")


def fixed_sql(expr: str, digits: int) -> str:
    """``fixed`` in SQL."""
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DECIMAL(24,{digits})) AS VARCHAR)"
