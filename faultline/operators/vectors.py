"""Correlations of the short vectors that rows hold in arrays, such as the points of one bounded window.

One row is one pair of vectors with the few vectors to take out of them. Rows go to Python in Arrow batches and are
worked on as whole matrices; no row holds more than one test needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: a vector is constant if its length after centring is not above this
NO_SPREAD = 1e-12
#: what is left of a variance of 1 up to which a vector counts as explained by others
NO_REST = 1e-10


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Vectors along the last axis, centred and scaled to length 1; nan where one is constant."""
    m = m - m.mean(axis=-1, keepdims=True)
    length = np.sqrt((m * m).sum(axis=-1, keepdims=True))
    return np.divide(m, length, out=np.full_like(m, np.nan), where=length > NO_SPREAD)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", a, b)


def take_out(table: np.ndarray) -> np.ndarray:
    """Partial correlations of the vectors 0 and 1 given the others, from tables of correlations (rows, m, m).

    Order by order: those given one vector more follow from those of the order before,
    (r_xy - r_xs r_ys) / sqrt((1 - r_xs^2) (1 - r_ys^2)). A vector that is constant, or that the ones before it
    explain, takes nothing out; the result is nan where 0 or 1 is constant or explained.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        for s in range(table.shape[1] - 1, 1, -1):
            a, r = table[:, :s, s], table[:, :s, :s]
            rest = 1 - a * a
            scale = np.sqrt(rest[:, :, None] * rest[:, None, :])
            clear = (rest > NO_REST)[:, :, None] & (rest > NO_REST)[:, None, :]
            none = np.isnan(a)[:, :, None] | np.isnan(a)[:, None, :]
            table = np.where(none, r, np.where(clear, (r - a[:, :, None] * a[:, None, :]) / scale, np.nan))
    return table[:, 0, 1]


def same_length(*columns: pd.Series) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose arrays have the same lengths, as their places and one matrix per column."""
    sizes = pd.DataFrame({i: c.map(len) for i, c in enumerate(columns)})
    for _, places in sizes.groupby(list(sizes.columns)).indices.items():
        yield places, [np.stack(c.to_numpy()[places]).astype(float) for c in columns]


@F.pandas_udf(DoubleType())
def _partial(x: pd.Series, y: pd.Series, given: pd.Series) -> pd.Series:
    out = np.full(len(x), np.nan)
    for places, (a, b, g) in same_length(x, y, given):
        n = a.shape[1]
        if n:
            z = unit_rows(np.concatenate((a[:, None], b[:, None], g.reshape(len(a), -1, n)), axis=1))
            out[places] = take_out(np.einsum("kin,kjn->kij", z, z))
    return pd.Series(out)


def partial_correlation(x: Column, y: Column, given: Column | None = None) -> Column:
    """Correlation of the vectors x and y after the vectors ``given`` (an array of them) are taken out of both.

    The vectors of a row have one length. Null where ``take_out`` has nan.
    """
    flat = F.array().cast("array<double>") if given is None else F.flatten(given)
    return F.nanvl(_partial(x, y, flat), F.lit(None).cast("double"))
