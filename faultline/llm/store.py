"""Intermediate tables in the shared folder, and small checked tables sent to the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import run_dir


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df once below the shared folder and go on from its files, so lost executors recompute nothing."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_filter(keys: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of fixed size over a long column (Bloom filter); it lets through every key and few others.

    Its size does not depend on the number of keys. It only saves work ahead of an exact join.
    """
    c = F.col(column)
    place = c.bitwiseXOR(F.shiftright(c, 23)).bitwiseXOR(F.shiftright(c, 46)).bitwiseAND(F.lit(bits - 1))
    places = keys.select(place.alias("p"))
    one = F.expr("shiftleft(1L, cast(p % 64 as int))")
    found = places.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(one).alias("m")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64)
    return out


def in_filter(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the int64 values the bitmap lets through."""
    p = (values ^ (values >> 23) ^ (values >> 46)) & (len(bitmap) * 64 - 1)
    return ((bitmap[p >> 6] >> (p & 63)) & 1).astype(bool)
