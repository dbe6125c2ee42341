"""Current rows: of each key, the row with the latest value of a time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, keep: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``at``; rows that tie differ at most in the other columns and the greatest wins.

    Rows with a null key are no record of anything and are left out; a null ``at`` is older than any time. ``keep`` names
    the other columns wanted (default: all), so that nothing else is shuffled.
    """
    rest = [c for c in (keep if keep is not None else df.columns) if c not in keys and c != at]
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    picked = df.where(known).groupBy(*keys).agg(F.max(F.struct(F.col(at), *[F.col(c) for c in rest])).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in [at, *rest]])


def latest_same(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``latest`` for tables whose rows that tie are identical: every column is an aggregate of its own, so that the
    optimiser drops those a query does not use before the scan and the shuffle."""
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    order = F.struct(F.col(at))  # a null time is the oldest
    return df.where(known).groupBy(*keys).agg(*[F.max_by(F.col(c), order).alias(c) for c in df.columns if c not in keys])


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit halves that stand for a text key; distinct keys share both with a chance of 2**-128 a pair."""
    return F.xxhash64(F.lit("a"), *cols), F.xxhash64(F.lit("b"), *[F.reverse(c) for c in cols], *cols)
