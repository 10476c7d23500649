"""Best-k per group. A filtered ``row_number`` lets Spark prune every map task to k rows before the shuffle,
so a group holding a third of the table still ships at most k rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every ``keys`` group under ``order`` (which must be total), with a 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per ``keys`` group: the first under ``order``."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def top_n(df: DataFrame, order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of the whole table (a report's limit), optionally numbered."""
    out = df.orderBy(*order).limit(n)
    if rank is None:
        return out
    return out.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
