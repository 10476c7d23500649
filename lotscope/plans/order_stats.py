"""Exact order statistics per group, without holding a group in one task.

Equal values are counted before the shuffle. Each wanted rank is then narrowed to a bucket of values that agree in the
leading 22 bits of an ordered code, and to one of those that agree in 21 bits more; only the values of that bucket, of
2^20 codes at most however values are spread, are ranked. No step orders more than 2^22 rows of a group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_code(v: Column) -> Column:
    """A whole number of 62 bits and sign that never decreases as the double ``v`` grows: exponent, then 51 bits of the
    fraction. NULL and zero are 0; NaN comes last."""
    size = F.abs(v)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(size))  # off by one next to a power of two
    e = near + (size >= power(near + 1)).cast("int") - (size < power(near)).cast("int")
    step = F.lit(1 << 51)
    code = F.when(F.isnan(size), step * 2101).when(size == float("inf"), step * 2100).otherwise(
        (e + 1075) * step + ((size / power(e) - 1) * step).cast("long"))
    signed = F.when(v == 0, F.lit(0)).otherwise(F.when(v > 0, code).otherwise(-code)).cast("long")
    return F.coalesce(signed, F.lit(0).cast("long"))  # never NULL, so all uses of the counts stay one exchange


def coarse(v: Column) -> Column:
    """The leading 22 bits of the code: exponent and ten bits of the fraction."""
    return F.shiftright(ordered_code(v), 41)


def order_stats(df: DataFrame, keys: list[str], value: Column, ranks: dict[str, Column],
                weight: Column | None = None) -> DataFrame:
    """Values at 1-based ``ranks`` (expressions over ``n``, the group's row count), plus ``n``. A whole-number
    ``weight`` makes a row stand for several."""
    if not keys:
        return order_stats(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks, weight).drop("_all")
    counted = df.groupBy(*keys, value.alias("_v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_c"))
    counted = counted.withColumn("_k", ordered_code(F.col("_v").cast("double")))
    counted = counted.withColumns({"_b": F.shiftright("_k", 41), "_d": F.shiftright("_k", 20)})
    names = [f"_r_{name}" for name in ranks]

    def holding(buckets: DataFrame, inside: list[str], by: str) -> DataFrame:
        """Buckets, ordered by ``by`` inside a larger one that begins at ``_start``, in which a wanted rank falls."""
        along = Window.partitionBy(*inside).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        placed = buckets.withColumn("_end", F.col("_start") + F.sum("_bc").over(along)).withColumn("_start", F.col("_end") - F.col("_bc"))
        if "n" not in placed.columns:
            placed = placed.withColumn("n", F.sum("_bc").over(Window.partitionBy(*inside))) \
                .withColumns({f"_r_{name}": rank.cast("long") for name, rank in ranks.items()})
        hits = [(F.col(r) > F.col("_start")) & (F.col(r) <= F.col("_end")) for r in names]
        return placed.where(reduce(or_, hits)).drop("_bc", "_end")

    first = holding(counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc")).withColumn("_start", F.lit(0).cast("long")), keys, "_b")
    finer = counted.join(first, [*keys, "_b"]).groupBy(*keys, "_b", "_d", "n", "_start", *names).agg(F.sum("_c").alias("_bc"))
    second = holding(finer, [*keys, "_b"], "_d").drop("_b")
    fine = Window.partitionBy(*keys, "_d").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(second, [*keys, "_d"]).withColumn("_hi", F.col("_start") + F.sum("_c").over(fine))
    lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")
    picks = [F.max(F.when((F.col(f"_r_{name}") > lo) & (F.col(f"_r_{name}") <= hi), F.col("_v"))).alias(name)
             for name in ranks]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def median_ranks(name: str) -> dict[str, Column]:
    n = F.col("n")
    return {f"{name}_lo": F.floor((n + 1) / 2), f"{name}_hi": F.floor((n + 2) / 2)}


def median_of(name: str) -> Column:
    return (F.col(f"{name}_lo") + F.col(f"{name}_hi")) / 2


def exclusive_quartile_ranks(name: str, i: int) -> dict[str, Column]:
    """Ranks around the i-th quartile at position i*(n+1)/4, clamped inside the sample."""
    n = F.col("n")
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
    return {f"{name}_a": j, f"{name}_b": j + 1}


def exclusive_quartile(name: str, i: int) -> Column:
    n = F.col("n")
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
    d = i * (n + 1) - j * 4
    return (F.col(f"{name}_a") * (4 - d) + F.col(f"{name}_b") * d) / 4


def median(df: DataFrame, keys: list[str], value: Column, name: str, weight: Column | None = None) -> DataFrame:
    """Exact median per group as ``name``, with the group's row count ``n``."""
    stats = order_stats(df, keys, value, median_ranks(name), weight)
    return stats.withColumn(name, median_of(name)).drop(f"{name}_lo", f"{name}_hi")
