"""Ordered computations over whole tables without sorting a table, or a hot key, in one task.

Rows are cut into blocks by an integer expression that follows the order (an id or a time, divided by a block
width). Work inside a block is a window over ``keys + block``; what crosses blocks is one small row per block. For an
order over a whole table those rows are cut into spans once more, so no window holds more than a block or a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096

_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
          "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _before(blocks: DataFrame, keys: list[str], kinds: dict[str, str], spans: bool) -> DataFrame:
    """For every block, the merge of all earlier blocks of the same keys (NULL when there is none). ``spans`` cuts
    the block rows once more, for orders over a whole table."""
    if not spans:
        w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return blocks.select(*keys, "_block", *[_AGG[k](c).over(w).alias(f"_p_{c}") for c, k in kinds.items()])
    spanned = blocks.withColumn("_span", F.floor(F.col("_block") / SPAN))
    totals = spanned.groupBy(*keys, "_span").agg(*[_AGG[k](c).alias(c) for c, k in kinds.items()])
    across = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_span", *[_AGG[k](c).over(across).alias(f"_s_{c}") for c, k in kinds.items()])
    inside = Window.partitionBy(*keys, "_span").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    spanned = spanned.select(*keys, "_span", "_block",
                             *[_AGG[k](c).over(inside).alias(f"_b_{c}") for c, k in kinds.items()])
    merged = spanned.join(totals, [*keys, "_span"])
    return merged.select(*keys, "_block",
                         *[_MERGE[k](F.col(f"_s_{c}"), F.col(f"_b_{c}")).alias(f"_p_{c}") for c, k in kinds.items()])


def running(df: DataFrame, keys: list[str], order: list[Column], block: Column,
            measures: dict[str, tuple[Column, str]], inclusive: bool = True) -> DataFrame:
    """Add running ``sum`` / ``max`` / ``min`` measures along ``order`` inside ``keys``, with or without the current row.

    ``block`` must be non-decreasing along ``order``; ``order`` must be total.
    """
    if not keys:
        return running(df.withColumn("_all", F.lit(0)), ["_all"], order, block, measures, inclusive).drop("_all")
    kinds = {name: kind for name, (_, kind) in measures.items()}
    base = df.withColumn("_block", block.cast("long"))
    totals = base.groupBy(*keys, "_block").agg(*[_AGG[kind](c).alias(name) for name, (c, kind) in measures.items()])
    before = _before(totals, keys, kinds, spans=keys == ["_all"])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = base.withColumns({f"_l_{name}": _AGG[kind](c).over(inside) for name, (c, kind) in measures.items()})
    joined = local.join(before, [*keys, "_block"])
    joined = joined.withColumns({name: _MERGE[kind](F.col(f"_p_{name}"), F.col(f"_l_{name}"))
                                 for name, kind in kinds.items()})
    return joined.drop("_block", *[f"_p_{n}" for n in kinds], *[f"_l_{n}" for n in kinds])


def number_rows(df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str = "rn") -> DataFrame:
    """Number rows 1, 2, 3 … along ``order`` inside ``keys`` (the whole table when ``keys`` is empty)."""
    return running(df, keys, order, block, {name: (F.lit(1).cast("long"), "sum")})


def rolling(df: DataFrame, order: list[Column], block: Column, width: int,
            measures: dict[str, Column], chunk: int = 1 << 16) -> DataFrame:
    """Apply window aggregates over each row and the ``width - 1`` rows before it, across the whole table.

    Rows are numbered, cut into chunks, and the tail of a chunk is also sent to the next one as a lead-in.
    """
    numbered = number_rows(df, [], order, block, "_rn")
    home = F.floor((F.col("_rn") - 1) / chunk)
    lead_in = F.pmod(F.col("_rn") - 1, F.lit(chunk)) >= chunk - (width - 1)
    placed = numbered.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(lead_in, F.array(home, home + 1)).otherwise(F.array(home))))
    w = Window.partitionBy("_chunk").orderBy("_rn").rowsBetween(-(width - 1), 0)
    out = placed.withColumns({name: c.over(w) for name, c in measures.items()})
    return out.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home").withColumnRenamed("_rn", "rn")
