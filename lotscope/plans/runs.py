"""Mergeable summaries of ordered outcomes: runs of failures and failures inside a rolling window.

Two summaries of rows that follow each other merge into that of both, so a long sequence is cut into blocks anywhere and
its blocks combine in any grouping.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "n bigint, lead bigint, trail bigint, longest bigint, head string, tail string, tripped boolean"
#: Rows of a block, and summaries that are merged at a time.
BLOCK, SPAN = 4096, 1024


class Runs(NamedTuple):
    """Rows, failures in a row at the start, at the end, and at most; the first and last outcomes (as many as a window
    has less one) as 0 and 1; whether some window had too many failures."""
    n: int
    lead: int
    trail: int
    longest: int
    head: str
    tail: str
    tripped: bool


def summarise(outcomes: str, width: int, limit: float) -> Runs:
    runs = outcomes.split("0")
    return Runs(len(outcomes), len(runs[0]), len(runs[-1]), max(map(len, runs)), outcomes[:width - 1], outcomes[max(0, len(outcomes) - width + 1):],
                too_many(outcomes, width, limit))


def too_many(outcomes: str, width: int, limit: float) -> bool:
    """Whether the share of failures exceeds the limit in some window of ``width`` outcomes."""
    if len(outcomes) < width:
        return False
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(outcomes.encode(), np.uint8) - 48)])
    return bool(((sums[width:] - sums[:-width]) / width > limit).any())


def merge(a: Runs, b: Runs, width: int, limit: float) -> Runs:
    return Runs(a.n + b.n, a.n + b.lead if a.lead == a.n else a.lead, b.n + a.trail if b.trail == b.n else b.trail,
                max(a.longest, b.longest, a.trail + b.lead), (a.head + b.head)[:width - 1] if a.n < width - 1 else a.head,
                b.tail if b.n >= width - 1 else (a.tail + b.tail)[1 - width:] if width > 1 else "",
                a.tripped or b.tripped or too_many(a.tail + b.head, width, limit))


def _folded(name: str, width: int, limit: float):
    """Grouped summaries merged in the order of ``_at``; the keys and the group's number come first in the result."""
    def fold(key, table):
        found = [Runs(**r) for r in table.sort_by("_at").select(list(Runs._fields)).to_pylist()]
        out = reduce(lambda a, b: merge(a, b, width, limit), found)
        heads = [pa.array([k.as_py()], k.type) for k in key]
        return pa.table([*heads, *(pa.array([v], table.schema.field(c).type) for c, v in out._asdict().items())],
                        names=[*(c for c in table.column_names if c not in Runs._fields and c not in ("_at", name)), "_at", *Runs._fields])
    return fold


def combine(parts: DataFrame, keys: list[str], width: int, limit: float) -> DataFrame:
    """Summaries (keys, ``_at``, columns of a summary) merged per key in the order of ``_at``, a bounded number each."""
    schema = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys) + f", _at bigint, {SCHEMA}"
    fold = _folded("_span", width, limit)
    return parts.withColumn("_span", F.lit(0).cast("bigint")).groupBy(*keys, "_span").applyInArrow(fold, schema)


def summaries(rows: DataFrame, keys: list[str], order: str, failed: Column, width: int, limit: float, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One summary per ``keys`` of the rows along the unique whole number ``order``.

    Outcomes of a block are put in order by Spark; blocks merge in spans, and spans of spans, until one is left, so no
    key's rows, nor its blocks, ever come to one task.
    """
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    low, high = (0, 0) if ends.lo is None else (ends.lo // block, ends.hi // block)
    at = (F.floor(F.col(order) / block) - low).alias("_at")
    one = F.struct(F.col(order).alias("o"), F.when(failed, "1").otherwise("0").alias("f"))
    blocks = rows.groupBy(*keys, at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["f"]), "").alias("outcomes"))
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + f", _at bigint, {SCHEMA}"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_()]

    def first(batches):
        for batch in batches:
            made = [summarise(o, width, limit) for o in batch.column("outcomes").to_pylist()]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "_at")), *columns], [*keys, "_at", *Runs._fields])

    out, high = blocks.mapInArrow(first, schema), high - low
    while True:
        high //= span
        out = out.withColumn("_span", F.floor(F.col("_at") / span)).groupBy(*keys, "_span").applyInArrow(_folded("_span", width, limit), schema)
        if high == 0:
            return out.drop("_at")
