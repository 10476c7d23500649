"""Grading of past decisions: strata, rule ladders, lifts, precision, tripwires and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.plans.prefix import number_rows, rolling, running


def grade_counts(graded: DataFrame) -> DataFrame:
    """Per gate and path: lots, share counted exactly, share within one."""
    off = F.abs(F.col("selected") - F.col("reader_count"))
    return graded.groupBy("gate", "path").agg(F.count(F.lit(1)).alias("n"), F.avg((off == 0).cast("double")).alias("exact"),
                                              F.avg((off <= 1).cast("double")).alias("within_one"))


def rule_ladder(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Replay of certifying rules over judged rows (with a ``wrong`` flag): fires, wrong fires, coverage.

    All rules are counted in one pass; the short list of rules becomes rows afterwards.
    """
    yes = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(f"f{i}") for i, r in enumerate(yes.values())],
                      *[F.count_if(r & F.col("wrong")).alias(f"w{i}") for i, r in enumerate(yes.values())])
    lines = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("fires"), F.col(f"w{i}").alias("wrong_fires"),
                               (F.col(f"f{i}") / F.col("n")).alias("coverage")) for i, name in enumerate(yes)])
    return counts.select(F.explode(lines).alias("l")).select("l.*")


def event_lift(rows: DataFrame, event: Column) -> DataFrame:
    """How often a decision is wrong given an event, against how often it is wrong at all."""
    wrong = F.col("wrong").cast("double")
    out = rows.agg(F.avg(wrong).alias("baseline"), F.avg(F.when(event, wrong)).alias("given_event"), F.count_if(event).alias("n_event"))
    return out.withColumn("lift", F.col("given_event") / F.col("baseline"))


def auto_precision(rows: DataFrame) -> DataFrame:
    """Decisions per source, how many were corrected, and the precision that leaves."""
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("corrected").alias("n_corrected"))
    return out.withColumn("precision", 1 - F.col("n_corrected") / F.col("n"))


def tripwire(rows: DataFrame, order: str, width: int = 50, limit: float = 0.02, block_width: int = 1 << 16) -> DataFrame:
    """Share of disagreements over each ``width`` consecutive lots, and whether it exceeds the limit.
    ``order`` is a unique whole-number column."""
    out = rolling(rows, [F.asc(order)], F.floor(F.col(order) / block_width), width,
                  {"rate": F.avg(F.col("disagree").cast("double"))})
    return out.where(F.col("rn") >= width).withColumn("tripped", F.col("rate") > limit)


def streaks(rows: DataFrame, order: str, halt_at: int = 5, block_width: int = 1 << 16) -> DataFrame:
    """Length of the failure run that ends at each row; a success resets it."""
    block = F.floor(F.col(order) / block_width)
    numbered = number_rows(rows, [], [F.asc(order)], block, "rn")
    marked = running(numbered, [], [F.asc(order)], block, {"_ok": (F.when(~F.col("failed"), F.col("rn")), "max")})
    out = marked.withColumn("streak", F.col("rn") - F.coalesce("_ok", F.lit(0)))
    return out.withColumn("halt", F.col("streak") >= halt_at).drop("_ok")


def cumulative_precision(rows: DataFrame) -> DataFrame:
    """Correct and fired per rule and batch, with running totals over the batches. ``rows``: (rule, batch, correct)."""
    per = rows.groupBy("rule", "batch").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("rule").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    out = per.withColumns({"correct_so_far": F.sum("correct").over(w), "n_so_far": F.sum("n").over(w)})
    return out.withColumn("precision", F.col("correct_so_far") / F.col("n_so_far"))
