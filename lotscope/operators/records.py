"""Scan-log records: one row per processed listing, assembled from its scored matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import text as tx
from lotscope.plans.ranked import first_by, top_k

MATCHES = "array<struct<year:string,slogan:string,overall:double>>"
MATCH_ORDER = ["k1", "k2", "k3", "k4", "year"]


def best_first(score: str = "overall", ties: list[str] = MATCH_ORDER) -> list[Column]:
    """Total order: highest score first, then the input sequence columns."""
    return [F.desc(score), *[F.asc(t) for t in ties]]


def year_counts(matches: DataFrame) -> DataFrame:
    """Composition of each item: (item_id, year, n). Counted map-side, so a hot item ships one row per year."""
    return matches.where("year is not null").groupBy("item_id", "year").agg(F.count(F.lit(1)).alias("n"))


def scan_record(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """One record per listing: counts, top five matches, best needed match, title facts.

    Per-item collections hold at most one entry per calendar year and at most five matches.
    """
    counts = year_counts(matches).groupBy("item_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), F.col("n"))))).alias("year_counts"),
        F.sum("n").alias("crops_scored"))
    top = top_k(matches, ["item_id"], best_first(), 5).groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("year").cast("string").alias("year"), "slogan", "overall")))
        .alias("top_matches"))
    wanted = matches.where((F.col("needed") > 0) & ~tx.is_non_alerting(F.col("slogan")))
    needed = first_by(wanted, ["item_id"], best_first()).select(
        "item_id", F.struct(F.col("year").cast("string").alias("year"), "slogan", "overall").alias("best_needed"))
    out = listings.join(counts, "item_id", "left").join(top, "item_id", "left").join(needed, "item_id", "left")
    return out.select(
        "item_id", "title", "seller", "asking", "fmt", "condition", "ordered",
        tx.extract_lot_count(F.col("title")).alias("title_count"), tx.extract_years(F.col("title")).alias("title_years"),
        F.coalesce("crops_scored", F.lit(0)).alias("crops_scored"),
        F.coalesce("year_counts", F.create_map().cast("map<string,bigint>")).alias("year_counts"),
        F.coalesce(F.get("top_matches", F.lit(0))["overall"], F.lit(0.0)).alias("best_score"),
        F.coalesce(F.transform("top_matches", lambda m: m.dropFields("rank")),
                   F.array().cast(MATCHES)).alias("top_matches"),
        "best_needed", F.col("best_needed").isNotNull().alias("needed_hit"))


def composition_record(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """The part of a record that price and supply reports read: title facts and year composition."""
    counts = year_counts(matches).groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string"), F.col("n")))).alias("year_counts"),
        F.sum("n").alias("crops_scored"))
    return listings.join(counts, "item_id", "left").select(
        "item_id", "title", "asking", tx.extract_lot_count(F.col("title")).alias("title_count"),
        tx.extract_years(F.col("title")).alias("title_years"), F.coalesce("crops_scored", F.lit(0)).alias("crops_scored"),
        "year_counts", F.lit(None).cast(MATCHES).alias("top_matches"))


def composition() -> Column:
    """Year composition of a record, read off its matches where it has no counts of its own."""
    from_matches = F.filter(_matched_years(), lambda y: y.isNotNull() & (y != "None") & (y != ""))
    old_counts = F.map_from_entries(F.transform(
        F.array_distinct(from_matches),
        lambda y: F.struct(y, F.size(F.filter(from_matches, lambda z: z == y)).cast("bigint"))))
    return F.when(F.coalesce(F.size("year_counts"), F.lit(0)) > 0, F.col("year_counts").cast("map<string,bigint>")).otherwise(old_counts)


def _matched_years() -> Column:
    return F.transform(F.coalesce("top_matches", F.array().cast(MATCHES)), lambda m: m["year"])


def derive_listing(records: DataFrame) -> DataFrame:
    """Fields the market report needs, from new or old records: missing facts come from title and matches.

    ``title_count``, ``crops_scored`` and the composition fall through when zero; one title year beats the matches.
    """
    title_years = F.coalesce("title_years", tx.extract_years(F.col("title")))
    matched, counts = _matched_years(), composition()
    title_count = F.coalesce("title_count", tx.extract_lot_count(F.col("title"))).cast("bigint")
    crops = F.coalesce(F.col("crops_scored").cast("bigint"), F.size(matched).cast("bigint"))
    out = records.select("*", counts.alias("_counts"), title_years.alias("_years"), title_count.alias("_title_count"),
                         crops.alias("_crops"))
    total = F.aggregate(F.map_values("_counts"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    nonzero = lambda c: F.nullif(c, F.lit(0).cast("bigint"))
    return out.select(
        "item_id", F.coalesce("asking", F.lit(0.0)).alias("asking"), F.col("_counts").alias("year_counts"),
        F.coalesce(nonzero(F.col("_title_count")), nonzero(F.col("_crops")), nonzero(total), F.lit(1).cast("bigint")).alias("unit_count"),
        F.when(F.size("_years") == 1, F.get("_years", F.lit(0)).cast("string"))
        .when(F.size("_counts") == 1, F.get(F.map_keys("_counts"), F.lit(0))).alias("single_year"))
