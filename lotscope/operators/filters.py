"""Row filters of listings, observations and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions.text import contains_any, is_non_alerting
from lotscope.plans.prefix import running
from lotscope.plans.ranked import first_by


def exclude_sellers(listings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop listings of excluded sellers, whatever the case of the name."""
    names = excluded.select(F.lower("seller").alias("_seller")).distinct()
    return listings.join(names, F.lower(listings["seller"]) == names["_seller"], "left_anti")


def exclude_categories(listings: DataFrame, categories=S.EXCLUDED_CATEGORIES) -> DataFrame:
    """Drop listings with an excluded category anywhere in their ancestry."""
    banned = F.array(*[F.lit(x) for x in categories])
    return listings.where(~F.coalesce(F.arrays_overlap("categories", banned), F.lit(False)))


def exclude_keywords(listings: DataFrame, title: str = "title", keywords=S.EXCLUDED_KEYWORDS) -> DataFrame:
    return listings.where(~contains_any(F.col(title), keywords))


def unseen(listings: DataFrame, seen: DataFrame) -> DataFrame:
    return listings.join(seen.select("item_id"), "item_id", "left_anti")


def crawl_unseen(listings: DataFrame, seen: DataFrame, cutoff: str = S.DOUBLE_SEEN_CUTOFF) -> DataFrame:
    """Never seen, or first seen before the cutoff and only once. ``seen`` holds (item_id, first_seen, times)."""
    done = seen.where(~((F.col("first_seen") < F.lit(cutoff)) & (F.col("times") < 2)))
    return listings.join(done.select("item_id"), "item_id", "left_anti")


def select_ids(ids: DataFrame, seen: DataFrame, cap: int = 0) -> DataFrame:
    """Unseen ids in list order (``seq``), at most ``cap`` when positive."""
    left = ids.join(seen.select("item_id"), "item_id", "left_anti")
    return left.orderBy("seq", "item_id").limit(cap) if cap > 0 else left


def since(lines: DataFrame, start: str) -> DataFrame:
    """Keep lines at or after an ISO prefix; blank times pass."""
    return lines.where((F.coalesce("ts", F.lit("")) == "") | (F.col("ts") >= start))


def gate_photos(photos: DataFrame, max_photos: int = S.MAX_PHOTOS, promising: float = S.PROMISING_AT) -> DataFrame:
    """Photos worth scoring: the first, and up to ``max_photos`` when the title has a year or photo 1 scored well.

    ``photos`` holds (item_id, photo_idx from 0, score, title_has_year). Each photo of an item meets one summary row.
    """
    lead = photos.groupBy("item_id").agg(F.max(
        F.col("title_has_year") | ((F.col("photo_idx") == 0) & (F.col("score") >= promising))).alias("_go"))
    near = photos.where(F.col("photo_idx") < max_photos).join(lead, "item_id", "left")
    return near.where((F.col("photo_idx") == 0) | F.coalesce("_go", F.lit(False))).drop("_go")


def needed_hits(confirmed: DataFrame) -> DataFrame:
    """Confirmed entities that meet a standing need; ``amount_needed`` comes from the rule lookup."""
    return confirmed.where((F.col("amount_needed") > 0) & ~is_non_alerting(F.col("slogan")))


def in_bank_years(df: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows whose year occurs in the bank."""
    return df.join(bank.select("year").distinct(), "year", "left_semi")


def cap_running(photos: DataFrame, order: list[Column], block: Column, cap: Column) -> DataFrame:
    """Crop budget per listing: each photo takes what is left of the cap."""
    run = running(photos, ["item_id"], order, block, {"_through": (F.col("crops"), "sum")})
    left = F.greatest(F.lit(0), cap - (F.col("_through") - F.col("crops")))
    return run.withColumn("taken", F.least(F.col("crops"), left)).drop("_through")


def dedup_first(listings: DataFrame, order: list[Column]) -> DataFrame:
    """First row of every item id; rows without an id all stay."""
    known = first_by(listings.where("item_id is not null"), ["item_id"], order)
    return known.unionByName(listings.where("item_id is null"))
