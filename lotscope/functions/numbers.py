"""Scores, tiers, bands and loose numeric parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotscope import settings as S


def norm_sim(sim: Column) -> Column:
    """Raw text similarity on the [0.15, 0.35] scale, clamped to [0, 1]."""
    return clamp((sim - S.TEXT_SIM_LOW) / (S.TEXT_SIM_HIGH - S.TEXT_SIM_LOW), 0.0, 1.0)


def blend(image: Column, text: Column, rarity: Column) -> Column:
    """Overall score. ``rarity`` is NULL when the phrase has only stopwords; the cap at 1 applies otherwise."""
    base = S.IMAGE_WEIGHT * image + S.TEXT_WEIGHT * text
    base = base + F.when(text > S.TEXT_BOOST_FROM, (text - S.TEXT_BOOST_FROM) * S.TEXT_BOOST_SLOPE).otherwise(0.0)
    base = base * F.when(text < S.WEAK_TEXT_BELOW, S.WEAK_TEXT_FACTOR).otherwise(1.0)
    return F.when(rarity.isNull(), base).otherwise(F.least(F.lit(1.0), base + rarity))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def tier(overall: Column, gap: Column) -> Column:
    green = (overall >= S.GREEN_AT) | F.coalesce(gap >= S.GREEN_GAP, F.lit(False))
    return F.when(green, "green").when(overall < S.RED_BELOW, "red").otherwise("yellow")


def is_confirmed(overall: Column, gap: Column) -> Column:
    usable = gap.isNotNull() & ~F.isnan(gap)
    return (overall >= S.AUTO_AT) | (overall >= S.GREEN_AT) | (usable & (gap >= S.GREEN_GAP))


def is_confirmed_guarded(overall: Column, gap: Column) -> Column:
    """Confirmed, but a lone or nearly tied leader needs a clearly higher score."""
    thin = gap.isNull() | F.isnan(gap) | (gap < S.MIN_AUTO_GAP)
    return ~(thin & (overall < S.AUTO_AT + S.AUTO_GUARD_MARGIN)) & is_confirmed(overall, gap)


def money(v: Column) -> Column:
    """``$`` and two decimals of an amount of zero or more, rounded from its exact binary value, ties to even cents.

    The fraction has at most 60 binary places where it can matter (from half a cent on), so it is scaled to a whole number
    and divided in exact arithmetic; formatting would round the shortest decimal text instead.
    """
    whole, one = F.floor(v), F.lit(1 << 60).cast("decimal(20,0)")
    scaled = ((v - whole) * float(1 << 60)).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    cents, rest = F.floor((scaled - scaled % one) / one).cast("bigint"), scaled % one
    half = one / F.lit(2).cast("decimal(1,0)")
    up = (rest > half) | ((rest == half) & (cents % 2 == 1))
    total = cents + up.cast("bigint")
    return F.concat(F.lit("$"), (whole + F.floor(total / 100)).cast("bigint").cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))


def rerank_delta(year_score: Column, entity_score: Column) -> Column:
    return clamp(year_score, -1.0, 1.0) * S.YEAR_WEIGHT + clamp(entity_score, -1.0, 1.0) * S.ENTITY_WEIGHT


def price_band(c: Column) -> Column:
    return F.when(c < 5, "<5").when(c < 15, "5-15").when(c < 30, "15-30").when(c < 75, "30-75").otherwise("75+")


def buying_format(options: Column) -> Column:
    options = F.coalesce(options, F.array().cast("array<string>"))
    return F.when(F.array_contains(options, "AUCTION"), "auction").when(F.size(options) > 0, "fixed").otherwise("unknown")


def loose_float(c: Column) -> Column:
    """Text or number to double, else NULL."""
    return F.trim(c.cast("string")).try_cast("double")


def loose_int(c: Column, default: Column) -> Column:
    """Text or number to the nearest whole number (ties to even), else the default; so are numbers beyond a bigint, NaN
    and infinity. Counts that fit an int come as one."""
    value = F.bround(loose_float(c), 0)
    return F.coalesce(F.when(F.abs(value) < 2.0 ** 31, value.try_cast("int")), default)


def parse_confidence(c: Column) -> Column:
    label = F.lower(F.trim(c.cast("string")))
    out = None
    for name, value in S.CONFIDENCE_LABELS.items():
        out = F.when(label == name, value) if out is None else out.when(label == name, value)
    return out.otherwise(loose_float(c))


def size_class(c: Column) -> Column:
    label = F.lower(F.trim(c.cast("string")))
    return F.when(label.isin(*S.SIZE_CLASSES), label)


def parse_printed_year(c: Column) -> Column:
    """On-item year marker: four digits in [1960, 2035], or two digits of the marker eras; else NULL."""
    y = F.regexp_replace(F.trim(c.cast("string")), "^['’]+", "").try_cast("double")
    y = F.when(F.abs(y) < 1e9, F.when(y >= 0, F.floor(y)).otherwise(F.ceil(y))).cast("int")
    full = F.when((y < 0) | (y > 99), y).when(y.isin(83, 84) | y.between(97, 99), y + 1900).when(y <= 35, y + 2000)
    return F.when(full.between(1960, 2035), full)


def marker_matches(season: Column, game: Column, printed: Column) -> Column:
    """Does a printed marker equal the season year or the game year?"""
    hit = F.coalesce(season == printed, F.lit(False)) | F.coalesce(game == printed, F.lit(False))
    return printed.isNotNull() & hit


def round_or_null(c: Column, digits: int = 5) -> Column:
    return F.bround(c, digits)


def restrict_years(search_year: Column, search_era: Column, title_years: Column, title_decades: Column,
                   known: Column) -> Column:
    """Years a listing may be matched against, tight to broad; NULL means no restriction. ``known`` says whether
    the title's single year exists in the reference bank."""
    from lotscope.functions.text import era_year_set

    era = era_year_set(search_era)
    return (F.when(F.coalesce(search_year, F.lit(0)) != 0,
                   F.array_sort(F.array_union(F.array(search_year), title_decades)))
            .when(F.coalesce(search_era, F.lit("")) != "", F.when(F.size(era) > 0, era))
            .when(F.size(title_decades) > 0, title_decades)
            .when((F.size(title_years) == 1) & known, title_years))


def guided_count(total: Column, localized: Column, flagged: Column) -> Column:
    """Count a detector should look for: the claimed total capped by what was localized."""
    from_total = F.when(localized > 0, F.least(total, localized)).otherwise(F.greatest(F.lit(0), total - flagged))
    return F.when(F.coalesce(total, F.lit(0)) > 0, from_total).otherwise(0)


def count_inconsistent(total: Column, localized: Column) -> Column:
    """NULL when there is no count to check."""
    return F.when(F.coalesce(total, F.lit(0)) != 0, total != localized)
