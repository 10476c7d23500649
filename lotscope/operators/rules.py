"""Price rules, catalogue lookups, twin families, coverage and similar slogans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import text as tx
from lotscope.plans.overlap import most_shared
from lotscope.plans.ranked import first_by, top_n

REQUIRED = ("year", "slogan", "max price single", "max price year", "notes")
RULE_VALUES = ["max_price_single", "max_price_year", "notes", "amount_needed"]


def load_rules(sheet: DataFrame) -> DataFrame:
    """Clean rule table: one row per (year, slogan) with the values of its last row and the position of its first.

    ``sheet`` has a ``seq`` column and the sheet's own headers in any case; the amount column is optional.
    """
    named = sheet.toDF(*[name.strip().lower().replace("_", " ") for name in sheet.columns])
    missing = [name for name in REQUIRED if name not in named.columns]
    if missing:
        raise ValueError(f"missing expected columns: {', '.join(missing)}")
    if "amount needed" not in named.columns:
        named = named.withColumn("amount needed", F.lit(""))
    text = lambda name: F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
    rows = named.select("seq", text("year").alias("year"), text("slogan").alias("slogan"),
                        *[text(v.replace("_", " ")).alias(v) for v in RULE_VALUES])
    rows = rows.where((F.col("year") != "") & (F.col("slogan") != ""))
    return rows.groupBy("year", "slogan").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct(*RULE_VALUES), "seq").alias("v")) \
        .select("year", "slogan", "first_seq", "v.*")


def lookup_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule of each (year, slogan): the exact one, else the first rule of that year with the same identity key.

    Both lookups are unique per key, so the join never multiplies rows; Spark broadcasts the rules while they fit
    its size threshold and shuffles otherwise. No rule gives empty texts and amount 0.
    """
    values = F.struct(*RULE_VALUES)
    exact = rules.select(F.col("year").alias("_y"), F.col("slogan").alias("_s"), values.alias("_exact"))
    loose = first_by(rules.withColumn("_key", tx.normalize_key(F.col("slogan"))), ["year", "_key"], [F.asc("first_seq")])
    loose = loose.select(F.col("year").alias("_y"), "_key", values.alias("_loose"))
    keyed = df.withColumns({"_y": F.trim(F.col("year").cast("string")), "_s": F.trim("slogan"), "_key": tx.normalize_key(F.col("slogan"))})
    hit = keyed.join(exact, ["_y", "_s"], "left").join(loose, ["_y", "_key"], "left")
    rule = F.coalesce("_exact", "_loose")
    out = hit.select(*df.columns, rule.alias("_rule"))
    texts = [F.coalesce(f"_rule.{v}", F.lit("")).alias(v) for v in RULE_VALUES[:3]]
    return out.select(*df.columns, *texts, F.coalesce(tx.amount_needed(F.col("_rule.amount_needed")), F.lit(0)).alias("amount_needed"))


def needed_years(rules: DataFrame) -> DataFrame:
    """Distinct numeric years that still want something."""
    wanted = rules.where(tx.amount_needed(F.col("amount_needed")) > 0)
    return wanted.select(F.col("year").try_cast("int").alias("year")).where("year is not null").distinct()


def year_queries(years: DataFrame, terms: list[str]) -> DataFrame:
    """Search texts "term year", each tagged with its year; the term list is a short setting."""
    return years.select("year", F.posexplode(F.array(*[F.lit(t) for t in terms])).alias("term_no", "term")) \
        .select(F.concat_ws(" ", "term", "year").alias("query"), "year", "term_no").orderBy("year", "term_no")


def era_queries(words: DataFrame, prefixes=S.ERA_PREFIXES, types=S.ITEM_TYPES) -> DataFrame:
    """Search texts "prefix word type" per era word."""
    each = words.select("word", "era", F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("prefix"))
    each = each.select("*", F.explode(F.array(*[F.lit(t) for t in types])).alias("type"))
    return each.select(F.concat_ws(" ", "prefix", "word", "type").alias("query"), "era")


def identity(df: DataFrame) -> DataFrame:
    return df.withColumn("key", tx.normalize_key(F.col("slogan")))


def coverage(needed: DataFrame, text: DataFrame, image: DataFrame) -> DataFrame:
    """Needed entities with flags: known to the text bank, known to the image bank."""
    keys = lambda df, flag: identity(df).select(F.col("year").cast("string").alias("year"), "key").distinct().withColumn(flag, F.lit(True))
    rows = identity(needed.select(F.col("year").cast("string").alias("year"), "slogan").distinct())
    out = rows.join(keys(text, "in_text"), ["year", "key"], "left").join(keys(image, "in_image"), ["year", "key"], "left")
    out = out.select("year", "slogan", F.coalesce("in_text", F.lit(False)).alias("in_text"), F.coalesce("in_image", F.lit(False)).alias("in_image"))
    return out.withColumns({"fully_missing": ~F.col("in_text") & ~F.col("in_image"), "no_text": ~F.col("in_text")})


def key_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(year, key) pairs on one side only, marked ``left`` or ``right``."""
    ka, kb = [identity(d).select("year", "key").distinct() for d in (a, b)]
    return ka.join(kb, ["year", "key"], "left_anti").withColumn("side", F.lit("left")) \
        .unionByName(kb.join(ka, ["year", "key"], "left_anti").withColumn("side", F.lit("right")))


def staleness(bank: DataFrame, catalogue: DataFrame) -> DataFrame:
    """How many bank entries the catalogue lacks, and how many await the bank."""
    return key_diff(bank, catalogue).agg(F.count_if(F.col("side") == "left").alias("stale"),
                                         F.count_if(F.col("side") == "right").alias("pending"))


def entry_id(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue id of (year, slogan); the last entry of a key counts; "_year_Y" or "_year_unknown" otherwise."""
    ids = identity(catalogue).groupBy(F.col("year").cast("int").alias("_y"), F.col("key").alias("_key")) \
        .agg(F.max("entry_id").cast("string").alias("_id"))
    lead = F.get(F.split(F.trim(F.col("year").cast("string")), r"\s+"), F.lit(0)).try_cast("int")
    keyed = df.withColumns({"_y": lead, "_key": tx.normalize_key(F.col("slogan"))})
    hit = keyed.join(ids, ["_y", "_key"], "left")
    fallback = F.concat(F.lit("_year_"), F.coalesce(F.col("_y").cast("string"), F.lit("unknown")))
    return hit.withColumn("entry", F.coalesce("_id", fallback)).drop("_y", "_key", "_id")


def slogan_years(catalogue: DataFrame) -> DataFrame:
    """Years in which each slogan key exists (at most one entry per calendar year)."""
    pairs = identity(catalogue).where("key <> ''").select("key", "year").distinct()
    return pairs.groupBy("key").agg(F.array_sort(F.collect_list("year")).alias("years"))


def twin_registry(catalogue: DataFrame) -> DataFrame:
    """Slogan keys with two or more editions, and how many."""
    named = identity(catalogue.where(F.trim("slogan") != "")).where("key <> ''")
    return named.groupBy("key").agg(F.count(F.lit(1)).alias("n_editions")).where("n_editions >= 2")


def registry_summary(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("n_families"), F.coalesce(F.sum("n_editions"), F.lit(0)).alias("n_entries"))


def twin_guard(df: DataFrame, registry: DataFrame, name: Column | None = None) -> DataFrame:
    """Flag rows whose slogan has several editions. ``name`` is what the registry was built over, the slogan by default."""
    fams = registry.select(F.col("key").alias("_key"), F.lit(True).alias("is_twin"))
    keyed = df.withColumn("_key", tx.normalize_key(F.col("slogan") if name is None else name))
    return keyed.join(fams, "_key", "left").withColumn("is_twin", F.coalesce("is_twin", F.lit(False))).drop("_key")


def with_game_year(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calendar year of the game for (slogan, season), when the catalogue knows one."""
    games = identity(catalogue.where("game_year is not null")).groupBy(F.col("key").alias("_key"), "year").agg(F.max("game_year").alias("game_year"))
    keyed = df.withColumn("_key", tx.normalize_key(F.col("slogan")))
    return keyed.join(games, ["_key", "year"], "left").drop("_key")


def resolve_printed_year(readings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The one edition of a reading's slogan that carries its printed year; NULL when none or several do.

    Editions are listed under each year they may carry, and only years with a single edition stay, so the lookup
    is an equi join that never multiplies rows.
    """
    editions = identity(catalogue).select("key", "entry_id", "year", F.explode(
        F.array_distinct(F.filter(F.array("year", "game_year"), lambda y: y.isNotNull()))).alias("marker"))
    unique = editions.groupBy(F.col("key").alias("_key"), F.col("marker").alias("printed_year")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("entry_id").alias("edition"), F.max("year").alias("edition_year")).where("_n = 1").drop("_n")
    keyed = readings.withColumn("_key", tx.normalize_key(F.col("slogan")))
    return keyed.join(unique, ["_key", "printed_year"], "left").drop("_key")


def token_df(df: DataFrame, text: str) -> DataFrame:
    """In how many rows each token occurs."""
    return df.select(F.explode(F.array_distinct(tx.tokenize(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def rarity_bonus(phrases: DataFrame, freq: DataFrame) -> DataFrame:
    """Bonus of each distinct phrase for rare words, at most 0.04; phrases of stopwords only get NULL."""
    words = phrases.select("phrase").distinct().select("phrase", F.explode_outer(tx.content_tokens(F.col("phrase"))).alias("token"))
    weighed = words.join(freq, "token", "left")
    f = F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)).cast("double")
    return weighed.groupBy("phrase").agg(F.avg(F.when(F.col("token").isNotNull(), 1 / (f * f))).alias("_w")) \
        .select("phrase", F.least(S.RARITY_CAP * F.col("_w"), F.lit(S.RARITY_CAP)).alias("bonus"))


def slogan_peers(entries: DataFrame, targets: DataFrame | None = None, k: int = S.MAX_PEERS) -> DataFrame:
    """Up to ``k`` entries of other years sharing most tokens with each target (first entry on ties).

    ``entries`` and ``targets``: (idx, year, phrase); targets default to the entries themselves.
    """
    tokens = lambda df: df.select("idx", "year", tx.content_tokens(F.col("phrase")).alias("toks"))
    pool = tokens(entries)
    return most_shared(pool, pool if targets is None else tokens(targets), k)


def attractors(matches: DataFrame, n: int = 25) -> DataFrame:
    """Most frequent (year, slogan) among listed matches."""
    counted = matches.groupBy("year", "slogan").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counted, [F.desc("n"), F.asc("year"), F.asc("slogan")], n)


def attractor_slogans(matches: DataFrame, n: int = 25) -> DataFrame:
    """Slogans listed by most items."""
    pairs = matches.groupBy("slogan", "item_id").agg(F.lit(1).alias("_one"))
    return top_n(pairs.groupBy("slogan").agg(F.count(F.lit(1)).alias("n_items")), [F.desc("n_items"), F.asc("slogan")], n)


def degenerate(matches: DataFrame) -> DataFrame:
    """Items with two or more listed matches that all name one slogan."""
    return matches.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("slogan").alias("lo"), F.max("slogan").alias("hi")) \
        .where("n >= 2 and lo <=> hi").select("item_id")


def zero_score(records: DataFrame) -> DataFrame:
    """Items whose best score is exactly zero; a missing score is not zero."""
    return records.where("best_score = 0.0").select("item_id")
