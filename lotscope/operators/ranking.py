"""Year selection, blended scores, leaderboards, nudges and ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import numbers as nm
from lotscope.functions import text as tx
from lotscope.operators.rules import slogan_peers
from lotscope.operators.vectors import with_era
from lotscope.plans.lineage import cut_lineage
from lotscope.plans.ranked import top_k

#: Best similarities of asked entities: (q, year, key) in, (q, year, key, sim) out, without those that have no reference.
Lookup = Callable[[DataFrame], DataFrame]


def pick_years(image: DataFrame, text: DataFrame, top: int = 5, cap: int = 8) -> DataFrame:
    """Candidate years of a query: its best image years, then its best text years not yet present, eight at most.
    A year chosen by text alone keeps its image similarity, or 0; a query without any image year has no candidates.

    ``image``: (q, year, sim), ``text``: (q, year, sim, phrase, type). Result: (q, year, pick, image_score, raw, phrase,
    type), the last three of the year's best text. Both are brought together by query once; ranks and picks follow there.
    """
    seen = image.select("q", "year", F.col("sim").alias("image"), F.lit(None).cast("struct<raw: double, phrase: string, type: string>").alias("t"))
    said = text.select("q", "year", F.lit(None).cast("double").alias("image"), F.struct(F.col("sim").alias("raw"), "phrase", "type").alias("t"))
    both = seen.unionByName(said).repartition("q").groupBy("q", "year").agg(F.max("image").alias("image"), F.max("t").alias("t"))
    rank = lambda c: F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last(c), F.asc("year")))
    place = lambda c, r: F.when(F.col(c).isNotNull() & (F.col(r) <= top), F.col(r))
    ranked = both.withColumns({"i": rank("image"), "j": rank("t.raw"), "any_image": F.max("image").over(Window.partitionBy("q")).isNotNull()})
    ranked = ranked.withColumns({"i": place("image", "i"), "j": place("t.raw", "j")}).where("any_image and coalesce(i, j) is not null")
    order = Window.partitionBy("q").orderBy(F.asc_nulls_last("i"), F.asc_nulls_last("j"))
    picked = ranked.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= cap)
    return picked.select("q", "year", "pick", F.coalesce("image", F.lit(0.0)).alias("image_score"), "t.raw", "t.phrase", "t.type")


def _scored(rows: DataFrame, bonus: DataFrame) -> DataFrame:
    """Blend image and text of (…, image_score, raw, phrase); ``bonus`` gives the rarity bonus per phrase."""
    named = rows.withColumns({"phrase": F.coalesce("phrase", F.lit("Unknown")), "slogan_score": nm.norm_sim(F.coalesce("raw", F.lit(0.0)))})
    known = named.join(bonus, "phrase", "left")
    rarity = F.when(F.size(tx.content_tokens(F.col("phrase"))) > 0, F.coalesce("bonus", F.lit(S.RARITY_CAP)))
    overall = nm.blend(F.col("image_score"), F.col("slogan_score"), rarity)
    return known.withColumn("overall", F.round(overall, 12)).drop("bonus", "raw")


def score_entities(picks: DataFrame, bonus: DataFrame, keep: int = 10) -> DataFrame:
    """Best phrase of each picked year, blended and ranked. ``picks`` as ``pick_years`` returns them."""
    scored = _scored(picks.drop("type"), bonus)
    return top_k(scored, ["q"], [F.desc("overall"), F.desc("slogan_score"), F.asc("pick")], keep)


def leaderboard(image: DataFrame, text: DataFrame, bonus: DataFrame) -> DataFrame:
    """Every year of the text bank ranked for each query, scores rounded to five digits."""
    best = text.select("q", "year", F.col("sim").alias("raw"), "phrase", "type")
    rows = best.join(image.select("q", "year", F.col("sim").alias("image_score")), ["q", "year"], "left")
    scored = _scored(rows.withColumn("image_score", F.coalesce("image_score", F.lit(0.0))), bonus)
    out = scored.select("q", "year", "phrase", "type", *[F.round(c, 5).alias(c) for c in ("image_score", "overall")],
                        F.round("slogan_score", 5).alias("text_score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("overall"), F.asc("year"))))


def ref_check(candidates: DataFrame, lookup: Lookup) -> DataFrame:
    """Nudge each candidate by how its own references compare with the candidates' mean; candidates without
    references stay. ``lookup`` gives the best similarity of each asked (q, year, key). The candidates, ten a query at
    most, are materialised once: they are looked up and then joined with what was found."""
    keyed = cut_lineage(candidates).withColumn("key", tx.normalize_key(F.col("phrase")))
    found = lookup(keyed.select("q", "year", "key")).select("q", "year", "key", F.col("sim").alias("ref_sim"))
    refs = keyed.join(found, ["q", "year", "key"], "left").withColumn("_mean", F.avg("ref_sim").over(Window.partitionBy("q")))
    moved = nm.clamp(F.col("overall") + S.REFERENCE_NUDGE * (F.col("ref_sim") - F.col("_mean")), 0.0, 1.0)
    out = refs.withColumn("overall", F.round(F.coalesce(moved, F.col("overall")), 12)).drop("_mean", "rank", "key")
    return top_k(out, ["q"], [F.desc("overall"), F.desc("slogan_score"), F.asc("pick")], 10)


def ranked_matches(image: DataFrame, text: DataFrame, bonus: DataFrame, lookup: Lookup) -> DataFrame:
    """Candidates of each query, best first: years picked by image and text, phrases scored, references checked.

    Restricting a query to known years is up to ``image`` and ``text`` (``best_sims`` with ``years``).
    """
    return ref_check(score_entities(pick_years(image, text), bonus), lookup)


def year_contrast(candidates: DataFrame, image: DataFrame, known_years: DataFrame) -> DataFrame:
    """(q, year, year_score): own year's best reference against the mean of the other years of its era."""
    in_eras = lambda df: with_era(df.select("year").distinct()).select("year", "era")
    spans, asked = in_eras(known_years), in_eras(candidates)
    rivals = asked.join(spans.withColumnRenamed("year", "other"), "era").where("year <> other").select("year", "other").distinct()
    own = candidates.select("q", "year").join(image, ["q", "year"])
    others = own.join(rivals, "year").join(image.select("q", F.col("year").alias("other"), F.col("sim").alias("o")), ["q", "other"])
    means = others.groupBy("q", "year", "sim").agg(F.avg("o").alias("m"))
    return means.select("q", "year", nm.clamp((F.col("sim") - F.col("m")) / S.CONTRAST_SCALE, -1.0, 1.0).alias("year_score"))


def entity_contrast(candidates: DataFrame, lookup: Lookup, entries: DataFrame) -> DataFrame:
    """(q, year, phrase, sid_score): own references against the best of similar slogans of other years.
    ``entries``: (idx, year, phrase, key), the distinct entities of the image bank. Only own entities and those of at
    most ten peers are looked up."""
    ents = candidates.select("year", "phrase").distinct().withColumn("idx", F.concat_ws("|", "year", "phrase"))
    peers = slogan_peers(entries.select("idx", "year", "phrase"), ents).select("idx", "peer")
    peers = ents.join(peers, "idx").join(entries.select(F.col("idx").alias("peer"), F.struct("year", "key").alias("e")), "peer")
    peers = peers.groupBy("year", "phrase").agg(F.collect_list("e").alias("peers"))
    asked = candidates.select("q", "year", "phrase").join(peers, ["year", "phrase"], "left")
    own = F.struct("year", tx.normalize_key(F.col("phrase")).alias("key"))
    each = asked.select("q", "year", "phrase", F.explode(F.concat(F.array(F.struct(own.alias("e"), F.lit(True).alias("own"))), F.transform(
        F.coalesce("peers", F.array().cast("array<struct<year: int, key: string>>")), lambda e: F.struct(e.alias("e"), F.lit(False).alias("own"))))).alias("x"))
    each = each.select("q", "year", "phrase", F.col("x.e.year").alias("e_year"), F.col("x.e.key").alias("key"), "x.own")
    found = lookup(each.select("q", F.col("e_year").alias("year"), "key")).select("q", F.col("year").alias("e_year"), "key", "sim")
    scored = each.join(found, ["q", "e_year", "key"]).groupBy("q", "year", "phrase").agg(
        F.max(F.when(F.col("own"), F.col("sim"))).alias("own"), F.max(F.when(~F.col("own"), F.col("sim"))).alias("best_peer")).where("own is not null")
    contrast = nm.clamp((F.col("own") - F.col("best_peer")) / S.CONTRAST_SCALE, -1.0, 1.0)
    alone = nm.clamp((F.col("own") - S.ENTITY_BASELINE) / S.CONTRAST_SCALE, -1.0, 1.0) * 0.5
    return scored.select("q", "year", "phrase", F.coalesce(contrast, alone).alias("sid_score"))


def rerank(candidates: DataFrame, image: DataFrame, lookup: Lookup, entries: DataFrame, known_years: DataFrame) -> DataFrame:
    """Add bounded year and entity contrasts to the overall score and rank again."""
    ys = year_contrast(candidates, image, known_years)
    ss = entity_contrast(candidates, lookup, entries)
    both = candidates.drop("rank").join(ys, ["q", "year"], "left").join(ss, ["q", "year", "phrase"], "left")
    both = both.withColumns({"year_score": F.coalesce("year_score", F.lit(0.0)), "sid_score": F.coalesce("sid_score", F.lit(0.0))})
    both = both.withColumn("rerank_delta", nm.rerank_delta(F.col("year_score"), F.col("sid_score")))
    out = both.withColumn("overall", F.round(F.least(F.lit(1.0), F.col("overall") + F.col("rerank_delta")), 12))
    return top_k(out, ["q"], [F.desc("overall"), F.desc("slogan_score"), F.asc("pick")], 10)


def top_matches(ranked: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of the first ``k`` candidates those at or above the threshold."""
    return ranked.where((F.col("rank") <= k) & (F.col("overall") >= threshold))


def gaps(candidates: DataFrame, order) -> DataFrame:
    """Per item: lead of #1 over #2, and over the best other slogan (NULL when there is none)."""
    two = top_k(candidates, ["item_id"], order, 2).groupBy("item_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("overall"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("overall"))).alias("b"))
    best = candidates.groupBy("item_id", tx.normalize_key(F.col("slogan")).alias("key")).agg(F.max("overall").alias("m"))
    keys = top_k(best, ["item_id"], [F.desc("m"), F.asc("key")], 2).groupBy("item_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("m"))).alias("x"), F.max(F.when(F.col("rank") == 2, F.col("m"))).alias("y"))
    return two.join(keys, "item_id").select("item_id", (F.col("a") - F.col("b")).alias("gap"), (F.col("x") - F.col("y")).alias("slogan_gap"))


def rank_of(board: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank of the true year on each query's board; NULL when absent. ``truth``: (q, true_year)."""
    hit = truth.join(board.select("q", F.col("year").alias("true_year"), "rank"), ["q", "true_year"], "left")
    return hit.groupBy("q", "true_year").agg(F.min("rank").alias("rank"))


def rank_of_slogan(board: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank of the true (year, slogan); a same-year different slogan does not count."""
    keyed = board.select("q", tx.year4(F.col("year")).alias("_y"), tx.basic_norm(F.col("phrase")).alias("_k"), "rank")
    asked = truth.withColumns({"_y": tx.year4(F.col("true_year")), "_k": tx.basic_norm(F.col("true_phrase"))})
    hit = asked.join(keyed, ["q", "_y", "_k"], "left")
    return hit.groupBy("q", "true_year", "true_phrase").agg(F.min("rank").alias("rank"))
