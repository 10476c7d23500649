"""Two-reader resolution, confirmation, valuation, deals and the tables that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import numbers as nm
from lotscope.functions import text as tx
from lotscope.operators.filters import needed_hits
from lotscope.operators.rules import lookup_rule, twin_guard
from lotscope.plans.lineage import cut_lineage
from lotscope.plans.ranked import first_by, top_k, top_n

CROP = ["job", "crop"]
TIES = ["k1", "k2", "k3", "k4", "year"]


def best_first() -> list[Column]:
    return [F.desc("overall"), *[F.asc(k) for k in TIES]]


def ranked_candidates(cands: DataFrame, keep: int = 10) -> DataFrame:
    """Ordered candidate list of each crop, ten at most."""
    return top_k(cands, CROP, best_first(), keep)


def agreeing(ranked: DataFrame, readings: DataFrame) -> DataFrame:
    """Candidates whose slogan is the one the second reader saw on the same crop. Both sides are dealt by crop already,
    and a crop has ten candidates at most, so the keys are compared after they met."""
    left = ranked.withColumn("key", tx.normalize_key(F.col("slogan")))
    right = readings.select(*CROP, tx.normalize_key(F.col("slogan")).alias("_key"), F.col("slogan").alias("reading"),
                            "confidence", "flagged", "anchored", "printed_year")
    return left.join(right, CROP).where("key = _key").drop("_key")


def _gate() -> Column:
    return (F.col("confidence").isNull() | (F.col("confidence") >= S.READING_CONF_MIN)) & ~F.col("flagged") & F.coalesce("anchored", F.lit(True))


def resolve_pass1(agree: DataFrame) -> DataFrame:
    """Crops whose agreeing candidates share one year: resolved to the best ranked of them."""
    per_crop = agree.groupBy(*CROP).agg(
        F.min("year").alias("lo"), F.max("year").alias("hi"), F.bool_and(_gate()).alias("auto"),
        F.min_by(F.struct("year", "slogan", "type", F.col("rank").alias("matched_rank")), "rank").alias("pick"))
    return per_crop.where("lo = hi").select(*CROP, "pick.*", "auto", F.lit("gemini_auto").alias("source"))


def majority(resolved: DataFrame) -> DataFrame:
    """Modal year per job; clear when one year alone leads with two votes or more."""
    votes = resolved.groupBy("job", "year").agg(F.count(F.lit(1)).alias("n"), F.min("crop").alias("first_crop"))
    lead = top_k(votes, ["job"], [F.desc("n"), F.asc("first_crop"), F.asc("year")], 2)
    at = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    out = lead.groupBy("job").agg(at(1, "year").alias("majority_year"), at(1, "n").alias("n1"), at(2, "n").alias("n2"))
    return out.select("job", "majority_year", ((F.col("n1") >= 2) & ~F.coalesce(F.col("n1") == F.col("n2"), F.lit(False))).alias("clear"))


def resolve_pass2(agree: DataFrame, pass1: DataFrame) -> DataFrame:
    """Crops whose slogan exists in several years: the year printed on the item when it fits exactly one candidate,
    else the candidate nearest to a clear majority year, else the best ranked."""
    open_ = agree.join(pass1.select(*CROP), CROP, "left_anti").join(majority(pass1), "job", "left")
    cand = F.struct("year", "slogan", "type", F.col("rank").alias("matched_rank"))
    fits = nm.marker_matches(F.col("year"), F.col("game_year"), F.col("printed_year"))
    away = F.struct(F.abs(F.col("year") - F.col("majority_year")), F.col("rank"))
    per_crop = open_.groupBy(*CROP).agg(
        F.count_if(fits).alias("n_fit"), F.min_by(F.when(fits, cand), F.when(fits, F.col("rank"))).alias("printed"),
        F.min_by(cand, away).alias("near"), F.min_by(cand, "rank").alias("best"),
        F.bool_and(_gate()).alias("auto"), F.bool_or(F.coalesce("clear", F.lit(False))).alias("clear"))
    pick = F.when(F.col("n_fit") == 1, F.col("printed")).when(F.col("clear"), F.col("near")).otherwise(F.col("best"))
    source = F.when(F.col("n_fit") == 1, "gemini_printed_year").when(F.col("clear"), "gemini_majority").otherwise("gemini_clip_fallback")
    return per_crop.select(*CROP, pick.alias("pick"), "auto", source.alias("source")).select(*CROP, "pick.*", "auto", "source")


def read_crops(cands: DataFrame, readings: DataFrame) -> DataFrame:
    """Candidates that lead their crop (two) or that the second reader agrees with (``agrees``), written once: tops and
    both passes read them, so that candidates and readings are dealt by crop a single time."""
    ranked = ranked_candidates(cands).withColumn("key", tx.normalize_key(F.col("slogan")))
    right = readings.select(*CROP, tx.normalize_key(F.col("slogan")).alias("_key"), "confidence", "flagged", "anchored", "printed_year")
    met = ranked.join(right, CROP, "left").withColumn("agrees", F.coalesce(F.col("key") == F.col("_key"), F.lit(False)))
    used = ["year", "slogan", "type", "overall", "rank", "game_year", "printed_year", "confidence", "flagged", "anchored", "agrees"]
    return cut_lineage(met.where("agrees or rank <= 2").select(*CROP, *used))


def resolve(cands: DataFrame, readings: DataFrame) -> DataFrame:
    """Both passes: one row per crop on which the two readers agree."""
    return resolve_read(read_crops(cands, readings))


def resolve_read(rows: DataFrame) -> DataFrame:
    """Both passes over the rows of :func:`read_crops`."""
    agree = rows.where("agrees")
    first = resolve_pass1(agree)
    return first.unionByName(resolve_pass2(agree, first))


def resolve_telemetry(cands: DataFrame, readings: DataFrame) -> DataFrame:
    """Resolution counts per job."""
    done = resolve(cands, readings).groupBy("job").agg(
        F.count(F.lit(1)).alias("n_resolved"), F.count_if("auto").alias("n_confirmed"),
        F.count_if(F.col("source") == "gemini_majority").alias("n_majority"),
        F.count_if(F.col("source") == "gemini_printed_year").alias("n_printed_year"))
    crops = cands.groupBy(*CROP).agg(F.lit(1).alias("_one")).groupBy("job").agg(F.count(F.lit(1)).alias("n_crops"))
    out = crops.join(done, "job", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_resolved", "n_confirmed", "n_majority", "n_printed_year")]
    return out.select("job", *zero, (F.col("n_crops") - F.coalesce("n_resolved", F.lit(0))).alias("n_manual"))


def crop_tops(cands: DataFrame) -> DataFrame:
    """Leading candidate of each crop and its lead over the second."""
    return lead(top_k(cands, CROP, best_first(), 2))


def lead(ranked: DataFrame) -> DataFrame:
    """Leading candidate and lead of each crop from the first two ``ranked`` ones."""
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("overall")))
    lead = F.max(F.when(F.col("rank") == 1, F.struct("year", "slogan", "type", "overall")))
    return ranked.where("rank <= 2").groupBy(*CROP).agg(lead.alias("t"), (at(1) - at(2)).alias("gap")).select(*CROP, "t.*", "gap")


def classify(tops: DataFrame, resolution: DataFrame, reader_ok: Column) -> DataFrame:
    """confirmed, review or ignored per crop, with the entity and where it came from.

    Review exists only where the second reader failed; otherwise a crop is confirmed or ignored.
    """
    res = resolution.select(*CROP, F.col("year").alias("r_year"), F.col("slogan").alias("r_slogan"), F.col("auto").alias("r_auto"),
                            F.col("source").alias("r_source"))
    both = tops.join(res, CROP, "left")
    sure = nm.is_confirmed_guarded(F.col("overall"), F.col("gap"))
    confirmed = F.coalesce("r_auto", F.lit(False)) | sure
    label = F.when(confirmed, "confirmed").when(~reader_ok & (F.col("overall") >= S.RED_BELOW), "review").otherwise("ignored")
    return both.select(*CROP, label.alias("label"),
                       F.when(confirmed, F.coalesce("r_year", "year")).otherwise(F.col("year")).alias("year"),
                       F.when(confirmed, F.coalesce("r_slogan", "slogan")).otherwise(F.col("slogan")).alias("slogan"),
                       "overall", "gap", F.when(confirmed, F.coalesce("r_source", F.lit("clip_green"))).alias("source"))


def best_per_entity(rows: DataFrame, keys=("job", "year", "slogan")) -> DataFrame:
    """Best row of each entity of a job, by score, earliest crop on ties."""
    return first_by(rows, list(keys), [F.desc("overall"), F.asc("crop")])


def evaluate(cands: DataFrame, registry: DataFrame, rules: DataFrame, name: Column | None = None) -> DataFrame:
    """Per job and entity: confirmed, or review when the guard or an edition twin holds it back; rule values.

    ``name`` is what the registry was built over, the slogan by default."""
    tops = twin_guard(crop_tops(cands), registry, name)
    sure = nm.is_confirmed_guarded(F.col("overall"), F.col("gap")) & ~F.col("is_twin")
    lane = F.when(sure, "confirmed").when(F.col("overall") >= S.RED_BELOW, "review")
    best = best_per_entity(tops.withColumn("lane", lane).where("lane is not null"), ("job", "lane", "year", "slogan"))
    ruled = lookup_rule(best, rules)
    hit = (F.col("lane") == "confirmed") & (F.col("amount_needed") > 0) & ~tx.is_non_alerting(F.col("slogan"))
    return ruled.select("job", "lane", "year", "slogan", "overall", "gap", "crop", "max_price_single", "amount_needed", hit.alias("needed_hit"))


def lot_value(confirmed: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """Matched value of each lot, margin over asking, and the undervalued flag."""
    priced = lookup_rule(confirmed, rules).groupBy("job").agg(F.sum(tx.parse_price(F.col("max_price_single"))).alias("lot_value"),
                                                              F.count_if((F.col("amount_needed") > 0) & ~tx.is_non_alerting(F.col("slogan"))).alias("n_needed"))
    out = items.join(priced, "job", "left").withColumns({"lot_value": F.coalesce("lot_value", F.lit(0.0)), "n_needed": F.coalesce("n_needed", F.lit(0)),
                                                         "asking": F.coalesce("asking", F.lit(0.0))})
    return out.withColumns({"margin": F.col("lot_value") - F.col("asking"),
                            "undervalued": (F.col("asking") > 0) & (F.col("lot_value") > F.col("asking"))})


def deals(valued: DataFrame) -> DataFrame:
    """Lots worth posting: a needed entity, or more value than asked."""
    return valued.where((F.col("n_needed") > 0) | F.col("undervalued"))


def staging_candidates(classified: DataFrame, marks: DataFrame, resolution: DataFrame, floor: float = S.STAGE_AT) -> DataFrame:
    """Confirmed crops that may become references: a really detected mark, agreed by the second reader, not junk."""
    real = marks.where(~F.coalesce(F.col("mark_source").isin("gemini_led", "gemini_recovered"), F.lit(False))).select(*CROP)
    agreed = resolution.where("auto").select(*CROP)
    rows = classified.where((F.col("label") == "confirmed") & (F.col("overall") >= floor))
    return rows.join(real, CROP, "left_semi").join(agreed, CROP, "left_semi")


def promotion_manifest(staged: DataFrame, base_ms: int) -> DataFrame:
    """Copy plan: source, and destination under the entry with a distinct time per crop of a job."""
    rows = staged.where((F.col("source_name") != "") & (F.col("entry") != ""))
    return rows.withColumn("dest", F.concat(F.lit(S.STAGING_PREFIX), "entry", F.lit("/"), (F.lit(base_ms) + F.col("crop")).cast("string"), F.lit(".jpg")))


def confirm_rows(tops: DataFrame, board: DataFrame, allowed_years: list[int]) -> DataFrame:
    """One row per confirmed crop: source by threshold, rank of its year on the restricted and the full board."""
    sure = tops.where(nm.is_confirmed_guarded(F.col("overall"), F.col("gap"))).withColumnRenamed("year", "chosen_year")
    joined = sure.join(board.select(*CROP, "year", F.col("rank").alias("b_rank")), CROP)
    inside = F.col("year").isin(allowed_years)
    same = F.col("year") == F.col("chosen_year")
    ranks = joined.groupBy(*CROP, "chosen_year", "slogan", "overall").agg(
        F.min(F.when(same, F.col("b_rank"))).alias("rank_shadow"), F.count(F.lit(1)).alias("board_size"),
        F.max(F.when(inside, F.lit(1))).alias("_any"), F.array_sort(F.collect_set(F.when(inside, F.col("b_rank")))).alias("_in"),
        F.min(F.when(same & inside, F.col("b_rank"))).alias("_mine"))
    return ranks.select(F.concat_ws(":", "job", "crop").alias("check_id"), "job", "crop", "chosen_year", F.col("slogan").alias("chosen_phrase"),
                        F.when(F.col("overall") >= S.AUTO_AT, "auto_resolve").otherwise("green").alias("source"),
                        F.nullif(F.array_position("_in", F.col("_mine")).cast("int"), F.lit(0)).alias("rank_restricted"), "rank_shadow", "board_size")


def count_rows(counts: DataFrame) -> DataFrame:
    """The second reader's count as its own confirmation row. ``counts``: (job, total)."""
    return counts.select(F.concat(F.lit("gemini_count:"), "job").alias("check_id"), "job",
                         F.col("total").cast("string").alias("chosen_phrase"), F.lit("gemini_count").alias("source"))


def join_outcomes(matches: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Match rows with the confirmation they led to, by check id."""
    return matches.join(confirmations.select("check_id", "chosen_year", "chosen_phrase", "source"), "check_id", "left")


def run_summary(listings: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Listings alerted, confirmed but not needed, and rejected, by marketplace."""
    per_item = evaluated.where("lane = 'confirmed'").groupBy("job").agg(F.bool_or("needed_hit").alias("hit"))
    rows = listings.join(per_item, "job", "left").withColumn("market", F.when(F.col("listing_id").startswith("etsy_"), "b").otherwise("a"))
    return rows.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit")).alias("alerted"),
                                      F.count_if(~F.col("hit")).alias("confirmed_not_needed"), F.count_if(F.col("hit").isNull()).alias("rejected"))


def digest(records: DataFrame, threshold: float = S.NEEDED_AT, n: int = S.DIGEST_ROWS) -> DataFrame:
    """Preview: needed candidates by score, marked at the threshold, and how many more there are."""
    wanted = records.where("best_needed is not null").select("item_id", F.col("best_needed.year").alias("year"),
                                                            F.col("best_needed.slogan").alias("slogan"), F.col("best_needed.overall").alias("overall"),
                                                            tx.truncate_text(F.col("title"), 60).alias("title"))
    more = wanted.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"), F.lit(1).alias("_one"))
    head = top_n(wanted, [F.desc("overall"), F.asc("item_id")], n, "rank").withColumn("_one", F.lit(1))
    return head.join(more, "_one").drop("_one").withColumn("above", F.col("overall") >= threshold)


def alert_rows(deal_lots: DataFrame, confirmed: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per matched entity of each deal, next to the lot's header fields."""
    head = deal_lots.select("job", tx.truncate_text(F.col("title"), 80).alias("title"), "seller", "asking", "lot_value", "margin", "unmatched")
    lines = lookup_rule(confirmed, rules).select("job", "year", "slogan", "max_price_single", "amount_needed")
    return head.join(lines, "job", "left")


def report_lines(alerts: DataFrame) -> DataFrame:
    """Report text as one row per line: header, one line per entity, verdict. Sorting by (job, section, text) prints it."""
    need = F.when(F.col("amount_needed") > 0, F.concat(F.lit("  ⭐ need "), "amount_needed")).otherwise("")
    entity = F.concat(F.lit("  • "), "year", F.lit(" — \""), "slogan", F.lit("\"    max: "), "max_price_single", need)
    verdict = F.when(F.col("margin") > 0, F.concat(F.lit("✅ Good deal — *+"), nm.money(F.col("margin")), F.lit("* below calculated value"))) \
        .otherwise(F.concat(F.lit("⚠️ You'd overpay by *"), nm.money(F.abs("margin")), F.lit("*")))
    value = F.when(F.col("lot_value") > 0, F.concat(F.lit("Calculated value: *"), nm.money(F.col("lot_value")), F.lit("*  |  "), verdict)) \
        .otherwise("_Calculated value: $0.00 (no matched buttons have price rules)_")
    line = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("text"))
    header = F.concat(F.lit("Asking: *"), nm.money(F.col("asking")), F.lit("*"))
    lines = F.array(line(1, header), line(2, F.when(F.col("slogan").isNotNull(), entity)), line(3, value))
    # entities of a lot differ in year or slogan, so only the header and the verdict repeat
    return alerts.select("job", F.explode(lines).alias("l")).select("job", "l.*").where("text is not null").distinct()


def count_histogram(counts: DataFrame) -> DataFrame:
    """How many items have 0, 1, 2, 3, 4-12 or more marks, with shares. ``counts``: (job, n)."""
    bucket = F.when(F.col("n") <= 3, F.col("n").cast("string")).when(F.col("n") <= 12, "4-12").otherwise("13+")
    rows = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("items"))
    total = rows.agg(F.sum("items").alias("total"), F.lit(1).alias("_one"))
    return rows.withColumn("_one", F.lit(1)).join(total, "_one").select("bucket", "items", (F.col("items") / F.col("total")).alias("share"))


def phrase_background(board: DataFrame, min_n: int = 3) -> DataFrame:
    """Mean text score of a phrase where it was not the truth, from three sightings on."""
    wrong = board.where(~F.col("is_truth"))
    return wrong.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.avg("text_score").alias("background")).where(F.col("n") >= min_n)
