"""Scan logs, log exports and id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import text as tx
from lotscope.sources.arrays import read_json_array

SCAN_LOG = (
    "ts string, item_id string, title string, listing_url string, seller string, asking double, currency string, "
    "buying_options array<string>, condition string, bid_count int, photos_scored int, crops_scored int, "
    "title_count int, title_years array<int>, year_counts map<string,int>, best_score double, "
    "top_matches array<struct<year:string,slogan:string,overall:double>>, "
    "best_needed struct<year:string,slogan:string,overall:double>, needed_hit boolean, alerted boolean, source string")

# --- fixed values: the two recoverable line formats ---------------------------------------------------------
NEEDED_LINE = r"^>>> TITLE: \[needed ([\d.]+) (\d{4}) (.*?)\] \[([^\]]*)\] (.*)"
OTHER_LINE = r"^>>> TITLE: \[(low-conf|rejected) ([\d.]+)\] \[([^\]]*)\] (.*)"
KIND_RANK = {"needed": 2, "low-conf": 1, "rejected": 0}


def read_scan_log(spark: SparkSession, paths) -> DataFrame:
    """JSON-lines logs of any schema generation; missing fields are NULL, blank lines vanish."""
    return spark.read.schema(SCAN_LOG).json(paths)


def read_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several logs as one table, with the file each record came from."""
    parts = [read_scan_log(spark, p).withColumn("file", F.input_file_name()) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_log_lines(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """(ts, payload) from a text log, or from an export that is a JSON array of entries per file, read in byte ranges."""
    if fmt == "text":
        return spark.read.text(path).select(F.lit("").alias("ts"), F.col("value").alias("payload"))
    entries = read_json_array(spark, path, "timestamp string, textPayload string")
    return entries.select(F.coalesce("timestamp", F.lit("")).alias("ts"), F.coalesce("textPayload", F.lit("")).alias("payload"))


def load_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of JSON-array files, empty ids dropped."""
    lists = spark.read.text(path, wholetext=False).select(F.from_json("value", "array<string>").alias("ids"))
    return lists.select(F.explode("ids").alias("item_id")).where("item_id <> ''")


def parse_title_lines(lines: DataFrame, source: str) -> DataFrame:
    """Scan-log records recovered from log lines: needed, low-conf and rejected titles; other lines vanish.

    Adds ``kind``, and ``year`` and ``slogan`` of needed ones. Fields that lines do not tell are NULL or empty; other
    columns of ``lines`` stay.
    """
    payload = F.col("payload")
    needed, other = payload.rlike(NEEDED_LINE), payload.rlike(OTHER_LINE)
    pick = lambda i, j: F.when(needed, F.regexp_extract(payload, NEEDED_LINE, i)).otherwise(
        F.regexp_extract(payload, OTHER_LINE, j))
    stamped = lines if "ts" in lines.columns else lines.withColumn("ts", F.lit(""))
    rows = stamped.where(needed | other).select(
        "*", F.when(needed, "needed").otherwise(F.regexp_extract(payload, OTHER_LINE, 1)).alias("kind"),
        F.round(pick(1, 2).try_cast("double"), 4).alias("best_score"),
        F.when(needed, F.regexp_extract(payload, NEEDED_LINE, 2)).alias("year"),
        F.when(needed, F.regexp_extract(payload, NEEDED_LINE, 3)).alias("slogan"),
        pick(4, 3).alias("seller"), pick(5, 4).alias("title"))
    hit = F.col("kind") == "needed"
    match = F.struct("year", "slogan", F.col("best_score").alias("overall"))
    matches = "array<struct<year:string,slogan:string,overall:double>>"
    null = lambda kind: F.lit(None).cast(kind)
    return rows.withColumns({
        "item_id": tx.synth_id(F.col("seller"), F.col("title")), "title_count": tx.extract_lot_count(F.col("title")),
        "title_years": tx.extract_years(F.col("title")), "source": F.lit(source), "listing_url": F.lit(""),
        "asking": null("double"), "currency": F.lit(S.DEFAULT_CURRENCY), "buying_options": F.array().cast("array<string>"),
        "condition": F.lit(""), "bid_count": null("int"), "photos_scored": null("int"), "crops_scored": null("int"),
        "year_counts": F.when(hit, F.create_map("year", F.lit(1))).otherwise(F.create_map().cast("map<string,int>")),
        "top_matches": F.when(hit, F.array(match)).otherwise(F.array().cast(matches)),
        "best_needed": F.when(hit, match), "needed_hit": hit, "alerted": hit})
