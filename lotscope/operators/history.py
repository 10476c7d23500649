"""Listing history: canonical rows, folding of stand-in ids, one master row per listing, merges and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotscope import settings as S
from lotscope.functions import numbers as nm
from lotscope.functions import text as tx
from lotscope.operators.records import MATCHES, composition
from lotscope.plans.ranked import first_by, top_n
from lotscope.sources.logs import KIND_RANK, SCAN_LOG


def with_log_columns(records: DataFrame) -> DataFrame:
    """Records of any schema generation with every field of the scan log; fields they lack are NULL."""
    have = set(records.columns)
    schema = T._parse_datatype_string(SCAN_LOG)
    return records.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in have})


def canonicalize(records: DataFrame) -> DataFrame:
    """Any-schema records in the master shape: best match, union of title and matched years, price flag.

    Every record gives one row, whatever its id: facts are taken from the record itself. ``seq`` is the record's own
    number, or a hash of its fields where it has none; it settles ties.
    """
    seq = F.col("seq") if "seq" in records.columns else F.xxhash64(*[F.to_json(F.struct(*[c for c in records.columns]))])
    known_format = "buying_format" in records.columns
    records = with_log_columns(records.withColumn("seq", seq))
    best = F.array_max(F.transform("top_matches", lambda m: F.struct(m["overall"].alias("o"), m["year"].alias("y"), m["slogan"].alias("s"))))
    first_best = F.get(F.filter("top_matches", lambda m: m["overall"] == best["o"]), F.lit(0))
    pick = F.coalesce(F.col("best_needed"), first_best)
    title_years = F.transform(F.coalesce("title_years", tx.extract_years(F.col("title"))), lambda y: y.cast("string"))
    text = lambda name, default="": F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default)).alias(name)
    buying = nm.buying_format(F.col("buying_options"))
    return records.select(
        "seq", text("ts").alias("observed_at"), text("item_id"), text("seller"), text("title"), "asking",
        F.coalesce(F.col("asking") > 0, F.lit(False)).alias("has_price"), text("currency", S.DEFAULT_CURRENCY),
        (F.when(F.col("buying_options").isNull(), F.coalesce("buying_format", buying)).otherwise(buying) if known_format else buying)
        .alias("buying_format"), text("condition"), "bid_count",
        F.coalesce("title_count", tx.extract_lot_count(F.col("title"))).alias("title_count"),
        F.coalesce("crops_scored", F.size(F.coalesce("top_matches", F.array().cast(MATCHES)))).alias("crops_scored"),
        F.array_sort(F.array_union(F.map_keys(composition()), title_years)).alias("years"), "best_score",
        pick["year"].alias("best_year"), pick["slogan"].alias("best_slogan"),
        F.coalesce("needed_hit", F.lit(False)).alias("needed_hit"), text("listing_url"), text("source", S.DEFAULT_SOURCE))


def resolve_keys(records: DataFrame) -> DataFrame:
    """Give every record its listing key: real ids keep theirs, stand-ins take the first real id with the same
    seller and title, the rest share a key per seller and title."""
    part = lambda name: F.coalesce(tx.normalize_text(F.col(name)), F.lit(""))
    st = F.concat(part("seller"), F.lit("|"), part("title"))
    synthetic = tx.is_synthetic(F.col("item_id"))
    marked = records.withColumn("_st", st).withColumn("_synthetic", synthetic)
    real = first_by(marked.where(~F.col("_synthetic")).select("_st", "seq", F.col("item_id").alias("_real")), ["_st"], [F.asc("seq")])
    joined = marked.where("_synthetic").join(real.select("_st", "_real"), "_st", "left") \
        .withColumn("key", F.coalesce(F.concat(F.lit("id:"), "_real"), F.concat(F.lit("st:"), "_st")))
    kept = marked.where(~F.col("_synthetic")).withColumn("_real", F.lit(None).cast("string")) \
        .withColumn("key", F.concat(F.lit("id:"), "item_id"))
    return kept.unionByName(joined).drop("_st", "_real").withColumnRenamed("_synthetic", "synthetic")


def build_master(records: DataFrame) -> DataFrame:
    """One row per listing: the richest observation (priced, real, known format, newest; first on ties), the set
    of sources, and how often it was seen."""
    keyed = resolve_keys(records).withColumn("has_price", F.coalesce(F.col("asking") > 0, F.lit(False)))
    richest = first_by(keyed, ["key"], [F.desc("has_price"), F.asc("synthetic"),
                                        F.desc(F.col("buying_format") != "unknown"), F.desc("observed_at"), F.asc("seq")])
    per_source = keyed.groupBy("key", "source").agg(F.count(F.lit(1)).alias("c"))
    totals = per_source.groupBy("key").agg(F.sum("c").alias("times_seen"),
                                           F.array_join(F.array_sort(F.collect_list("source")), ";").alias("sources"))
    return richest.drop("source").join(totals, "key").drop("synthetic")


def order_master(master: DataFrame) -> DataFrame:
    return master.orderBy(F.desc("observed_at"), F.desc("item_id"))


def merge_new(base: DataFrame, adds: DataFrame) -> DataFrame:
    """Base kept whole; of the additions only ids the base lacks, once each; rows without an id (NULL or blank) always."""
    key = F.nullif(F.col("item_id").cast("string"), F.lit(""))
    known = base.select(key.alias("_id")).where("_id is not null").distinct()
    fresh = adds.withColumn("_id", key).join(known, "_id", "left_anti")
    once = first_by(fresh.where("_id is not null"), ["_id"], [F.asc("seq")])
    return base.unionByName(once.unionByName(fresh.where("_id is null")).drop("_id"))


def dedup_best(recovered: DataFrame) -> DataFrame:
    """Best recovered record per seller and title: kind, then score, then input order."""
    rank = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), KIND_RANK.items(), F.when(F.lit(False), -1))
    keyed = recovered.withColumns({"_s": F.lower("seller"), "_t": F.lower("title"), "_k": rank})
    return first_by(keyed, ["_s", "_t"], [F.desc("_k"), F.desc("best_score"), F.asc("seq")]).drop("_s", "_t", "_k")


def dup_audit(df: DataFrame) -> DataFrame:
    """Rows, unique ids, and the share that repeats an id. One row per id leaves the first shuffle."""
    per_id = df.where("item_id is not null").groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    return per_id.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_unique")).withColumn(
        "dup_share", 1 - F.col("n_unique") / F.col("n_rows"))


def chunk(unseen: DataFrame, n: int) -> DataFrame:
    """The next ``n`` unseen items and how many remain afterwards."""
    left = unseen.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("remaining"), F.lit(1).alias("_one"))
    head = top_n(unseen, [F.asc("item_id")], n, "rn").withColumn("_one", F.lit(1))
    return head.join(left, "_one").drop("_one")


def cap_run(df: DataFrame, order, n: int) -> DataFrame:
    """First ``n`` lots of a run, 1 to 1000."""
    if not 1 <= n <= S.RUN_CAP_MAX:
        raise ValueError(f"n must be 1..{S.RUN_CAP_MAX}")
    return df.orderBy(*order).limit(n)


def union_passes(*passes: DataFrame) -> DataFrame:
    """Bag union of search passes, numbered in the order they ran."""
    tagged = [p.withColumn("pass_no", F.lit(i)) for i, p in enumerate(passes, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def split_passes(queries: DataFrame, prefix: str, category: str) -> DataFrame:
    """Queries with the ambiguous prefix run inside a category, the others unrestricted."""
    restricted = F.col("query").startswith(prefix)
    free = queries.where(~restricted).withColumn("category", F.lit(None).cast("string"))
    return free.unionByName(queries.where(restricted).withColumn("category", F.lit(category)))


def seen_marks(history: DataFrame) -> DataFrame:
    """Seen state per item: first date and number of marks, folded map-side."""
    return history.groupBy("item_id").agg(F.min("seen_date").alias("first_seen"), F.max("seen_date").alias("last_seen"),
                                          F.count(F.lit(1)).alias("times"))


def write_seen(marks: DataFrame, path: str) -> None:
    """Seen history as one row per mark, so no item's list ever has to be held in one place."""
    marks.select("item_id", "seen_date").write.mode("overwrite").parquet(path)


def read_seen(spark, path: str) -> DataFrame:
    return spark.read.schema("item_id bigint, seen_date string").parquet(path)
