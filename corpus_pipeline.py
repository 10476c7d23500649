"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns documents with their columns; the last one returns token counts and
digests. Stages keep the rows that pass and change only what they are for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.llm import bpe, decontaminate, line_dedup, minhash, queries, toxicity
from lotscope.plans.lineage import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    labels = queries.table(spark, sf_dir, "labels")
    links = toxicity.fit_chain(docs, labels, queries.TOXIC_CHAIN, new_folder(spark, "toxicity"))
    return toxicity.score(docs, links).filter("not toxic").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in earlier ones; those of which nothing is left go. ``n_chars`` follows."""
    out = line_dedup.dedup_lines(docs).filter("not lost_all")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    later = minhash.near_duplicates(docs).filter("not first").select("node").distinct()
    return docs.withColumn("node", F.xxhash64(F.col("doc_id").cast("bigint"), "text")).join(later, "node", "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.overlaps(docs, queries.table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("overlaps") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digest(docs.select("doc_id", "text"), queries.default_vocabulary()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("bpe", encode),
]
#: SQL can state neither the trained chain nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
