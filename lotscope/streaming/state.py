"""Stateful streams: notification dedup, context correlation, seen state, appends, summaries, tripwires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions.text import shard_of
from lotscope.plans import runs
from lotscope.plans.files import complete_folders
from lotscope.sources.notifications import decode_notifications, route_objects
from lotscope.streaming.store import MergedState, run_of


def dedup_notifications(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """First notification of each object generation among those that come within ``delay`` of each other. Keys are
    forgotten after the delay, so state stays bounded; :func:`dedup_sink` forgets none."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["name", "generation"])


def notification_index(spark: SparkSession, path: str) -> MergedState:
    """Keys of all notifications that were let through, with the first time of each."""
    return MergedState(spark, path, {"name": "string", "generation": "string"}, {"ts": ("min", "timestamp")})


def dedup_sink(index: MergedState, path: str):
    """Batch writer that appends the notifications (name, generation, ts) whose key no earlier batch brought: one a key.

    The index is first reduced to the keys of the batch, by a join whose small side is the batch; only what is left
    meets the batch. Rows are written before the index learns their keys, so a batch that stopped between is repeated
    whole, and one that ended is left alone.
    """
    def write(rows: DataFrame, batch: int) -> None:
        run = run_of(rows)
        if index.has(run, batch):
            return
        keys = list(index.keys)
        first = rows.groupBy(*keys).agg(F.min("ts").alias("ts"))
        known = index.read().select(*keys).join(first.select(*keys), keys, "left_semi")
        fresh = first.join(known, keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch}")
        index.merge(index.spark.read.schema(index.schema).parquet(f"{path}/run={run}/batch={batch}"), batch, run)
    return write


def response_stream(stream: DataFrame, body: str = "body") -> DataFrame:
    """Decoded notifications of response objects, with correlation keys."""
    return route_objects(decode_notifications(stream, body))


def correlate(responses: DataFrame, contexts: DataFrame, days: int = S.PENDING_DAYS, delay: str = "1 hour") -> DataFrame:
    """Pending contexts with the response that came within ``days``. A context without one is emitted, response
    columns NULL, when the watermark passes its deadline; until then it stays pending in state."""
    left = contexts.withWatermark("created", delay)
    right = responses.withColumnRenamed("key", "r_key").withWatermark("answered", delay)
    bound = (F.col("key") == F.col("r_key")) & (F.col("answered") >= F.col("created")) \
        & (F.col("answered") <= F.col("created") + F.expr(f"interval {days} days"))
    return left.join(right, bound, "left_outer").drop("r_key")


def correlate_batch(responses: DataFrame, contexts: DataFrame) -> DataFrame:
    """Responses with the context of their key, for one batch; a lost context leaves its columns NULL."""
    return responses.join(contexts, "key", "left")


def seen_state(spark: SparkSession, path: str) -> MergedState:
    """First and last date and number of the sightings of every item."""
    return MergedState(spark, path, {"item_id": "bigint"}, {"first_seen": ("min", "string"), "last_seen": ("max", "string"), "times": ("sum", "bigint")})


def seen_sink(state: MergedState):
    """Batch writer that merges sightings (item_id, seen_date) into the seen state."""
    def write(rows: DataFrame, batch: int) -> None:
        date = F.col("seen_date")
        state.merge(rows.select("item_id", date.alias("first_seen"), date.alias("last_seen"), F.lit(1).cast("long").alias("times")), batch, run_of(rows))
    return write


def append_sink(path: str):
    """Batch writer for append-only logs, exactly once by run and batch."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{path}/run={run_of(rows)}/batch={batch}")
    return write


def snapshot_sink(path: str):
    """Batch writer for complete results: the latest batch replaces the table."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)
    return write


def sweep(df: DataFrame, now, days: int = S.PENDING_DAYS, created: str = "created") -> DataFrame:
    """Contexts young enough to keep."""
    return df.where(F.col(created) >= now - F.expr(f"interval {days} days"))


def unanswered(contexts: DataFrame, responses: DataFrame, seen: DataFrame) -> DataFrame:
    """Lots to feed again: no response came and the item was never confirmed."""
    open_ = contexts.join(responses.select("key").distinct(), "key", "left_anti")
    return open_.join(seen.select("item_id").distinct(), "item_id", "left_anti")


def daily_summary(stream: DataFrame) -> DataFrame:
    """Counts per day and outcome over tumbling windows."""
    day = F.window("ts", "1 day")
    return stream.groupBy(day.alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "outcome", "n")


def first_run_policy(listings: DataFrame, seen: DataFrame, control: DataFrame) -> DataFrame:
    """All listings on the first run, only unseen ones afterwards. ``control`` is one row: first_run_done."""
    known = seen.select("item_id").distinct().withColumn("_seen", F.lit(True))
    flagged = listings.withColumn("_one", F.lit(1)).join(control.select("first_run_done", F.lit(1).alias("_one")), "_one")
    return flagged.join(known, "item_id", "left").where(~F.col("first_run_done") | F.col("_seen").isNull()).drop("_one", "_seen", "first_run_done")


def mark_first_run_done(spark: SparkSession, path: str) -> None:
    spark.range(1).select(F.lit(True).alias("first_run_done")).write.mode("overwrite").parquet(path)


WATCH_STATE = f"worker int, {runs.SCHEMA}"


class Watch:
    """Failure streak and rolling failure share per worker, kept up to date batch by batch.

    Rows (name, seq, failed) go to workers by a hash of the name, as the readers themselves are sharded. A batch becomes
    one mergeable summary per worker, in blocks on all tasks; it is merged with the one row that the worker has. Every
    batch writes all workers' rows as its own version, from the version before it, so a replayed batch changes nothing.
    Batches must come in the order of ``seq``; within one, any order will do.
    """

    def __init__(self, spark: SparkSession, path: str, workers: int, width: int = 50, limit: float = 0.02, halt_at: int = 5):
        self.spark, self.path, self.workers, self.width, self.limit, self.halt_at = spark, path, workers, width, limit, halt_at

    def _version(self, before: str | None = None) -> str | None:
        done = [v for v in complete_folders(self.spark, self.path) if before is None or v < before]
        return done[-1] if done else None

    def sink(self, rows: DataFrame, batch: int) -> None:
        """Merge a micro-batch (the writer of ``each_batch``). A new run, after a lost checkpoint, goes on from the state."""
        run = run_of(rows)
        mine = [v for v in complete_folders(self.spark, self.path) if v.split(".")[1] == run]
        epoch = mine[-1].split(".")[0] if mine else f"{int((self._version() or '0').split('.')[0]) + 1:06d}"
        name = f"{epoch}.{run}.{batch:012d}"
        sharded = rows.select(shard_of(F.col("name"), self.workers).alias("worker"), "seq", F.coalesce("failed", F.lit(False)).alias("failed"))
        new = runs.summaries(sharded, ["worker"], "seq", F.col("failed"), self.width, self.limit).withColumn("_at", F.lit(1).cast("long"))
        before = self._version(name)
        if before is not None:
            old = self.spark.read.schema(WATCH_STATE).parquet(f"{self.path}/{before}").withColumn("_at", F.lit(0).cast("long"))
            new = runs.combine(old.unionByName(new), ["worker"], self.width, self.limit)
        new.drop("_at").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """(worker, n, streak, max_streak, halted, tripped) after the last batch."""
        version = self._version()
        rows = self.spark.read.schema(WATCH_STATE).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], WATCH_STATE)
        return rows.select("worker", "n", F.col("trail").alias("streak"), F.col("longest").alias("max_streak"), (F.col("longest") >= self.halt_at).alias("halted"), "tripped")
