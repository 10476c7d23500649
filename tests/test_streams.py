"""State that micro-batches are merged into: replays, lost checkpoints, batch splits, orders."""
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotscope.plans import runs
from lotscope.plans.lineage import new_folder
from lotscope.streaming import sources as ss
from lotscope.streaming import state as stt
from lotscope.streaming.store import MergedState


def brute_runs(failed, width, limit):
    streak = longest = 0
    for f in failed:
        streak = streak + 1 if f else 0
        longest = max(longest, streak)
    tripped = any(sum(failed[i:i + width]) / width > limit for i in range(len(failed) - width + 1))
    return len(failed), streak, longest, tripped


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=25), min_size=1, max_size=8), st.integers(1, 12), st.randoms())
def test_summaries_merge_in_any_grouping(blocks, width, rnd):
    text = lambda b: "".join("01"[x] for x in b)
    parts = [runs.summarise(text(b), width, 0.4) for b in blocks]
    while len(parts) > 1:
        i = rnd.randrange(len(parts) - 1)
        parts[i:i + 2] = [runs.merge(parts[i], parts[i + 1], width, 0.4)]
    whole = [x for b in blocks for x in b]
    assert parts[0] == runs.summarise(text(whole), width, 0.4)
    assert (parts[0].n, parts[0].trail, parts[0].longest, parts[0].tripped) == brute_runs(whole, width, 0.4)


def test_summaries_of_a_table(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random() < (0.9 if 200 < i < 260 else 0.2)) for i in range(-50, 900) for k in ("a", "b") if k == "a" or i % 7 == 0]
    df = spark.createDataFrame(rows, "k string, seq bigint, failed boolean").repartition(5)
    got = {r.k: (r.n, r.trail, r.longest, r.tripped) for r in runs.summaries(df, ["k"], "seq", F.col("failed"), 10, 0.8, block=16, span=3).collect()}
    assert got == {k: brute_runs([f for g, _, f in rows if g == k], 10, 0.8) for k in "ab"}
    assert runs.summaries(df.limit(0), ["k"], "seq", F.col("failed"), 10, 0.8).count() == 0


def watch_rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("n"), F.col("id") % 9).alias("name"), F.col("id").alias("seq"), (F.xxhash64("id") % 3 == 0).alias("failed"))


def test_watch_over_batches_replays_and_lost_checkpoints(spark, monkeypatch):
    def state(w):
        return {r.worker: tuple(r) for r in w.read().collect()}

    run = {"id": "first"}
    monkeypatch.setattr(stt, "run_of", lambda rows: run["id"])
    one, many = (stt.Watch(spark, new_folder(spark, "w"), 3, limit=0.5, width=20) for _ in range(2))
    assert many.read().count() == 0
    one.sink(watch_rows(spark, 0, 900), 0)
    for batch, (lo, hi) in enumerate([(0, 10), (10, 400), (400, 401), (401, 600)]):
        many.sink(watch_rows(spark, lo, hi), batch)
    before = state(many)
    many.sink(watch_rows(spark, 401, 600), 3)
    assert state(many) == before
    run["id"] = "after-a-lost-checkpoint"
    many.sink(watch_rows(spark, 600, 900), 0)
    assert state(many) == state(one)
    many.sink(watch_rows(spark, 600, 900), 0)
    assert state(many) == state(one)


@pytest.mark.parametrize("every", [1, 3, 100])
def test_merged_state(spark, every):
    rnd = random.Random(every)
    batches = [[(rnd.randrange(30), f"2024-01-{rnd.randrange(10, 29)}") for _ in range(40)] for _ in range(7)]
    want = {}
    for k, d in (r for b in batches for r in b):
        first, last, n = want.get(k, (d, d, 0))
        want[k] = (min(first, d), max(last, d), n + 1)
    path = new_folder(spark, "state")
    keep = MergedState(spark, path, {"item_id": "bigint"}, {"first_seen": ("min", "string"), "last_seen": ("max", "string"), "times": ("sum", "bigint")}, 4, every)
    assert keep.read().count() == 0
    for i, b in enumerate(batches):
        rows = spark.createDataFrame(b, "item_id bigint, d string").selectExpr("item_id", "d as first_seen", "d as last_seen", "1L as times")
        keep.merge(rows, i, "r")
        if i in (2, 4):
            keep.merge(rows, i, "r")  # a replay, before or after its delta was folded
    got = lambda: {r.item_id: (r.first_seen, r.last_seen, r.times) for r in keep.read().collect()}
    assert got() == want and keep.has("r", 6) and not keep.has("r", 7) and not keep.has("other", 0)
    keep.compact()
    assert got() == want
    assert "Aggregate" not in keep.read()._jdf.queryExecution().executedPlan().toString()  # one version, read as it is
    keep.merge(rows, 6, "r")
    assert got() == want
    keep.merge(rows, 0, "after-a-lost-checkpoint")
    assert sum(v[2] for v in got().values()) == sum(v[2] for v in want.values()) + len(batches[-1])


def test_notifications_over_eighty_days(spark):
    """Repeats that come long after the first, in files of any order: the answer is that of ``distinct``."""
    rnd = random.Random(5)
    rows = [(f"lots__{rnd.randrange(40)}", str(rnd.randrange(3)), 86400 * day + rnd.randrange(86400)) for day in range(80) for _ in range(12)]
    schema = "name string, generation string, at bigint"
    for files, order in ((6, "at"), (1, "at"), (6, None)):
        path, folder = new_folder(spark, "in"), new_folder(spark, "out")
        df = spark.createDataFrame(rows, schema)
        (df.repartitionByRange(files, order) if order else df.repartition(files)).write.parquet(path)
        stream = ss.folder_stream(spark, path, schema, 1).select("name", "generation", F.timestamp_seconds("at").alias("ts"))
        index, state = stt.notification_index(spark, new_folder(spark, "index")), new_folder(spark, "cp")
        ss.each_batch(stream, stt.dedup_sink(index, folder), state)
        got = [(r.name, r.generation) for r in spark.read.schema(index.schema).parquet(folder).collect()]
        assert sorted(got) == sorted({r[:2] for r in rows})
        assert sorted((r.name, r.generation) for r in index.read().collect()) == sorted(got)
        # the same rows again, as new files: nothing new
        df.write.mode("append").parquet(path)
        ss.each_batch(stream, stt.dedup_sink(index, folder), state)
        assert spark.read.schema(index.schema).parquet(folder).count() == len(got)


def test_runs_are_told_apart_by_their_checkpoint(spark):
    path, folder = new_folder(spark, "in"), new_folder(spark, "log")
    spark.range(5).write.parquet(path)
    stream = ss.folder_stream(spark, path, "id bigint", 10)
    for _ in range(2):  # two checkpoints: a new run does not overwrite what the first one wrote
        ss.each_batch(stream, stt.append_sink(folder), new_folder(spark, "cp"))
    assert spark.read.json(folder).count() == 10
