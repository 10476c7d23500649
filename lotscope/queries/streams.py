"""Streams run to the end of the given tables, compared with the batch result."""

from pyspark.sql import functions as F

from lotscope.operators import filters, history
from lotscope.plans.lineage import new_folder
from lotscope.queries.history import SHIPPED, shipped
from lotscope.queries.payloads import NAMES
from lotscope.queries.functions import CRC
from lotscope.queries.registry import query
from lotscope.queries.sql import on
from lotscope.sources import logs
from lotscope.streaming import sources as ss
from lotscope.streaming import state as stt

c = F.col
lit = F.lit


def events(t):
    return ss.table_stream(t.spark, t.folder, "events")


def instant(name="ts"):
    return c(name).cast("timestamp")


@query("x1_dedup_notifications", "select distinct 'lots__' || user_id as name, event_type as generation from events")
def x1(t):
    """Files in any order; repeats come days later, in other batches."""
    notes = split_files(t, 6).select(F.concat(lit("lots__"), c("user_id")).alias("name"), c("event_type").alias("generation"), instant().alias("ts"))
    path = new_folder(t.spark, "notifications")
    index = stt.notification_index(t.spark, new_folder(t.spark, "notification-index"))
    ss.each_batch(notes, stt.dedup_sink(index, path), new_folder(t.spark, "notification-state"))
    return t.spark.read.schema("name string, generation string").parquet(path).select("name", "generation")


@query("x2_response_stream", NAMES + """ select event_id, replace(name,'.response.json','') as image_name, case when event_type<>'click' then 'k' || user_id end as key from n where event_type<>'signup'""")
def x2(t):
    from lotscope.queries.payloads import push_bodies

    class Streamed:
        table = staticmethod(lambda name: events(t))
    return ss.drained(stt.response_stream(push_bodies(Streamed)).select("event_id", "image_name", "key"))


CTX = """ctx as (select event_id as key, user_id as item_id, ts as created from events where event_type='purchase'),
resp as (select event_id-1 as key, ts as answered from events where event_type='click')"""


def contexts(e):
    return e.where("event_type = 'purchase'").select(c("event_id").alias("key"), c("user_id").alias("item_id"), instant().alias("created"))


def answers(e):
    return e.where("event_type = 'click'").select((c("event_id") - 1).alias("key"), instant().alias("answered"))


@query("x3_correlate_stream", f"""with {CTX}, wm as (select least((select max(created) from ctx), (select max(answered) from resp)) - interval 1 hour as w)
select c.key, item_id, r.key is not null as is_answered from ctx c left join resp r on r.key=c.key and answered between created and created + interval 7 days, wm
where r.key is not null or created + interval 7 days < w""")
def x3(t):
    out = stt.correlate(answers(events(t)), contexts(events(t)))
    return ss.drained(out).select("key", "item_id", c("answered").isNotNull().alias("is_answered"))


@query("j10_correlate", f"with {CTX} select r.key, c.item_id, c.key is not null as has_context from resp r left join ctx c using (key)")
def j10(t):
    e = t.table("events")
    ctx = contexts(e).withColumn("found", lit(True))
    return stt.correlate_batch(answers(e), ctx).select("key", "item_id", F.coalesce("found", lit(False)).alias("has_context"))


@query("x4_seen_state", f"with {SHIPPED} select item_id, min(seen_date) as first_seen, max(seen_date) as last_seen, count(*) as times from shipped group by 1")
def x4(t):
    rows = split_files(t, 8, "lineitem", "l_partkey").select(c("l_orderkey").alias("item_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("seen_date"))
    seen = stt.seen_state(t.spark, new_folder(t.spark, "seen"))
    ss.each_batch(rows, stt.seen_sink(seen), new_folder(t.spark, "seen-state"))
    return seen.read()


@query("x5_reprocess_unanswered", on("v_role", body="""
select key, item_id from v_role where role='context' and key not in (select key-1 from v_role where role='answer')
  and item_id not in (select item_id from v_role where role='seen')"""))
def x5(t):
    of = lambda role: t.view("v_role").where(c("role") == role).withColumn("ts", instant())
    answered = of("answer").select((c("key") - 1).alias("key"), c("ts").alias("answered"))
    return stt.unanswered(of("context").withColumnRenamed("ts", "created"), answered, of("seen").select("item_id")).select("key", "item_id")


def split_files(t, n=8, table="events", key="event_id"):
    """A table as several files, the input of rate-limited streams."""
    path = new_folder(t.spark, f"{table}-in")
    t.table(table).repartition(n, key).write.parquet(path)
    return ss.folder_stream(t.spark, path, t.table(table).schema, 2)


@query("x6_append_stream", on("v_log_line", body="select event_id as seq, payload from v_log_line where payload like '>>> TITLE%'"))
def x6(t):
    kind = c("event_type")
    tail = F.concat(lit("] [seller"), c("user_id") % 13, lit("] lot of "), c("user_id") % 50)
    line = F.when(kind == "purchase", F.concat(lit(">>> TITLE: [needed "), c("value"), lit(" "), 1970 + c("user_id") % 40, lit(" Slogan "), c("user_id") % 9, tail)) \
        .when(kind == "view", F.concat(lit(">>> TITLE: [low-conf "), c("value"), tail)).when(kind == "click", F.concat(lit(">>> TITLE: [rejected "), c("value"), tail))
    rows = split_files(t).select(c("event_id").alias("seq"), line.alias("payload")).where("payload is not null")
    path = new_folder(t.spark, "appended")
    ss.each_batch(rows, stt.append_sink(path), new_folder(t.spark, "appended-state"))
    return t.spark.read.schema("seq bigint, payload string").json(path).select("seq", "payload")


@query("x7_drain", "select count(*) as n_rows, count(distinct event_id) as n_ids, 0 as remaining from events")
def x7(t):
    """Rate-limited batches until nothing remains."""
    out = ss.drained(split_files(t).select("event_id"))
    left = t.table("events").select("event_id").join(out, "event_id", "left_anti")
    return out.agg(F.count(lit(1)).alias("n_rows"), F.countDistinct("event_id").alias("n_ids"), lit(1).alias("k")).join(
        left.agg(F.count(lit(1)).alias("remaining"), lit(1).alias("k")), "k").drop("k")


@query("x8_sweep", f"with {CTX} select key from ctx where created >= timestamp '2024-01-31 00:00:00' - interval 7 days")
def x8(t):
    return stt.sweep(contexts(t.table("events")), lit("2024-01-31 00:00:00").cast("timestamp")).select("key")


@query("x9_daily_summary", "select strftime(ts,'%Y-%m-%d') as day, event_type as outcome, count(*) as n from events group by 1,2")
def x9(t):
    rows = split_files(t).select(c("ts"), c("event_type").alias("outcome"))
    path = new_folder(t.spark, "daily")
    ss.each_batch(stt.daily_summary(rows), stt.snapshot_sink(path), new_folder(t.spark, "daily-state"), mode="complete")
    return t.spark.read.parquet(path)


def ordered_files(t, rows_per_piece=1 << 22, files=4):
    """The events table as it arrives: pieces in the order of ids, at least four and of bounded size, each of so many
    files; a micro-batch reads one piece."""
    path = new_folder(t.spark, "events-ordered")
    rows = t.table("events")
    ends = rows.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count(lit(1)).alias("n")).first()
    pieces = max(4, -(-ends.n // rows_per_piece))
    width = (ends.hi - ends.lo) // pieces + 1
    for lo in range(ends.lo, ends.hi + 1, width):
        rows.where(c("event_id").between(lo, lo + width - 1)).repartition(files).write.mode("append").parquet(path)
    return ss.folder_stream(t.spark, path, rows.schema, files)


@query("x10_tripwire_stream", f"""with e as (select cast(xor({CRC.replace("{c}", "'k' || user_id")}, 4294967295) % 4 as int) as worker, event_id as seq,
  event_type in ('error','signup','click') as failed from events),
o as (select *, row_number() over w as rn, sum((not failed)::int) over w as island,
  sum(failed::int) over (partition by worker order by seq rows between 49 preceding and current row) as bad from e window w as (partition by worker order by seq)),
r as (select worker, island, count(*) filter (where failed) as run, max(rn) as upto from o group by 1, 2)
select o.worker, count(*) as n, cast(any_value((select run from r where r.worker=o.worker order by upto desc limit 1)) as bigint) as streak,
  cast(any_value((select max(run) from r where r.worker=o.worker)) as bigint) as max_streak,
  any_value((select max(run) from r where r.worker=o.worker)) >= 5 as halted, bool_or(rn >= 50 and bad/50 > 0.7) as tripped from o group by 1""")
def x10(t):
    rows = ordered_files(t).select(F.concat(lit("k"), "user_id").alias("name"), c("event_id").alias("seq"), c("event_type").isin("error", "signup", "click").alias("failed"))
    watch = stt.Watch(t.spark, new_folder(t.spark, "watch"), 4, limit=0.7)
    ss.each_batch(rows, watch.sink, new_folder(t.spark, "watch-state"))
    return watch.read()


FIRST = "select item_id from v_listing"


@query("x11_first_run_policy", on("v_match", "v_listing", body="select 'first' as run, item_id from v_listing union all select 'later', item_id from v_listing where item_id not in (select item_id from v_match where needed=0)"))
def x11(t):
    path = new_folder(t.spark, "control")
    t.spark.range(1).select(lit(False).alias("first_run_done")).write.parquet(path)
    listings, seen = t.view("v_listing").select("item_id"), t.view("v_match").where("needed = 0")
    control = lambda: t.spark.read.schema("first_run_done boolean").parquet(path)
    keep = new_folder(t.spark, "first-run")
    stt.first_run_policy(listings, seen, control()).select(lit("first").alias("run"), "item_id").write.parquet(keep)
    stt.mark_first_run_done(t.spark, path)
    later = stt.first_run_policy(listings, seen, control()).select(lit("later").alias("run"), "item_id")
    return t.spark.read.schema("run string, item_id bigint").parquet(keep).unionByName(later)
