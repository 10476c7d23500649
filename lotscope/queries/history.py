"""Logs, history, merges, seen filters and cursors."""

from pyspark.sql import functions as F

from lotscope.operators import filters, history
from lotscope.plans.lineage import new_folder
from lotscope.queries.market import scan_records
from lotscope.queries.registry import query
from lotscope.queries.sql import KEY, TEXT_KEY, TITLE_COUNT, TITLE_YEARS, expr, on, scan
from lotscope.sources import logs, sinks

c = F.col
MATCH_SEEN = "select distinct item_id from v_match where needed=0"


def seen(t):
    return t.view("v_match").where("needed = 0").select("item_id").distinct()


# --- sources and sinks -----------------------------------------------------------------------------------

def scan_log_files(t):
    """Scan records written as JSON lines and the folder they lie in."""
    path = new_folder(t.spark, "scan-log")
    r = scan_records(t).withColumn("item_id", c("item_id").cast("string")).drop("fmt", "ordered")
    sinks.append_scan_log(r, path)
    return path


S1_SQL = scan("""select cast(item_id as string) as item_id, asking, title_count, crops as crops_scored, round(best_score,6) as best_score,
  n_years, array_to_string(title_years,',') as title_years from v_scan""")


def log_summary(df):
    return df.select("item_id", "asking", "title_count", "crops_scored", F.round("best_score", 6).alias("best_score"),
                     F.size("year_counts").cast("bigint").alias("n_years"), F.array_join("title_years", ",").alias("title_years"))


@query("s1_read_scan_log", S1_SQL)
def s1(t):
    return log_summary(logs.read_scan_log(t.spark, scan_log_files(t)))


@query("s14_append_scan_log", scan("select count(*)*2 as n_rows, count(distinct item_id) as n_ids, round(sum(asking)*2,2) as asking from v_scan"))
def s14(t):
    path = scan_log_files(t)
    sinks.append_scan_log(logs.read_scan_log(t.spark, path), path)
    return logs.read_scan_log(t.spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("item_id").alias("n_ids"),
                                                 F.round(F.sum("asking"), 2).alias("asking"))


@query("s2_read_sources", on("v_listing", "v_log_line", body=f"""
select 'listing' as gen, cast(item_id as string) as item_id, title, asking from v_listing union all
select 'older', null, payload, null from v_log_line"""))
def s2(t):
    a, b = new_folder(t.spark, "gen-listing"), new_folder(t.spark, "gen-older")
    t.view("v_listing").select(c("item_id").cast("string"), "title", "asking").write.json(a)
    t.view("v_log_line").select(c("payload").alias("title")).write.json(b)
    gen = F.when(c("file").contains("gen-listing"), "listing").otherwise("older").alias("gen")
    return logs.read_sources(t.spark, [a, b]).select(gen, "item_id", "title", "asking")


LINE = "'^>>> TITLE: \\[needed ([\\d.]+) (\\d{4}) (.*?)\\] \\[([^\\]]*)\\] (.*)'"
OTHER = "'^>>> TITLE: \\[(low-conf|rejected) ([\\d.]+)\\] \\[([^\\]]*)\\] (.*)'"
PARSED = f""",
parsed as (select *, left(md5(seller || chr(0) || title),16) as h from (
  select event_id as seq, ts, case when n then 'needed' else regexp_extract(payload,{OTHER},1) end as kind,
    round(cast(case when n then regexp_extract(payload,{LINE},1) else regexp_extract(payload,{OTHER},2) end as double),4) as best_score,
    case when n then regexp_extract(payload,{LINE},2) end as year, case when n then regexp_extract(payload,{LINE},3) end as slogan,
    case when n then regexp_extract(payload,{LINE},4) else regexp_extract(payload,{OTHER},3) end as seller,
    case when n then regexp_extract(payload,{LINE},5) else regexp_extract(payload,{OTHER},4) end as title
  from (select *, regexp_matches(payload,{LINE}) as n from v_log_line) where n or regexp_matches(payload,{OTHER})))"""


def lines(t):
    return t.view("v_log_line").withColumnRenamed("event_id", "seq")


@query("s3_read_log_lines", on("v_log_line", body="select payload, count(*) as n from v_log_line group by 1"))
def s3(t):
    path = new_folder(t.spark, "lines")
    lines(t).select("payload").write.text(path)
    return logs.read_log_lines(t.spark, path).groupBy("payload").agg(F.count(F.lit(1)).alias("n"))


@query("s3_read_log_export", on("v_log_line", body="select ts, payload from v_log_line"))
def s3_json(t):
    path = new_folder(t.spark, "export")
    entry = F.struct(c("ts").alias("timestamp"), c("payload").alias("textPayload"))
    arrays = lines(t).groupBy(F.floor(c("seq") / 5000)).agg(F.to_json(F.collect_list(entry)).alias("v")).select("v")
    arrays.write.option("maxRecordsPerFile", 1).text(path)  # one array of at most 5,000 entries per file
    return logs.read_log_lines(t.spark, path, "json")


@query("s10_load_id_list", on("v_hist", body="select item_id from v_hist where item_id is not null"))
def s10(t):
    path = new_folder(t.spark, "ids")
    t.view("v_hist").select(F.to_json(F.array(F.coalesce("item_id", F.lit("")))).alias("v")).write.text(path)
    return logs.load_id_list(t.spark, path)


@query("a9_parse_title_lines", on("v_log_line", body=PARSED[0:0] + "") .rstrip() + PARSED
       + f" select seq, kind, best_score, year, slogan, seller, title, 'backfill|' || h as item_id, {expr(TITLE_COUNT, 'title')} as title_count from parsed")
def a9(t):
    return logs.parse_title_lines(lines(t), "import").select("seq", "kind", "best_score", "year", "slogan", "seller", "title", "item_id", "title_count")


@query("a8_dedup_best", on("v_log_line", body="").rstrip() + PARSED + """
select seq, kind, best_score, seller, title from (select *, row_number() over (partition by lower(seller), lower(title)
  order by case kind when 'needed' then 2 when 'low-conf' then 1 else 0 end desc, best_score desc, seq) as rn from parsed) where rn=1""")
def a8(t):
    return history.dedup_best(logs.parse_title_lines(lines(t), "import")).select("seq", "kind", "best_score", "seller", "title")


@query("p8_since", on("v_log_line", body="select event_id from (select event_id, case when event_id%10=0 then '' else ts end as ts from v_log_line) where ts='' or ts>='2024-01-15T'"))
def p8(t):
    blanked = t.view("v_log_line").withColumn("ts", F.when(c("event_id") % 10 == 0, "").otherwise(c("ts")))
    return filters.since(blanked, "2024-01-15T").select("event_id")


# --- master ----------------------------------------------------------------------------------------------

CANON = """
, first as (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match),
need as (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match where needed>0),
matched as (select item_id, list(distinct cast(year as string)) as ys from v_match group by 1)
select s.item_id, s.title, s.asking, s.asking>0 as has_price, s.title_count, s.crops as crops_scored,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(ys,[]), list_transform(title_years, lambda y: cast(y as string))))),';') as years,
  round(s.best_score,6) as best_score, cast(coalesce(n.year, f.year) as string) as best_year, coalesce(n.slogan, f.slogan) as best_slogan,
  n.item_id is not null as needed_hit
from v_scan s left join matched m using (item_id) left join (select * from first where rk=1) f on f.item_id=s.item_id
left join (select * from need where rk=1) n on n.item_id=s.item_id"""


@query("a7_canonicalize", scan(CANON))
def a7(t):
    out = history.canonicalize(scan_records(t))
    return out.select(c("item_id").cast("bigint").alias("item_id"), "title", "asking", "has_price", "title_count", "crops_scored",
                      F.array_join("years", ";").alias("years"), F.round("best_score", 6).alias("best_score"),
                      "best_year", "best_slogan", "needed_hit")


FOLD = f""",
marked as (select *, item_id is null or item_id like 'backfill|%' as synthetic,
  {expr(TEXT_KEY, 'seller')} || '|' || {expr(TEXT_KEY, 'title')} as st from v_hist),
reals as (select st, arg_min(item_id, seq) as rid from marked where not synthetic group by 1),
keyed as (select m.*, case when not synthetic then 'id:' || item_id when rid is not null then 'id:' || rid else 'st:' || m.st end as key
  from marked m left join reals using (st))"""


@query("j4_resolve_keys", on("v_hist", body="").rstrip() + FOLD + " select seq, key, synthetic from keyed")
def j4(t):
    return history.resolve_keys(t.view("v_hist")).select("seq", "key", "synthetic")


MASTER = FOLD + """,
master as (select k.*, a.times_seen, a.sources from (select *, row_number() over (partition by key order by coalesce(asking>0,false) desc,
    synthetic, buying_format<>'unknown' desc, observed_at desc, seq) as rn from keyed) k
  join (select key, count(*) as times_seen, string_agg(distinct source, ';' order by source) as sources from keyed group by 1) a using (key)
  where rn=1)"""


@query("a6_build_master", on("v_hist", body="").rstrip() + MASTER
       + " select key, item_id, observed_at, asking, coalesce(asking>0,false) as has_price, buying_format, times_seen, sources from master")
def a6(t):
    return history.build_master(t.view("v_hist")).select("key", "item_id", "observed_at", "asking", "has_price",
                                                         "buying_format", "times_seen", "sources")


@query("l3_order_master", on("v_hist", body="").rstrip() + MASTER + " select observed_at, item_id, title from master order by observed_at desc, item_id desc")
def l3(t):
    return history.order_master(history.build_master(t.view("v_hist"))).select("observed_at", "item_id", "title")


@query("s15_flat_master", on("v_hist", body="").rstrip() + MASTER + f"""
select observed_at, sources, times_seen, item_id, seller, title, asking, case when asking>0 then 'yes' else 'no' end as has_price,
 'USD' as currency, buying_format, '' as condition, cast(null as int) as bid_count, {expr(TITLE_COUNT, 'title')} as title_count,
 cast(null as int) as crops_scored, array_to_string({expr(TITLE_YEARS, 'title')},';') as years, best_score, '' as best_year,
 '' as best_slogan, 'no' as needed_hit, '' as listing_url from master""")
def s15(t):
    from lotscope.functions import text as tx
    m = history.build_master(t.view("v_hist")).withColumns({
        "currency": F.lit("USD"), "condition": F.lit(""), "bid_count": F.lit(None).cast("int"),
        "title_count": tx.extract_lot_count(c("title")), "crops_scored": F.lit(None).cast("int"),
        "years": tx.extract_years(c("title")), "best_year": F.lit(""), "best_slogan": F.lit(""),
        "needed_hit": F.lit(False), "listing_url": F.lit("")})
    path = new_folder(t.spark, "master-csv")
    flat = sinks.to_flat_master(m)
    flat.write.option("header", True).option("emptyValue", "").csv(path)
    back = t.spark.read.schema(flat.schema).option("header", True).csv(path)
    return back.fillna("", ["condition", "years", "best_year", "best_slogan", "listing_url"])


@query("j5_merge_new", on("v_hist", body="""
, base as (select * from v_hist where source in ('view','click')), adds as (select * from v_hist where source not in ('view','click'))
select seq, item_id from base union all
select seq, item_id from (select *, row_number() over (partition by item_id order by seq) as rn from adds
  where item_id is not null and item_id not in (select item_id from base where item_id is not null)) where rn=1
union all select seq, item_id from adds where item_id is null"""))
def j5(t):
    h = t.view("v_hist")
    base = c("source").isin("view", "click")
    return history.merge_new(h.where(base), h.where(~base)).select("seq", "item_id")


# --- the offline chain: lines and logs to one master sheet ---------------------------------------------------

LOGGED = """case when seq%13=0 then '' else item_id end as item_id"""
CHAIN = f"""{PARSED},
base as (select seq, {LOGGED}, seller, title, asking, buying_format, observed_at, source, best_score, cast(null as string) as year,
  cast(null as string) as slogan, false as needed_hit from v_hist),
best as (select * from (select *, row_number() over (partition by lower(seller), lower(title)
  order by case kind when 'needed' then 2 when 'low-conf' then 1 else 0 end desc, best_score desc, seq) as rn from parsed) where rn=1),
adds as (select 1000000000000+seq as seq, 'backfill|' || h as item_id, seller, title, cast(null as double) as asking, 'unknown' as buying_format,
  ts as observed_at, 'import' as source, best_score, year, slogan, kind='needed' as needed_hit from best),
merged as (select * from base union all
  select * exclude (rn) from (select *, row_number() over (partition by item_id order by seq) as rn from adds
    where item_id not in (select item_id from base where item_id<>'')) where rn=1),
canon as (select seq, coalesce(item_id,'') as item_id, coalesce(seller,'') as seller, coalesce(title,'') as title, asking, buying_format,
  observed_at, source, best_score, year, slogan, needed_hit, {expr(TITLE_COUNT, "coalesce(title,'')")} as title_count,
  array_to_string(list_sort(list_distinct(list_concat(case when year is null then [] else [year] end,
    list_transform({expr(TITLE_YEARS, "coalesce(title,'')")}, lambda y: cast(y as string))))),';') as years from merged),
marked as (select *, item_id='' or item_id like 'backfill|%' as synthetic,
  {expr(TEXT_KEY, 'seller')} || '|' || {expr(TEXT_KEY, 'title')} as st from canon),
reals as (select st, arg_min(item_id, seq) as rid from marked where not synthetic group by 1),
keyed as (select m.*, case when not synthetic then 'id:' || item_id when rid is not null then 'id:' || rid else 'st:' || m.st end as key
  from marked m left join reals using (st)),
master as (select k.*, a.times_seen, a.sources from (select *, row_number() over (partition by key order by coalesce(asking>0,false) desc,
    synthetic, buying_format<>'unknown' desc, observed_at desc, seq) as rn from keyed) k
  join (select key, count(*) as times_seen, string_agg(distinct source, ';' order by source) as sources from keyed group by 1) a using (key)
  where rn=1)"""


def merged_log(t):
    """A log with repeated, NULL and blank ids, written as JSON lines and read back, and what log lines add to it."""
    path = new_folder(t.spark, "chain-log")
    options = F.when(c("buying_format") == "auction", F.array(F.lit("AUCTION"))).when(c("buying_format") == "fixed", F.array(F.lit("FIXED_PRICE")))
    log = t.view("v_hist").select("seq", F.when(c("seq") % 13 == 0, "").otherwise(c("item_id")).alias("item_id"), "seller", "title", "asking",
                                  options.alias("buying_options"), c("observed_at").alias("ts"), "source", "best_score")
    sinks.append_scan_log(log, path)
    base = t.spark.read.schema("seq bigint, " + logs.SCAN_LOG).json(path)
    found = history.dedup_best(logs.parse_title_lines(lines(t), "import")).withColumn("seq", c("seq") + 10 ** 12)
    return history.merge_new(base, found.select(*base.columns))


@query("c1_import_to_master", on("v_hist", "v_log_line", body="").rstrip() + CHAIN + """
select observed_at, sources, times_seen, item_id, seller, title, asking, case when asking>0 then 'yes' else 'no' end as has_price,
 'USD' as currency, buying_format, '' as condition, cast(null as int) as bid_count, title_count,
 cast(case when needed_hit then 1 else 0 end as int) as crops_scored, years, best_score, year as best_year, slogan as best_slogan,
 case when needed_hit then 'yes' else 'no' end as needed_hit, '' as listing_url from master""")
def c1(t):
    return sinks.to_flat_master(history.build_master(history.canonicalize(merged_log(t))))


@query("c2_log_to_report", on("v_hist", "v_log_line", body="").rstrip() + CHAIN + " select year, count(*) as supply from canon where year is not null group by 1")
def c2(t):
    from lotscope.operators import market

    return market.supply_by_year(merged_log(t))


@query("a40_dup_audit", on("v_hist", body="select count(*) as n_rows, count(distinct item_id) as n_unique, round(1-count(distinct item_id)/count(*),6) as dup_share from v_hist where item_id is not null"))
def a40(t):
    return history.dup_audit(t.view("v_hist")).withColumn("dup_share", F.round("dup_share", 6))


# --- passes, cursors, seen -------------------------------------------------------------------------------

PASSES = """, passes as (select item_id, 1 as pass_no from v_listing where fmt='auction' union all
 select item_id, 2 from v_listing where condition='BUILDING' union all select item_id, 3 from v_listing where asking<100000
 union all select item_id, 4 from v_listing)"""


def passes(t):
    """Three narrow passes, then the general one, which finds every listing."""
    v = t.view("v_listing")
    return history.union_passes(*[v.where(w).select("item_id") for w in ("fmt='auction'", "condition='BUILDING'", "asking<100000", "true")])


@query("u1_union_passes", on("v_listing", body="").rstrip() + PASSES + " select * from passes")
def u1(t):
    return passes(t)


@query("a1_dedup_first", on("v_listing", body="").rstrip() + PASSES + " select item_id, min(pass_no) as pass_no from passes group by 1")
def a1(t):
    return filters.dedup_first(passes(t), [F.asc("pass_no")])


@query("a43_dedup_first_b", on("v_hist", body="select item_id, min(seq) as seq from v_hist where item_id is not null group by 1 union all select item_id, seq from v_hist where item_id is null"))
def a43(t):
    return filters.dedup_first(t.view("v_hist").select("item_id", "seq"), [F.asc("seq")])


@query("u5_split_passes", "select 'PSU ' || n_name as query, '64482' as category from nation where n_regionkey<2 union all select 'Penn State ' || n_name, null from nation where n_regionkey>=2")
def u5(t):
    prefix = F.when(c("n_regionkey") < 2, "PSU ").otherwise("Penn State ")
    return history.split_passes(t.table("nation").select(F.concat(prefix, "n_name").alias("query")), "PSU ", "64482")


@query("p5_unseen", on("v_match", "v_listing", body=f"select item_id from v_listing where item_id not in ({MATCH_SEEN})"))
def p5(t):
    return filters.unseen(t.view("v_listing"), seen(t)).select("item_id")


@query("j2_seen_anti_join", on("v_hist", body="select seq from v_hist h where not exists (select 1 from v_hist s where s.item_id=h.item_id and s.source='signup')"))
def j2(t):
    h = t.view("v_hist")
    return filters.unseen(h, h.where("source = 'signup'")).select("seq")


SHIPPED = "shipped as (select l_orderkey as item_id, cast(cast(l_shipdate as date) as string) as seen_date from lineitem)"


def shipped(t):
    return t.table("lineitem").select(c("l_orderkey").alias("item_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("seen_date"))


@query("p6_crawl_unseen", on("v_listing", body=f""", {SHIPPED}, marks as (select item_id, min(seen_date) as f, count(*) as n from shipped group by 1)
select item_id from v_listing left join marks using (item_id) where f is null or (f<'1996-06-21' and n<2)"""))
def p6(t):
    return filters.crawl_unseen(t.view("v_listing"), history.seen_marks(shipped(t)), "1996-06-21").select("item_id")


@query("p7_select_ids", on("v_match", "v_listing", body=f"select item_id from v_listing where item_id not in ({MATCH_SEEN}) order by ordered, item_id limit 50"))
def p7(t):
    ids = t.view("v_listing").select("item_id", c("ordered").alias("seq"))
    return filters.select_ids(ids, seen(t), cap=50).select("item_id")


@query("w16_chunk", on("v_match", "v_listing", body=f""", left_over as (select item_id from v_listing where item_id not in ({MATCH_SEEN}))
select item_id, row_number() over (order by item_id) as rn, (select greatest(count(*)-100,0) from left_over) as remaining
from left_over order by item_id limit 100"""))
def w16(t):
    return history.chunk(filters.unseen(t.view("v_listing"), seen(t)).select("item_id"), 100)


@query("l4_cap_run", on("v_listing", body="select item_id from v_listing order by ordered desc, item_id limit 500"))
def l4(t):
    return history.cap_run(t.view("v_listing"), [F.desc("ordered"), F.asc("item_id")], 500).select("item_id")


@query("s19_seen_store", f"with {SHIPPED} select item_id, min(seen_date) as first_seen, max(seen_date) as last_seen, count(*) as times from shipped group by 1")
def s19(t):
    path = new_folder(t.spark, "seen")
    history.write_seen(shipped(t), path)
    return history.seen_marks(history.read_seen(t.spark, path))


@query("p1_exclude_sellers", on("v_listing", body="select item_id from v_listing where lower(seller) not in (select lower(replace(s_name,'Supplier','Customer')) from supplier)"))
def p1(t):
    excluded = t.table("supplier").select(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("seller"))
    return filters.exclude_sellers(t.view("v_listing"), excluded).select("item_id")


GATED = """select item_id, k1, k2, k3, k4 from v_match join (
  select item_id, bool_or((k4=1 and overall>=0.45) or item_id%3=0) as go from v_match group by 1) using (item_id) where k4=1 or (k4<=4 and go)"""


@query("p11_gate_photos", on("v_match", body=GATED))
def p11(t):
    photos = t.view("v_match").withColumns({"photo_idx": c("k4") - 1, "score": c("overall"), "title_has_year": c("item_id") % 3 == 0})
    return filters.gate_photos(photos).select("item_id", "k1", "k2", "k3", "k4")


@query("w15_cap_running", on("v_match", body="""
select item_id, k1, k2, k3, k4, cast(least(crops, greatest(0, 60-(through-crops))) as bigint) as taken from (
  select *, cast(round(overall*50) as bigint) as crops, sum(cast(round(overall*50) as bigint)) over (partition by item_id order by k4,k1,k2,k3
    rows unbounded preceding) as through from v_match)"""))
def w15(t):
    photos = t.view("v_match").withColumn("crops", F.round(c("overall") * 50).cast("bigint"))
    out = filters.cap_running(photos, [F.asc(k) for k in ("k4", "k1", "k2", "k3")], c("k4"), F.lit(60))
    return out.select("item_id", "k1", "k2", "k3", "k4", c("taken").cast("bigint").alias("taken"))
