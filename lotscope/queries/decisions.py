"""Two-reader resolution, confirmation, valuation, deals and report tables."""

from pyspark.sql import functions as F

from lotscope.functions import numbers as nm
from lotscope.operators import decide, rules
from lotscope.plans.lineage import cut_lineage
from lotscope.queries.market import scan_records
from lotscope.queries.registry import query
from lotscope.queries.rules import FAMILIES, NAME, RULES, edition_name, registry, rule_table
from lotscope.queries.sql import KEY, expr, on, scan
from lotscope.sources import sinks

c = F.col
ORDER = "order by overall desc, k1, k2, k3, k4, year"
AGREE = f""",
ranked as (select * from (select *, row_number() over (partition by job, crop {ORDER}) as rank from v_cand) where rank<=10),
agree as (select r.*, g.confidence, g.flagged, g.anchored, g.printed_year,
  (confidence is null or confidence>=0.70) and not flagged and anchored as ok from ranked r join v_reading g on g.job=r.job and g.crop=r.crop
  and {expr(KEY, 'g.slogan')}={expr(KEY, 'r.slogan')}),
p1 as (select job, crop, arg_min(year,rank) as year, arg_min(slogan,rank) as slogan, arg_min(type,rank) as type, cast(min(rank) as int) as matched_rank,
  bool_and(ok) as auto, 'gemini_auto' as source from agree group by 1,2 having count(distinct year)=1),
votes as (select job, year, count(*) as n, min(crop) as fc from p1 group by 1,2),
maj as (select job, arg_min(year,(-n, fc, year)) as majority_year, max(n)>=2 and count(*) filter (n=mx)=1 as clear
  from (select *, max(n) over (partition by job) as mx from votes) group by 1),
op as (select a.*, m.majority_year, coalesce(m.clear,false) as clear, coalesce(a.year=printed_year,false) or coalesce(game_year=printed_year,false) as fits
  from agree a left join maj m using (job) where not exists (select 1 from p1 where p1.job=a.job and p1.crop=a.crop)),
pk as (select job, crop, bool_and(ok) as auto, case when count(*) filter (fits)=1 then 'gemini_printed_year' when bool_or(clear) then 'gemini_majority' else 'gemini_clip_fallback' end as source,
  case when count(*) filter (fits)=1 then min(rank) filter (fits) when bool_or(clear) then arg_min(rank,(abs(year-majority_year),rank)) else min(rank) end as mr from op group by 1,2),
p2 as (select pk.job, pk.crop, o.year, o.slogan, o.type, cast(mr as int) as matched_rank, auto, source from pk join op o on o.job=pk.job and o.crop=pk.crop and o.rank=pk.mr),
res as (select * from p1 union all select * from p2)"""
TOPS = f""",
t2 as (select * from (select *, row_number() over (partition by job, crop {ORDER}) as rk from v_cand) where rk<=2),
tops as (select a.job, a.crop, a.year, a.slogan, a.type, a.overall, a.overall-b.overall as gap from (select * from t2 where rk=1) a
  left join (select * from t2 where rk=2) b on a.job=b.job and a.crop=b.crop)"""
SURE = "(not (coalesce(gap<0.05,true) and overall<0.9) and (overall>=0.82 or coalesce(gap>=0.12,false)))"
CLASSED = AGREE + TOPS + f""",
classed as (select t.job, t.crop, case when coalesce(r.auto,false) or {SURE} then 'confirmed' when t.job%5=0 and overall>=0.65 then 'review' else 'ignored' end as label,
  case when coalesce(r.auto,false) or {SURE} then coalesce(r.year,t.year) else t.year end as year,
  case when coalesce(r.auto,false) or {SURE} then coalesce(r.slogan,t.slogan) else t.slogan end as slogan, overall, gap,
  case when coalesce(r.auto,false) or {SURE} then coalesce(r.source,'clip_green') end as source from tops t left join res r on r.job=t.job and r.crop=t.crop)"""


def dec(body):
    return on("v_cand", "v_reading", body="").rstrip() + body


def agree(t):
    return decide.agreeing(decide.ranked_candidates(t.view("v_cand")), t.view("v_reading"))


def resolution(t):
    return decide.resolve(t.view("v_cand"), t.view("v_reading"))


def tops(t):
    return decide.crop_tops(t.view("v_cand"))


def classed_and_resolved(t):
    rows = decide.read_crops(t.view("v_cand"), t.view("v_reading"))
    resolved = cut_lineage(decide.resolve_read(rows))  # one row per crop; staging reads it once more
    return decide.classify(decide.lead(rows), resolved, c("job") % 5 != 0), resolved


def classed(t):
    return classed_and_resolved(t)[0]


R = ["job", "crop", "year", "slogan", "type", "matched_rank", "auto", "source"]


@query("j14_agreeing", dec(AGREE + " select job, crop, rank, year, slogan, confidence from agree"))
def j14(t):
    return agree(t).select("job", "crop", "rank", "year", "slogan", "confidence")


@query("r1_resolve_pass1", dec(AGREE + " select * from p1"))
def r1(t):
    return decide.resolve_pass1(agree(t)).select(*R)


@query("a20_majority", dec(AGREE + " select * from maj"))
def a20(t):
    return decide.majority(decide.resolve_pass1(agree(t)))


@query("r2_resolve_pass2", dec(AGREE + " select * from p2"))
def r2(t):
    a = agree(t)
    return decide.resolve_pass2(a, decide.resolve_pass1(a)).select(*R)


@query("a33_resolve_telemetry", dec(AGREE + """
select c.job, coalesce(n_resolved,0) as n_resolved, coalesce(n_confirmed,0) as n_confirmed, coalesce(n_majority,0) as n_majority,
  coalesce(n_printed_year,0) as n_printed_year, n_crops-coalesce(n_resolved,0) as n_manual
from (select job, count(distinct crop) as n_crops from v_cand group by 1) c left join (select job, count(*) as n_resolved, count(*) filter (auto) as n_confirmed,
  count(*) filter (source='gemini_majority') as n_majority, count(*) filter (source='gemini_printed_year') as n_printed_year from res group by 1) using (job)"""))
def a33(t):
    return decide.resolve_telemetry(t.view("v_cand"), t.view("v_reading"))


@query("r3_classify", dec(CLASSED + " select job, crop, label, year, slogan, round(overall,6) as overall, round(gap,6) as gap, source from classed"))
def r3(t):
    return classed(t).withColumns({"overall": F.round("overall", 6), "gap": F.round("gap", 6)})


@query("a21_best_per_entity", dec(CLASSED + """ select job, year, slogan, crop, round(overall,6) as overall from (
  select *, row_number() over (partition by job, year, slogan order by overall desc, crop) as rn from classed where label='confirmed') where rn=1"""))
def a21(t):
    return decide.best_per_entity(classed(t).where("label = 'confirmed'")).select("job", "year", "slogan", "crop", F.round("overall", 6).alias("overall"))


LOOKUP = RULES + f""",
loose as (select * from (select *, {expr(KEY, 'slogan')} as key, row_number() over (partition by year, {expr(KEY, 'slogan')} order by first_seq) as rn from rules) where rn=1)"""


def looked(source):
    return f"""(select m.*, coalesce(r.max_price_single, l.max_price_single, '') as max_price_single,
  case when coalesce(r.amount_needed, l.amount_needed)='2' then 2 else 0 end as amount_needed
  from {source} m left join rules r on r.year=cast(m.year as string) and r.slogan=m.slogan
  left join loose l on l.year=cast(m.year as string) and l.key={expr(KEY, 'm.slogan')})"""


# lots are valued with the full names, as the rules know them
EVAL_VIEWS = ("v_rules", "v_named", "v_catalogue")
NAMED_TOPS = TOPS.replace("v_cand", "v_named")
EVALUATED = LOOKUP + NAMED_TOPS + f""",
{FAMILIES},
laned as (select *, case when {SURE} and {expr(KEY, NAME)} not in (select key from fam) then 'confirmed' when overall>=0.65 then 'review' end as lane from tops),
ent as (select * from (select *, row_number() over (partition by job, lane, year, slogan order by overall desc, crop) as rn from laned where lane is not null) where rn=1),
evaluated as (select *, lane='confirmed' and amount_needed>0 as needed_hit from {looked('ent')})"""
VALUED = EVALUATED + """,
priced as (select job, sum(coalesce(try_cast(replace(max_price_single,'$','') as double),0)) as lot_value, count(*) filter (amount_needed>0) as n_needed
  from evaluated where lane='confirmed' group by 1),
valued as (select *, lot_value-asking as margin, asking>0 and lot_value>asking as undervalued from (
  select l.item_id as job, l.title, l.seller, l.asking/300 as asking, coalesce(p.lot_value,0) as lot_value, coalesce(p.n_needed,0) as n_needed
  from v_listing l left join priced p on p.job=l.item_id))"""


def ev(body, *more):
    return on(*EVAL_VIEWS, *more, body="").rstrip() + body


def evaluated(t):
    return decide.evaluate(t.view("v_named"), registry(t), rule_table(t), edition_name())


def lots(t):
    return t.view("v_listing").select(c("item_id").alias("job"), "title", "seller", (c("asking") / 300).alias("asking"))


def confirmed(t):
    return evaluated(t).where("lane = 'confirmed'").select("job", "year", "slogan", "overall", "crop")


def valued(t):
    return decide.lot_value(confirmed(t), rule_table(t), lots(t))


@query("r4_evaluate", ev(EVALUATED + " select job, lane, year, slogan, crop, round(overall,6) as overall, round(gap,6) as gap, max_price_single, amount_needed, needed_hit from evaluated"))
def r4(t):
    return evaluated(t).withColumns({"overall": F.round("overall", 6), "gap": F.round("gap", 6)})


VALUES = "round(asking,4) as asking, round(lot_value,4) as lot_value, round(margin,4) as margin"


def r4d(df):
    return df.withColumns({n: F.round(n, 4) for n in ("asking", "lot_value", "margin")})


@query("a22_lot_value", ev(VALUED + f" select job, title, seller, {VALUES}, n_needed, undervalued from valued", "v_listing"))
def a22(t):
    return r4d(valued(t))


@query("r5_deals", ev(VALUED + f" select job, {VALUES}, n_needed, undervalued from valued where n_needed>0 or undervalued", "v_listing"))
def r5(t):
    return r4d(decide.deals(valued(t))).drop("title", "seller")


ALERTS = VALUED + """, un as (select job, count(*) as unmatched from laned where lane is distinct from 'confirmed' group by 1),
alerts as (select v.job, case when length(title)<=80 then title else left(title,79) || '…' end as title, seller, asking, lot_value, margin, coalesce(unmatched,0) as unmatched,
  e.year, e.slogan, e.max_price_single, e.amount_needed from valued v left join un using (job) left join (select * from evaluated where lane='confirmed') e on e.job=v.job
  where n_needed>0 or undervalued)"""


def alerts(t):
    conf = decide.twin_guard(tops_named(t), registry(t), edition_name()).where(~(nm.is_confirmed_guarded(c("overall"), c("gap")) & ~c("is_twin")))
    unmatched = conf.groupBy("job").agg(F.count(F.lit(1)).alias("unmatched"))
    lots_ = decide.deals(valued(t)).join(unmatched, "job", "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(0)))
    return decide.alert_rows(lots_, confirmed(t), rule_table(t))


def tops_named(t):
    return decide.crop_tops(t.view("v_named"))


@query("a42_alert_rows", ev(ALERTS + f" select job, title, seller, {VALUES}, unmatched, year, slogan, max_price_single, amount_needed from alerts", "v_listing"))
def a42(t):
    return r4d(alerts(t))


@query("f39_report_line", ev(ALERTS + """
select distinct job, 1 as section, 'Asking: *' || printf('$%.2f', asking) || '*' as text from alerts union all
select job, 2, '  • ' || year || ' — "' || slogan || '"    max: ' || max_price_single || case when amount_needed>0 then '  ⭐ need ' || amount_needed else '' end from alerts where slogan is not null union all
select distinct job, 3, case when lot_value>0 then 'Calculated value: *' || printf('$%.2f', lot_value) || '*  |  ' || case when margin>0 then '✅ Good deal — *+' || printf('$%.2f', margin) || '* below calculated value'
  else '⚠️ You''d overpay by *' || printf('$%.2f', abs(margin)) || '*' end else '_Calculated value: $0.00 (no matched buttons have price rules)_' end from alerts""", "v_listing"))
def f39(t):
    return decide.report_lines(alerts(t))


@query("a24_run_summary", ev(EVALUATED + """
select market, count(*) as n, count(*) filter (hit) as alerted, count(*) filter (not hit) as confirmed_not_needed, count(*) filter (hit is null) as rejected
from (select case when o_orderstatus='P' then 'b' else 'a' end as market, hit from orders left join (
  select job, bool_or(needed_hit) as hit from evaluated where lane='confirmed' group by 1) on job=o_orderkey) group by 1"""))
def a24(t):
    ids = t.table("orders").select(c("o_orderkey").alias("job"), F.concat(F.when(c("o_orderstatus") == "P", "etsy_").otherwise("v1|"), "o_orderkey").alias("listing_id"))
    return decide.run_summary(ids, evaluated(t))


@query("a25_digest", scan("""
, need as (select * from (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match where needed>0) where rk=1)
select n.item_id, cast(n.year as string) as year, n.slogan, round(n.overall,6) as overall, l.title, row_number() over (order by overall desc, n.item_id) as rank,
  (select count(*)-25 from need join v_listing using (item_id)) as more, n.overall>=0.6 as above from need n join v_listing l using (item_id) order by overall desc, n.item_id limit 25"""))
def a25(t):
    return decide.digest(scan_records(t)).withColumn("overall", F.round("overall", 6))


def real_marks(t):
    return t.view("v_cand").groupBy("job", "crop").agg(F.max("k4").alias("m")).select(
        "job", "crop", F.when(c("m") >= 6, "gemini_recovered").when(c("m") == 5, "gemini_led").alias("mark_source"))


STAGED = CLASSED + """, real as (select job, crop from v_cand group by 1,2 having max(k4)<5),
staged as (select * from classed join real using (job, crop) where label='confirmed' and overall>=0.5 and exists (select 1 from res where res.job=classed.job and res.crop=classed.crop and res.auto))"""


def staged(t):
    classified, resolved = classed_and_resolved(t)
    return decide.staging_candidates(classified, real_marks(t), resolved).select("job", "crop", "year", "slogan")


@query("p12_staging_candidates", dec(STAGED + " select job, crop, year, slogan from staged"))
def p12(t):
    return staged(t)


@query("s20_promotion_manifest", on("v_cand", "v_reading", "v_catalogue", body="").rstrip() + STAGED + f""",
ids as (select year, {expr(KEY, "split_part(slogan,' ',2)")} as key, cast(max(entry_id) as string) as id from v_catalogue group by 1,2)
select job, crop, 'crops/' || job || '/' || crop || '.jpg' as source_name, coalesce(id, '_year_' || s.year) as entry,
  'reference/_staging/' || coalesce(id, '_year_' || s.year) || '/' || (1700000000000+crop) || '.jpg' as dest
from staged s left join ids on ids.year=s.year and ids.key={expr(KEY, 's.slogan')}""")
def s20(t):
    cat = t.view("v_catalogue").withColumn("slogan", F.split_part("slogan", F.lit(" "), F.lit(2)))
    named = rules.entry_id(staged(t), cat).withColumn("source_name", F.concat(F.lit("crops/"), "job", F.lit("/"), "crop", F.lit(".jpg")))
    return decide.promotion_manifest(named, 1700000000000).select("job", "crop", "source_name", "entry", "dest")


CONF = AGREE + TOPS + f""",
conf as (select t.job || ':' || t.crop as check_id, t.job, t.crop, t.year as chosen_year, t.slogan as chosen_phrase, case when t.overall>=0.85 then 'auto_resolve' else 'green' end as source,
  cast(min(ir) filter (r.year=t.year) as int) as rank_restricted, cast(min(r.rank) filter (r.year=t.year) as int) as rank_shadow, count(*) as board_size
  from (select * from tops where {SURE}) t join (select *, case when year<=1995 then row_number() over (partition by job, crop, year<=1995 order by rank) end as ir from ranked) r using (job, crop)
  group by 1,2,3,4,5,6)"""


def confirmations(t):
    return decide.confirm_rows(tops(t), decide.ranked_candidates(t.view("v_cand")), [1992, 1993, 1994, 1995])


@query("s21_confirm_rows", dec(CONF + " select * from conf"))
def s21(t):
    return confirmations(t)


@query("s21_count_rows", on("v_cand", body="select 'gemini_count:' || job as check_id, job, cast(count(*) as string) as chosen_phrase, 'gemini_count' as source from v_cand group by 2"))
def s21_counts(t):
    return decide.count_rows(t.view("v_cand").groupBy("job").agg(F.count(F.lit(1)).alias("total")))


@query("j11_join_outcomes", dec(CONF + " select t.job, t.crop, t.year, chosen_year, chosen_phrase, source from tops t left join conf using (job, crop)"))
def j11(t):
    m = tops(t).select(F.concat_ws(":", "job", "crop").alias("check_id"), "job", "crop", "year")
    return decide.join_outcomes(m, confirmations(t)).drop("check_id")


def match_records(t):
    """Nested match records: crop identity, detection facts, and the leading three candidates."""
    top = decide.top_k(t.view("v_cand"), ["job", "crop"], decide.best_first(), 3)
    board = F.transform(F.array_sort(F.collect_list(F.struct("rank", "year", "slogan", "overall"))), lambda x: x.dropFields("rank"))
    rows = top.groupBy("job", "crop").agg(board.alias("restricted_top"), F.max("rank").alias("n"))
    return rows.select("job", "crop", F.struct(c("n").alias("n_crops"), (c("n") > 1).alias("bg_is_white"),
                                               F.lit(None).cast("string").alias("mask_path")).alias("det"), "restricted_top", (c("crop") == 1).alias("shadow_enabled"))


@query("s16_flatten_match", dec(AGREE + """
select cast(job as string) as job, cast(crop as string) as crop, cast(count(*) as string) as det_n_crops, upper(cast(count(*)>1 as string)) as det_bg_is_white, '' as det_mask_path,
  cast(to_json(list({year: year, slogan: slogan, overall: overall} order by rank)) as string) as restricted_top_json, upper(cast(crop=1 as string)) as shadow_enabled
from ranked where rank<=3 group by job, crop"""))
def s16(t):
    return sinks.flat_cells(match_records(t))


@query("s17_flatten_confirm", dec(CONF + """ select check_id, cast(job as string) as job, cast(crop as string) as crop, cast(chosen_year as string) as chosen_year, chosen_phrase, source,
 coalesce(cast(rank_restricted as string),'') as rank_restricted, coalesce(cast(rank_shadow as string),'') as rank_shadow, cast(board_size as string) as board_size from conf"""))
def s17(t):
    return sinks.flat_cells(confirmations(t))


@query("a37_count_histogram", on("v_listing", "v_cand", body="""
, n as (select item_id, count(job) as n from v_listing left join v_cand on job=item_id group by 1)
select bucket, count(*) as items, round(count(*)/(select count(*) from n),6) as share from (select case when n<=3 then cast(n as string) when n<=12 then '4-12' else '13+' end as bucket from n) group by 1"""))
def a37(t):
    counts = t.view("v_cand").groupBy("job").agg(F.count(F.lit(1)).alias("n"))
    all_ = t.view("v_listing").select(c("item_id").alias("job")).join(counts, "job", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return decide.count_histogram(all_).withColumn("share", F.round("share", 6))


@query("a39_phrase_background", dec(AGREE + """ select r.slogan as phrase, count(*) as n, round(avg(image_score),6) as background from ranked r
 left join res on res.job=r.job and res.crop=r.crop where res.slogan is distinct from r.slogan group by 1 having count(*)>=3"""))
def a39(t):
    truth = resolution(t).select("job", "crop", c("slogan").alias("truth"))
    board = decide.ranked_candidates(t.view("v_cand")).join(truth, ["job", "crop"], "left")
    board = board.select(c("slogan").alias("phrase"), c("image_score").alias("text_score"), c("slogan").eqNullSafe(c("truth")).alias("is_truth"))
    return decide.phrase_background(board).withColumn("background", F.round("background", 6))
