"""Grades, ladders, tripwires and streaks."""

from pyspark.sql import functions as F

from lotscope.operators import grading, ranking
from lotscope.operators.records import best_first
from lotscope.plans.ranked import first_by
from lotscope.queries.registry import query
from lotscope.queries.sql import KEY, expr, on

c = F.col


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("a34_grade_counts", on("v_graded", body="""select gate, path, count(*) as n, round(avg(case when selected=reader_count then 1.0 else 0 end),6) as exact,
 round(avg(case when abs(selected-reader_count)<=1 then 1.0 else 0 end),6) as within_one from v_graded group by 1,2"""))
def a34(t):
    return r6(grading.grade_counts(t.view("v_graded")), "exact", "within_one")


@query("a34_grade_judged", on("v_judged", body="""select gate, path, count(*) as n, round(avg(case when truth=wrong then 1.0 else 0 end),6) as exact,
 1e0 as within_one from v_judged group by 1,2"""))
def a34_judged(t):
    rows = t.view("v_judged").select("gate", "path", c("truth").alias("selected"), c("wrong").alias("reader_count"))
    return r6(grading.grade_counts(rows), "exact", "within_one")


LADDER = f"""
, r as (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match),
top as (select item_id, overall as o, image_score as ref, needed=3 as wrong, {expr(KEY, 'slogan')} as key from r where rk=1),
nxt as (select t.item_id, max(r.overall) as o2 from top t join r on r.item_id=t.item_id and {expr(KEY, 'r.slogan')}<>t.key group by 1),
g as (select t.item_id, t.wrong, t.ref, round(t.o-s.overall,9) as gap, round(t.o-n.o2,9) as sgap from top t left join (select * from r where rk=2) s using (item_id) left join nxt n using (item_id)),
rules as (select 'gap>=0.15' as rule, coalesce(gap>=0.15,false) as fire, wrong from g union all select 'slogan_gap>=0.12', coalesce(sgap>=0.12,false), wrong from g
 union all select 'combo', coalesce(sgap>=0.05 and ref>=0.90,false), wrong from g)
select rule, count(*) filter (fire) as fires, count(*) filter (fire and wrong) as wrong_fires, round(count(*) filter (fire)/count(*),6) as coverage from rules group by 1"""


@query("a35_rule_ladder", on("v_match", body=LADDER))
def a35(t):
    m = t.view("v_match")
    gaps = ranking.gaps(m, best_first()).select("item_id", F.round("gap", 9).alias("gap"), F.round("slogan_gap", 9).alias("sgap"))
    tops = first_by(m, ["item_id"], best_first()).select("item_id", c("image_score").alias("ref"), (c("needed") == 3).alias("wrong"))
    ladder = {"gap>=0.15": c("gap") >= 0.15, "slogan_gap>=0.12": c("sgap") >= 0.12, "combo": (c("sgap") >= 0.05) & (c("ref") >= 0.90)}
    return r6(grading.rule_ladder(tops.join(gaps, "item_id"), ladder), "coverage")


@query("a36_event_lift", on("v_judged", body="""select round(avg(wrong),6) as baseline, round(avg(wrong) filter (n_chars<200),6) as given_event, count(*) filter (n_chars<200) as n_event,
 round(avg(wrong) filter (n_chars<200)/avg(wrong),6) as lift from v_judged"""))
def a36(t):
    return r6(grading.event_lift(t.view("v_judged"), c("n_chars") < 200), "baseline", "given_event", "lift")


@query("a41_auto_precision", on("v_judged", body="select path as source, count(*) as n, count(*) filter (wrong=1) as n_corrected, round(1-count(*) filter (wrong=1)/count(*),6) as precision from v_judged group by 1"))
def a41(t):
    rows = t.view("v_judged").select(c("path").alias("source"), (c("wrong") == 1).alias("corrected"))
    return r6(grading.auto_precision(rows), "precision")


@query("w17_tripwire", on("v_graded", body="""select seq, rn, round(rate,6) as rate, rate>0.7 as tripped from (select seq, row_number() over (order by seq) as rn,
 avg(case when abs(selected-reader_count)>1 then 1.0 else 0 end) over (order by seq rows 49 preceding) as rate from v_graded where gate='auto') where rn>=50"""))
def w17(t):
    lots = t.view("v_graded").where("gate = 'auto'").withColumn("disagree", F.abs(c("selected") - c("reader_count")) > 1)
    return r6(grading.tripwire(lots.select("seq", "disagree"), "seq", 50, 0.7, 1024), "rate").select("seq", "rn", "rate", "tripped")


@query("w18_streaks", on("v_obs", body="""select seq, streak, streak>=5 as halt from (select seq, row_number() over (order by seq) - coalesce(max(case when not failed then rn end) over (order by seq),0) as streak from (
 select seq, source in ('error','signup','click') as failed, row_number() over (order by seq) as rn from v_obs))"""))
def w18(t):
    rows = t.view("v_obs").select("seq", c("source").isin("error", "signup", "click").alias("failed"))
    return grading.streaks(rows, "seq", 5, 1024).select("seq", "streak", "halt")


@query("w19_cumulative_precision", on("v_graded", body="""select rule, batch, correct, n, cast(sum(correct) over w as bigint) as correct_so_far, cast(sum(n) over w as bigint) as n_so_far,
 round(sum(correct) over w/sum(n) over w,6) as precision from (select gate as rule, strftime(day,'%Y-%m') as batch, count(*) filter (abs(selected-reader_count)<=2) as correct, count(*) as n
 from v_graded group by 1,2) window w as (partition by rule order by batch rows unbounded preceding)"""))
def w19(t):
    rows = t.view("v_graded").select(c("gate").alias("rule"), F.date_format("day", "yyyy-MM").alias("batch"), (F.abs(c("selected") - c("reader_count")) <= 2).alias("correct"))
    return r6(grading.cumulative_precision(rows), "precision")
