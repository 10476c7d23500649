"""Marks: geometry, votes, quality, bands, holes, matching, vetoes, labels."""

from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import geometry as geo
from lotscope.functions import numbers as nm
from lotscope.operators import marks as mk
from lotscope.plans import spatial
from lotscope.queries.registry import query
from lotscope.queries.sql import on

c = F.col
lit = F.lit
WIDTH, HEIGHT = 800.0, 600.0
KEYS = "job, i, x"


def marks(t):
    return t.view("v_mark").where("not is_reading").drop("is_reading")


def readings(t):
    return t.view("v_mark").where("is_reading").drop("is_reading")


def mark_sql(body):
    return on("v_mark", body=", m as (select * from v_mark where not is_reading), rd as (select * from v_mark where is_reading)\n" + body)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


key = ["job", "i", "x"]


# --- functions over the whole mark table ------------------------------------------------------------------

@query("f26_normalize_scale", on("v_mark", body="""
, p as (select job, i, x, x/8*case when job%2=0 then 10 else 1 end as px from v_mark)
select job, i, x, round(case when mx>100 then px/10 else px end,6) as sx, case when mx>100 then 'permille' else 'percent' end as coord_scale
from p join (select job, max(px) as mx from p group by 1) using (job)"""))
def f26(t):
    from lotscope.sources.readings import normalize_scale
    px = c("x") / 8 * F.when(c("job") % 2 == 0, 10).otherwise(1)
    rows = t.view("v_mark").select("job", "i", c("x").alias("x0"), px.alias("x"), F.lit(None).cast("double").alias("y"),
                                   F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("edge_x"), F.lit(None).cast("double").alias("edge_y"))
    return normalize_scale(rows).select("job", "i", c("x0").alias("x"), F.round("x", 6).alias("sx"), "coord_scale")


@query("f27_geometry", on("v_mark", body=f"""select {KEYS}, round(x/100*800,6) as px, round(case when fill*10/100*600>0 then fill*10/100*600 end,6) as from_size,
 round(case when sqrt(power(x/10/100*800-x,2)+power(y/10/100*600-y,2))>0 then sqrt(power(x/10/100*800-x,2)+power(y/10/100*600-y,2)) end,6) as from_edge,
 greatest(0, cast(round_even(x-r-floor(r*0.1),0) as int)) as x1, least(800, cast(round_even(x+r+floor(r*0.1),0) as int)) as x2 from v_mark"""))
def f27(t):
    box = geo.synth_box(c("x"), c("y"), c("r"), lit(WIDTH), lit(HEIGHT))
    out = t.view("v_mark").select(*key, F.round(geo.pct_to_px(c("x"), lit(WIDTH)), 6).alias("px"), F.round(geo.size_to_radius(c("fill") * 10, lit(WIDTH), lit(HEIGHT)), 6).alias("from_size"),
                                  F.round(geo.radius_from_edge(c("x") / 10, c("y") / 10, c("x"), c("y"), lit(WIDTH), lit(HEIGHT)), 6).alias("from_edge"), box.alias("b"))
    return out.select(*key, "px", "from_size", "from_edge", "b.x1", "b.x2")


@query("f28_is_anchored", on("v_mark", body=f"select {KEYS}, coalesce(case when line<>3 then y/20 end<=0.75*r, true) as ok from v_mark"))
def f28(t):
    return t.view("v_mark").select(*key, geo.is_anchored(F.when(c("line") != 3, c("y") / 20), c("r")).alias("ok"))


DETECT = """select *, cast(round(fill*10) as int) as n_, cast(job%4 as int) as rows_, cast(line as int) as cols_, case when line=2 then null when confidence<0.5 then 'scale_first' else 'sweep_fallback' end as path_ from v_mark"""


def detected(t):
    path = F.when(c("line") == 2, None).when(c("confidence") < 0.5, "scale_first").otherwise("sweep_fallback")
    return t.view("v_mark").withColumns({"n_": F.round(c("fill") * 10).cast("int"), "rows_": (c("job") % 4).cast("int"), "cols_": c("line").cast("int"), "path_": path})


GRID = "n_>=1 and rows_>=1 and cols_>=1 and n_ between rows_*cols_-(cols_-1) and rows_*cols_"


@query("f29_grid_consistent", on("v_mark", body=f"select {KEYS}, {GRID} as ok from ({DETECT})"))
def f29(t):
    return detected(t).select(*key, geo.grid_consistent(c("n_"), c("rows_"), c("cols_")).alias("ok"))


GATE = f"case when confidence>=0.7 and fill+0.3>=0.85 and n_>=1 and {GRID} and (path_ is null or path_='scale_first') then 'auto' when confidence>=0.55 and n_>=1 then 'suggest' else 'manual' end"


@query("f30_gate", on("v_mark", body=f"select {KEYS}, gate, case when gate='auto' and status<>'F' then 'suggest' else gate end as demoted from (select *, {GATE} as gate from ({DETECT}))"))
def f30(t):
    g = geo.gate(c("confidence"), c("fill") + 0.3, c("n_"), c("rows_"), c("cols_"), c("path_"))
    engaged = F.when(c("status") == "F", "hough+blob").otherwise("grid")
    return detected(t).select(*key, g.alias("gate"), geo.demote_gate(g, engaged).alias("demoted"))


@query("f31_mask_policy", on("v_mark", body=f"""select {KEYS}, coalesce(sp<=18,false) as use_diff, round(greatest(25, greatest(coalesce(sp,0),0)*3),6) as threshold,
 status || case when coalesce(sp<=18,false) then '+bgdiff' else '' end as label, greatest(25, least(35, cast(round_even(r,0) as int))) as radius from (select *, case when line<>4 then y/20 end as sp from v_mark)"""))
def f31(t):
    spread = F.when(c("line") != 4, c("y") / 20)
    used = geo.use_background_diff(spread)
    return t.view("v_mark").select(*key, used.alias("use_diff"), F.round(geo.background_threshold(spread), 6).alias("threshold"),
                                   geo.suffix_label(c("status"), used, "+bgdiff").alias("label"), geo.clamp_radius(c("r"), F.lit(25), F.lit(35)).alias("radius"))


VOTE = """vt as (select job, i, x, case when 1+fill>1.35 then r else r*1.1 end as radius, case when 1+fill>1.35 then 0.40 when confidence>=0.45 then greatest(0.05,least(1.0,confidence)) else 0.05 end as weight,
 1+fill>1.35 as merged from v_mark)"""


def votes(t):
    v = geo.blob_vote(c("r"), c("r") * (1 + c("fill")), c("r") * 1.1, c("confidence"))
    return t.view("v_mark").select(*key, v.alias("v")).select(*key, "v.*")


@query("f32_blob_vote", on("v_mark", body=f", {VOTE} select job, i, x, round(radius,6) as radius, round(weight,6) as weight, merged from vt"))
def f32(t):
    return r6(votes(t), "radius", "weight")


@query("f33_decisions", on("v_mark", body=f"""select {KEYS}, case when not (line<>1 and line>5 and fill*1.3>0.5) then 'n/a' when fill*1.3*(1-confidence)<=0.42 then 'accept_dense' else 'refuse' end as flood,
 case when line=7 or status='O' or n_=0 or line=0 or n_<line*0.6 then 'n/a' when fill>0.5 then 'decline' else 'commit' end as deficit from ({DETECT})"""))
def f33(t):
    return detected(t).select(*key, geo.flood_decision(c("line"), c("fill") * 1.3, c("confidence"), c("line") != 1).alias("flood"),
                              geo.deficit_decision(F.lit(True), c("n_"), c("line"), c("line") == 7, c("status") == "O", c("fill")).alias("deficit"))


@query("f34_infer_grid", on("v_mark", body="""select n, arg_min(r, (score, r)) as rows, cast(n/arg_min(r, (score, r)) as int) as cols, any_value(k) as n_jobs from (
 select n, k, cast(r as int) as r, abs(ln((800.0/(n/r))/(600.0/r))) as score from (select n, count(*) as k from (select cast(count(*) as int) as n from v_mark group by job) group by 1), unnest(range(1,n+1)) u(r) where n%r=0) group by n"""))
def f34(t):
    sizes = t.view("v_mark").groupBy("job").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_jobs"))
    return sizes.select("n", geo.infer_grid(c("n"), lit(HEIGHT), lit(WIDTH)).alias("g"), "n_jobs").select("n", "g.*", "n_jobs")


@query("f35_sweep_radii", on("v_mark", body=f"""select {KEYS}, array_to_string(list_transform(list_filter(range(1,5), lambda k: k=1 or not list_contains(a[1:k-1], a[k])), lambda k: a[k]),',') as radii
 from (select *, [greatest(9,cast(floor(r*1.0) as int)), greatest(9,cast(floor(r*0.66::double) as int)), greatest(9,cast(floor(r*0.45::double) as int)), greatest(9,cast(floor(r*0.3::double) as int))] as a from v_mark)"""))
def f35(t):
    return t.view("v_mark").select(*key, F.array_join(geo.sweep_radii(c("r")), ",").alias("radii"))


@query("f36_count_inconsistent", on("v_graded", body="select seq, case when case when gate='manual' then 0 when gate='suggest' then null else selected end<>0 then selected<>reader_count end as bad from v_graded"))
def f36(t):
    total = F.when(c("gate") == "manual", 0).when(c("gate") == "auto", c("selected"))
    return t.view("v_graded").select("seq", nm.count_inconsistent(total, c("reader_count")).alias("bad"))


@query("f37_guided_count", on("v_graded", body="select seq, cast(case when selected>0 then case when reader_count-3>0 then least(selected,reader_count-3) else greatest(0,selected-2) end else 0 end as bigint) as n from v_graded"))
def f37(t):
    localized = F.greatest(F.lit(0), c("reader_count") - 3)
    return t.view("v_graded").select("seq", nm.guided_count(c("selected"), localized, F.lit(2)).cast("bigint").alias("n"))


@query("p14_low_res_guard", on("v_mark", body=f"select {KEYS}, case when 2*r<64 then 'review' else 'ok' end as guard from v_mark"))
def p14(t):
    return mk.low_res_guard(t.view("v_mark")).select(*key, "guard")


# --- votes and quality -------------------------------------------------------------------------------------

WMED = f", {VOTE}, cum as (select job, radius, sum(w) over (partition by job order by radius) as thr, sum(w) over (partition by job) as tot from (select job, radius, sum(weight) as w from vt group by 1,2)), wm as (select job, min(radius) as radius from cum where round(thr,9)>=round(tot/2,9) group by 1)"


@query("a27_weighted_median", on("v_mark", body=WMED + " select job, round(radius,6) as radius from wm"))
def a27(t):
    return r6(mk.weighted_median(votes(t)), "radius")


@query("a28_consensus_radius", on("v_mark", body=WMED + """ select job, round(wm.radius,6) as r_est, round(case when n=1 then least(conf,0.6) else conf end,6) as scale_conf, n_merged from wm join (
 select job, count(*) as n, count(*) filter (merged) as n_merged, greatest(0.0,least(1.0,1-sqrt(greatest(0,sum(weight*radius*radius)/sum(weight)-power(sum(weight*radius)/sum(weight),2)))/(sum(weight*radius)/sum(weight)))) as conf from vt group by 1) using (job)"""))
def a28(t):
    return r6(mk.consensus_radius(votes(t)), "r_est", "scale_conf")


MED = ", med as (select job, median(r) as mr from m group by 1)"
NN = ", nn as (select a.job, a.i, a.x, min(sqrt(power(a.x-b.x,2)+power(a.y-b.y,2))) as nn from m a join m b on a.job=b.job and (a.i<>b.i or a.x<>b.x) group by 1,2,3)"


@query("a29_mark_set_score", mark_sql(MED + NN + """ select job, n, round(0.4*fl+0.3*case when n>=2 then greatest(0,1-case when nm>0 then ns/nm else 1 end) else 0.5 end+0.2*greatest(0,1-case when rm>0 then rs/rm else 1 end)
 +0.1*case when cov<=0.4 then cov/0.4 else greatest(0,1-(cov-0.4)/0.6) end,6) as score from (select job, count(*) as n, avg(fill) as fl, avg(r) as rm, stddev_pop(r) as rs, count(*)*pi()*any_value(mr)*any_value(mr)/480000.0 as cov from m join med using (job) group by 1)
 left join (select job, avg(nn) as nm, stddev_pop(nn) as ns from nn group by 1) using (job)"""))
def a29(t):
    return r6(mk.mark_set_score(marks(t), WIDTH, HEIGHT), "score")


@query("a31_median_radius", mark_sql(MED + " select job, round(mr,6) as median_r from med"))
def a31(t):
    return r6(mk.median_radius(marks(t)), "median_r")


@query("a31_spacing_radius", mark_sql(NN + """ select job, round(case when q is null then a else greatest(a*0.6, least(0.5*q, a*1.8)) end,6) as radius from (
 select job, sqrt(480000.0/count(*))*0.42 as a from m group by 1) left join (select job, median(nn) as q from nn group by 1) using (job)"""))
def a31_spacing(t):
    return r6(mk.spacing_radius(marks(t), WIDTH, HEIGHT), "radius")


def band_sql(col, name):
    return f""", g_{name} as (select *, {col}-lag({col}) over (partition by job order by {col}) as gap from m), mg_{name} as (select job, median(gap) as mg from g_{name} group by 1),
b_{name} as (select job, i, x, y, r, cast(sum(case when gap>greatest(1.5*mg,1.5*mr) then 1 else 0 end) over (partition by job order by {col}) as bigint) as {name} from g_{name} join mg_{name} using (job) join med using (job))"""


ROWS, COLS = band_sql("y", "row_"), band_sql("x", "col_")
GRID_SQL = MED + ROWS + COLS + """, g as (select r.job, r.i, r.x, r.y, r.row_, c.col_ from b_row_ r join b_col_ c on r.job=c.job and r.i=c.i and r.x=c.x),
rc as (select job, row_, avg(y) as cy, min(col_) as lo, max(col_) as hi from g group by 1,2), cc as (select job, col_, avg(x) as cx from g group by 1,2)"""


@query("w9_bands", mark_sql(MED + ROWS + " select job, row_ as band, count(*) as n, round(avg(y),6) as center from b_row_ group by 1,2"))
def w9(t):
    return r6(mk.bands(marks(t), "y"), "center")


@query("w10_reading_order", mark_sql(MED + ROWS + " select job, i, x, row_number() over (partition by job order by row_, x, i) as position from b_row_"))
def w10(t):
    return mk.reading_order(marks(t)).select("job", "i", "x", "position")


@query("a30_layout", mark_sql(GRID_SQL + """, near as (select g.job, g.i, g.x, g.y, min(abs(g.y-rc.cy)) as dy, (select min(abs(g.x-cc.cx)) from cc where cc.job=g.job) as dx from g join rc on rc.job=g.job group by 1,2,3,4)
select job, max(er) as est_rows, max(ec) as est_cols, round(count(*) filter (sqrt(dx*dx+dy*dy)<=1.2*mr)/count(*),6) as layout_conf, count(*)-count(*) filter (sqrt(dx*dx+dy*dy)<=1.2*mr) as outliers
from near join med using (job) join (select job, max(row_)+1 as er, max(col_)+1 as ec from g group by 1) using (job) group by 1"""))
def a30(t):
    return r6(mk.layout(marks(t)), "layout_conf")


@query("w14_grid_holes", mark_sql(GRID_SQL + """
select rc.job, rc.row_ as row, cc.col_ as col, round(cc.cx,6) as cx, round(rc.cy,6) as cy from rc join cc on cc.job=rc.job and cc.col_>rc.lo and cc.col_<rc.hi
where not exists (select 1 from g where g.job=rc.job and g.row_=rc.row_ and g.col_=cc.col_)
and not exists (select 1 from g join cc c2 on c2.job=g.job and c2.col_=g.col_ join med on med.job=g.job where g.job=rc.job and abs(g.x-c2.cx)>0.5*mr)"""))
def w14(t):
    return r6(mk.grid_holes(marks(t)), "cx", "cy")


# --- matching, vetoes, suppression -------------------------------------------------------------------------

@query("p13_veto_proposals", mark_sql(""", coh as (select job, median(r) as mr, count(*) as n from m group by 1)
select p.job, p.i, p.x, case when exists (select 1 from m a where a.job=p.job and sqrt(power(p.x-a.x,2)+power(p.y-a.y,2))<0.85*a.r) then 'center'
 when n>=2 and not (p.r between 0.7*mr and 1.3*mr) then 'radius' end as veto from rd p left join coh using (job)"""))
def p13(t):
    return mk.veto_proposals(readings(t), marks(t)).select("job", "i", "x", "veto")


DIST = "sqrt(power({a}.x-{b}.x,2)+power({a}.y-{b}.y,2))"


def pairs_sql(limit):
    """Shortest first, each end once: a fold over the sorted candidate pairs of a page."""
    return f""",
cand as (select m.job, m.i, r.i as j, {DIST.format(a="m", b="r")} as d from m join rd r on m.job=r.job left join (select job, mr from med where mr>0) e on e.job=m.job),
pairs as (select job, unnest(p.i) as i, unnest(p.j) as j, unnest(p.d) as d from (select job, list_reduce(list({{'d': d, 'i': i, 'j': j}} order by d, i, j),
  lambda a, x: case when list_contains(a.i, x.i) or list_contains(a.j, x.j) then a
    else {{'d': list_append(a.d, x.d), 'i': list_append(a.i, x.i), 'j': list_append(a.j, x.j)}} end,
  {{'d': []::double[], 'i': []::bigint[], 'j': []::bigint[]}}) as p from cand c left join (select job, mr from med where mr>0) e using (job) where {limit} group by job))"""


NEAR = MED + pairs_sql("mr is null or d<=mr")
KNOWN = """, known as (select job from med where mr>0 and job in (select job from rd))"""


@query("j12_match_points", mark_sql(MED + pairs_sql("d<=200") + " select * from pairs"))
def j12(t):
    return spatial.match_points(marks(t), readings(t).withColumnRenamed("i", "j"), 200.0)


@query("j13_associate", mark_sql(MED + pairs_sql("true") + " select p.job, p.i, p.j, p.d, p.d<=0.75*m.r as anchored from pairs p join m on m.job=p.job and m.i=p.i"))
def j13(t):
    return mk.associate(marks(t), readings(t)).select("job", "i", "j", "d", "anchored")


@query("j19_reconcile", mark_sql(NEAR + KNOWN + f""",
far as (select g.job, g.i, g.confidence, coalesce((select min({DIST.format(a="g", b="m")}) from m where m.job=g.job), 1e9) as nn from rd g
  where not exists (select 1 from pairs p where p.job=g.job and p.j=g.i)),
need as (select job, greatest(0, count(*)-coalesce(any_value(n), 0)) as deficit from rd left join (select job, count(*) as n from m group by 1) using (job) group by 1),
ranked as (select *, row_number() over (partition by job order by nn desc, i desc) as k from far join need using (job)),
spare as (select *, row_number() over (partition by job order by nn desc, i desc) as s from ranked where k>deficit and confidence>=0.7),
ph as (select m.job, m.i, row_number() over (partition by m.job order by m.fill, m.i) as s from m join known using (job)
  where m.fill<0.5 and not exists (select 1 from pairs p where p.job=m.job and p.i=m.i))
select job, 'covered' as action, i, j from pairs union all select job, 'recovered', null, i from ranked where k<=deficit
union all select ph.job, case when spare.i is null then 'dropped' else 'swapped' end, ph.i, spare.i from ph left join spare using (job, s)"""))
def j19(t):
    return mk.reconcile(marks(t), readings(t))


@query("a32_agreement_summary", mark_sql(NEAR + KNOWN + """,
n as (select job, count(*) filter (where not is_reading) as nm, count(*) filter (where is_reading) as nr from v_mark group by 1),
s as (select job, count(*) as na, list(d order by d) as ds from pairs group by 1)
select job, coalesce(na, 0) as n_agree, ds[na//2+1] as snap_median, ds[na] as snap_max, case when known.job is not null then nm-coalesce(na, 0) end as only_marks,
  nr-coalesce(na, 0) as only_readings from n left join s using (job) left join known using (job)"""))
def a32(t):
    return mk.agreement_summary(marks(t), readings(t))


@query("j20_anchor_recovery", mark_sql(MED + """ select r.job, r.i as j from rd r join med using (job) where r.confidence>=0.7 and
 not exists (select 1 from m where m.job=r.job and sqrt(power(r.x-m.x,2)+power(r.y-m.y,2))<=mr)"""))
def j20(t):
    """Every confident reading counts as loosely linked here, so that SQL can state the result."""
    links = readings(t).select("job", c("i").alias("j"), c("x").alias("gx"), c("y").alias("gy"), "confidence", F.lit(False).alias("anchored"))
    with_marks = links.join(marks(t).select("job").distinct(), "job", "left_semi")
    return mk.anchor_recovery(with_marks, marks(t)).select("job", "j")


@query("w11_nms", on("v_mark", body=""", f as (select job, list_reduce(list({'i': i, 'x': x, 'y': y} order by r desc, i), lambda a, p: case when len(list_filter(
    range(1, len(a.i)+1), lambda k: (p.x-a.x[k])*(p.x-a.x[k])+(p.y-a.y[k])*(p.y-a.y[k])<3600))>0 then a
  else {'i': list_append(a.i, p.i), 'x': list_append(a.x, p.x), 'y': list_append(a.y, p.y)} end, {'i': []::bigint[], 'x': []::double[], 'y': []::double[]}) as a from v_mark group by job)
select v.job, v.i, v.x, v.y, v.r from v_mark v join (select job, unnest(a.i) as i from f) using (job, i)"""))
def w11(t):
    return spatial.suppress(t.view("v_mark").select("job", "i", "x", "y", "r"), "r", 60.0)


@query("w12_collapse_concentric", on("v_mark", body=""", f as (select job, list_reduce(list({'i': i, 'x': x, 'y': y, 'r': r, 'f': fill, 'k': 0::bigint} order by r desc, x, y, i),
  lambda a, p: list_transform([list_filter(range(1, len(a)+1), lambda k: sqrt(power(p.x-a[k].x,2)+power(p.y-a[k].y,2))<0.35*greatest(p.r, a[k].r))[1]],
    lambda c: case when c is null then list_append(a, p) when p.f<=a[c].f then a else list_concat(list_append(a[1:c-1], p), a[c+1:len(a)]) end)[1],
  []::struct(i bigint, x double, y double, r double, f double, k bigint)[]) as a from v_mark group by job)
select v.job, v.i, v.x, v.y, v.r, v.fill from v_mark v join (select job, unnest(list_transform(a, lambda p: p.i)) as i from f) using (job, i)"""))
def w12(t):
    return mk.collapse_concentric(t.view("v_mark").select("job", "i", "x", "y", "r", "fill"))


@query("w13_merge_marks", mark_sql(""", c as (select job, list(x) as x, list(y) as y, list(r) as r from m group by 1),
p as (select job, list({'i': i, 'x': x, 'y': y, 'r': r} order by i) as ps from rd where fill>=0.2 group by 1),
f as (select job, list_reduce(ps, lambda a, p: case when len(list_filter(range(1, len(a.x)+1), lambda k: sqrt(power(p.x-a.x[k],2)+power(p.y-a.y[k],2))<0.85*a.r[k]))>0
    or len(a.r)>=2 and not p.r between 0.7*list_median(a.r) and 1.3*list_median(a.r) then a
  else {'i': list_append(a.i, p.i), 'x': list_append(a.x, p.x), 'y': list_append(a.y, p.y), 'r': list_append(a.r, p.r)} end,
  {'i': []::bigint[], 'x': coalesce(x, []), 'y': coalesce(y, []), 'r': coalesce(r, [])}) as a from p left join c using (job))
select job, i, x, y, r, fill from m union all select rd.job, rd.i, rd.x, rd.y, rd.r, rd.fill from rd join (select job, unnest(a.i) as i from f) using (job, i)"""))
def w13(t):
    cols = ["job", "i", "x", "y", "r", "fill"]
    return mk.merge_marks(marks(t).select(*cols), readings(t).select(*cols), 0.2)


@query("s18_build_labels", mark_sql(NEAR + KNOWN + """
select 'detect_labels.v1' as schema, job, 0::bigint as part, 'pipeline/labels/' || job || '.json' as name, row_number() over (partition by job order by i)-1 as i, 'circle' as shape,
  cast(trunc(x) as int) as x, cast(trunc(y) as int) as y, cast(trunc(r) as int) as r, status as source, case when known.job is not null then j is not null end as reader_backed
from m left join pairs using (job, i) left join known using (job)"""))
def s18(t):
    out = mk.label_pages(marks(t).withColumn("source", c("status")), readings(t))
    return out.select("schema", "job", "part", "name", F.explode("circles").alias("m")).select("schema", "job", "part", "name", "m.*")
