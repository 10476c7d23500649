"""Composition, scan records and the market report."""

from pyspark.sql import functions as F

from lotscope.operators import market, records
from lotscope.queries.registry import query
from lotscope.queries.sql import on, scan


def scan_records(t):
    return records.scan_record(t.view("v_match"), t.view("v_listing"))


def compositions(t):
    return records.composition_record(t.view("v_match"), t.view("v_listing"))


def r6(name, alias=None):
    return F.round(name, 6).alias(alias or name)


@query("a2_year_counts", on("v_match", body="select item_id, year, count(*) as n from v_match group by 1,2"))
def a2(t):
    return records.year_counts(t.view("v_match"))


COST_SQL = """
select year, count(*) as n, round(median(cost),6) as median, round(min(cost),6) as min, round(max(cost),6) as max,
  case when count(*)>=4 then round(qa25,6) end as p25, case when count(*)>=4 then round(qa75,6) end as p75,
  cast(floor(median(unit_count)) as bigint) as median_lot, coalesce(any_value(supply),0) as supply
from (select c.*, s.supply, q.qa25, q.qa75 from comp c left join supply s using (year) left join (
   select year, (v[j1]*(4-d1)+v[j1+1]*d1)/4 as qa25, (v[j3]*(4-d3)+v[j3+1]*d3)/4 as qa75 from (
     select *, (n+1)-j1*4 as d1, 3*(n+1)-j3*4 as d3 from (
       select year, n, v, greatest(1,least((n+1)//4,n-1)) as j1, greatest(1,least(3*(n+1)//4,n-1)) as j3 from (
         select year, count(*) as n, list(cost order by cost) as v from comp group by 1)))) q using (year))
group by year, qa25, qa75"""


@query("a3_cost_per_unit", scan(COST_SQL))
def a3(t):
    out = market.cost_per_unit(compositions(t))
    return out.select("year", "n", *[r6(c) for c in ("median", "min", "max", "p25", "p75")], "median_lot", "supply")


@query("a3_cost_per_unit_min_comps", scan(COST_SQL + " having count(*) >= 250"))
def a3_min(t):
    out = market.cost_per_unit(compositions(t), min_comps=250)
    return out.select("year", "n", *[r6(c) for c in ("median", "min", "max", "p25", "p75")], "median_lot", "supply")


@query("a4_supply_by_year", scan("select year, supply from supply"))
def a4(t):
    return market.supply_by_year(compositions(t))


@query("a4_no_comp_years", scan("select year from supply where year not in (select year from comp group by 1 having count(*) >= 250)"))
def a4_none(t):
    return market.no_comp_years(compositions(t), min_comps=250)


@query("a5_supply_summary", on("v_listing", body="""
select count(*) as n, count(*) filter (fmt='auction') as auction, count(*) filter (fmt='fixed') as fixed,
  count(*) filter (fmt='unknown') as unknown, count(distinct seller) as distinct_sellers,
  count(*) filter (asking>0) as ask_n, round(median(asking) filter (asking>0),6) as ask_median,
  min(asking) filter (asking>0) as ask_min, max(asking) filter (asking>0) as ask_max from v_listing"""))
def a5(t):
    out = market.supply_summary(t.view("v_listing"))
    return out.withColumn("ask_median", F.round("ask_median", 6))


@query("a5_supply_bands", on("v_obs", body="""
select case when asking<5 then '<5' when asking<15 then '5-15' when asking<30 then '15-30' when asking<75 then '30-75'
  else '75+' end as band, count(*) as n from v_obs where asking>0 group by 1"""))
def a5_bands(t):
    return market.supply_bands(t.view("v_obs"))


@query("l2_top_sellers", on("v_listing", body="select seller, count(*) as n from v_listing group by 1 order by n desc, seller limit 8"))
def l2(t):
    return market.top_sellers(t.view("v_listing"))


@query("a23_scan_record", scan("""
, top as (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match),
need as (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match where needed>0)
select s.item_id, s.title, s.asking, s.title_count, array_to_string(s.title_years,',') as title_years, s.crops as crops_scored,
  round(s.best_score,6) as best_score, coalesce(c.comp,'') as year_counts, coalesce(m.tops,'') as top_matches,
  n.year || ' ' || n.slogan as best_needed, n.item_id is not null as needed_hit
from v_scan s
left join (select item_id, string_agg(year || ':' || n, ',' order by year) as comp from yc group by 1) c using (item_id)
left join (select item_id, string_agg(year || ' ' || slogan, '; ' order by rk) as tops from top where rk<=5 group by 1) m using (item_id)
left join (select * from need where rk=1) n on n.item_id=s.item_id"""))
def a23(t):
    r = scan_records(t)
    pairs = F.transform(F.array_sort(F.map_entries("year_counts")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return r.select("item_id", "title", "asking", "title_count", F.array_join("title_years", ",").alias("title_years"),
                    "crops_scored", F.round("best_score", 6).alias("best_score"),
                    F.array_join(pairs, ",").alias("year_counts"),
                    F.array_join(F.transform("top_matches", lambda m: F.concat_ws(" ", m["year"], m["slogan"])), "; ").alias("top_matches"),
                    F.when(F.col("needed_hit"), F.concat_ws(" ", "best_needed.year", "best_needed.slogan")).alias("best_needed"), "needed_hit")
