"""Rules, catalogue, coverage, attractors and similar slogans."""

from pyspark.sql import functions as F

from lotscope.functions import numbers as nm
from lotscope.functions import text as tx
from lotscope.operators import filters, rules
from lotscope.operators.records import best_first
from lotscope.plans.ranked import top_k
from lotscope.queries.market import scan_records
from lotscope.queries.registry import query
from lotscope.queries.sql import CONTENT, KEY, TOKENS, expr, on, scan

c = F.col
K = lambda col: expr(KEY, col)


def rule_table(t):
    sheet = t.view("v_rules")
    return rules.load_rules(sheet.toDF(*["seq" if n == "seq" else f" {n.replace('_', ' ').title()} " for n in sheet.columns]))


RULES = """,
clean as (select seq, trim(year) as year, trim(slogan) as slogan, max_price_single, max_price_year, notes, amount_needed from v_rules where trim(slogan)<>''),
rules as (select year, slogan, min(seq) as first_seq, arg_max(max_price_single,seq) as max_price_single, arg_max(max_price_year,seq) as max_price_year,
  arg_max(notes,seq) as notes, arg_max(amount_needed,seq) as amount_needed from clean group by 1,2)"""
LOOSE = RULES + f""",
loose as (select * from (select *, {K('slogan')} as key, row_number() over (partition by year, {K('slogan')} order by first_seq) as rn from rules) where rn=1),
looked as (select m.*, coalesce(r.max_price_single, l.max_price_single, '') as max_price_single, coalesce(r.notes, l.notes, '') as notes,
  case when coalesce(r.amount_needed, l.amount_needed)='2' then 2 when coalesce(r.amount_needed, l.amount_needed)='0' then 0 else 0 end as amount_needed
  from v_match m left join rules r on r.year=cast(m.year as string) and r.slogan=m.slogan
  left join loose l on l.year=cast(m.year as string) and l.key={K('m.slogan')})"""
IDS = "item_id, k1, k2, k3, k4"
ids = ["item_id", "k1", "k2", "k3", "k4"]


@query("s8_load_rules", on("v_rules", body="").rstrip() + RULES + " select * from rules")
def s8(t):
    return rule_table(t)


@query("j1_lookup_rule", on("v_rules", "v_match", body="").rstrip() + LOOSE + f" select {IDS}, max_price_single, notes, amount_needed from looked")
def j1(t):
    return rules.lookup_rule(t.view("v_match").drop("needed"), rule_table(t)).select(*ids, "max_price_single", "notes", "amount_needed")


@query("p10_needed_hits", on("v_rules", "v_match", body="").rstrip() + LOOSE + f" select {IDS}, max_price_single from looked where amount_needed>0 and overall>=0.82")
def p10(t):
    confirmed = t.view("v_match").where(nm.is_confirmed(c("overall"), F.lit(None).cast("double"))).drop("needed")
    return filters.needed_hits(rules.lookup_rule(confirmed, rule_table(t))).select(*ids, "max_price_single")


@query("a26_needed_years", on("v_rules", body="").rstrip() + RULES + " select distinct cast(year as int) as year from rules where amount_needed='2'")
def a26(t):
    return rules.needed_years(rule_table(t))


@query("j21_year_queries", on("v_rules", body="").rstrip() + RULES + """
select term || ' ' || year as query, cast(year as int) as year from (select distinct year from rules where amount_needed='2'),
 (select unnest(['Penn State button','Penn State pin','Nittany Lions badge']) as term)""")
def j21(t):
    return rules.year_queries(rules.needed_years(rule_table(t)), ["Penn State button", "Penn State pin", "Nittany Lions badge"]).drop("term_no")


@query("j21_era_queries", """select p || ' ' || n_name || ' ' || ty as query, r_name as era from nation join region on n_regionkey=r_regionkey,
 (select unnest(['Penn State','PSU','Nittany Lions']) as p), (select unnest(['button','pin','badge','pinback']) as ty)""")
def j21_era(t):
    words = t.table("nation").join(t.table("region"), c("n_regionkey") == c("r_regionkey")).select(c("n_name").alias("word"), c("r_name").alias("era"))
    return rules.era_queries(words)


COV = on("v_rules", "v_match", "v_label", body="").rstrip() + RULES + f""",
texts as (select distinct try_cast(case when regexp_full_match(string_split(label,' ')[1],'[0-9]+') then string_split(label,' ')[1] end as int) as year,
  {K("trim(substr(label, length(string_split(label,' ')[1])+1))")} as key from v_label),
images as (select distinct year, {K('slogan')} as key from v_match),
flags as (select year, slogan, exists(select 1 from texts v where cast(v.year as string)=r.year and v.key={K('r.slogan')}) as in_text,
  exists(select 1 from images v where cast(v.year as string)=r.year and v.key={K('r.slogan')}) as in_image from rules r where amount_needed='2')
select year, slogan, in_text, in_image, not in_text and not in_image as fully_missing, not in_text as no_text from flags"""


@query("j3_coverage", COV)
def j3(t):
    needed = rule_table(t).where(tx.amount_needed(c("amount_needed")) > 0)
    texts = t.view("v_label").select(tx.label_year(c("label")).alias("year"), tx.label_phrase(c("label")).alias("slogan"))
    return rules.coverage(needed, texts, t.view("v_match"))


DIFF = f""", a as (select distinct year, {K('slogan')} as key from v_match), b as (select distinct year, {K('slogan')} as key from v_catalogue),
d as (select *, 'left' as side from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a))"""


@query("u3_key_diff", on("v_match", "v_catalogue", body="").rstrip() + DIFF + " select * from d")
def u3(t):
    return rules.key_diff(t.view("v_match"), t.view("v_catalogue"))


@query("j16_staleness", on("v_match", "v_catalogue", body="").rstrip() + DIFF + " select count(*) filter (side='left') as stale, count(*) filter (side='right') as pending from d")
def j16(t):
    return rules.staleness(t.view("v_match"), t.view("v_catalogue"))


@query("j17_entry_id", on("v_match", "v_catalogue", body=f"""
, ids as (select year, {K('slogan')} as key, cast(max(entry_id) as string) as id from v_catalogue group by 1,2)
select {IDS}, case when m.k4=1 then '_year_unknown' else coalesce(i.id, '_year_' || m.year) end as entry
from v_match m left join ids i on i.year=m.year and i.key={K('m.slogan')}"""))
def j17(t):
    m = t.view("v_match").withColumn("year", F.when(c("k4") == 1, "unreadable").otherwise(F.concat_ws(" ", "year", F.lit("(x)"))))
    return rules.entry_id(m, t.view("v_catalogue")).select(*ids, "entry")


@query("a18_slogan_years", on("v_catalogue", body=f"select {K('slogan')} as key, string_agg(distinct year, ',' order by year) as years from v_catalogue group by 1"))
def a18(t):
    return rules.slogan_years(t.view("v_catalogue")).withColumn("years", F.array_join("years", ","))


# an edition is a slogan with brand and type; candidates carry both in their type
EDITION, NAME = "slogan || ' ' || brand || ' ' || type", "slogan || ' ' || type"
edition_name = lambda: F.concat_ws(" ", "slogan", "type")  # a function, as modules load without a session
TWINS = f", fam as (select {K('slogan')} || type as key, count(*) as n_editions from v_catalogue group by 1 having count(*)>=2)"


def editions(t):
    return t.view("v_catalogue").withColumn("slogan", F.concat("slogan", F.lit(" "), "type"))


@query("a19_twin_registry", on("v_catalogue", body=f"select {K('slogan || type')} as key, count(*) as n_editions from v_catalogue group by 1 having count(*)>=2"))
def a19(t):
    return rules.twin_registry(editions(t))


@query("a19_registry_summary", on("v_catalogue", body=f"select count(*) as n_families, cast(sum(n) as bigint) as n_entries from (select count(*) as n from v_catalogue group by {K('slogan || type')} having count(*)>=2)"))
def a19_sum(t):
    return rules.registry_summary(rules.twin_registry(editions(t)))


FAMILIES = f"fam as (select {K(EDITION)} as key from v_catalogue group by 1 having count(*)>=2)"


def registry(t):
    """Slogans of one brand and type that the catalogue lists more than once."""
    return rules.twin_registry(t.view("v_catalogue").withColumn("slogan", F.concat_ws(" ", "slogan", "brand", "type")))


@query("j6_twin_guard", on("v_named", "v_catalogue", body=f"""
, {FAMILIES} select job as item_id, k1, k2, k3, k4, {K(NAME)} in (select key from fam) as is_twin from v_named"""))
def j6(t):
    named = t.view("v_named").withColumnRenamed("job", "item_id")
    return rules.twin_guard(named, registry(t), edition_name()).select(*ids, "is_twin")


def games(t):
    return t.view("v_catalogue").withColumn("game_year", F.when(c("type") == "ECONOMY", c("year") + 1))


@query("j15_with_game_year", on("v_match", "v_catalogue", body=f"""
, g as (select distinct {K('slogan')} as key, year, year+1 as game_year from v_catalogue where type='ECONOMY')
select {IDS}, g.game_year from v_match m left join g on g.key={K('m.slogan')} and g.year=m.year"""))
def j15(t):
    return rules.with_game_year(t.view("v_match"), games(t)).select(*ids, "game_year")


@query("j18_resolve_printed_year", on("v_match", "v_catalogue", body=f"""
, e as (select {K('slogan')} as key, entry_id, year, year as marker from v_catalogue union all
  select {K('slogan')}, entry_id, year, year+1 from v_catalogue where type='ECONOMY'),
u as (select key, marker, max(entry_id) as edition, max(year) as edition_year from e group by 1,2 having count(*)=1)
select {IDS}, u.edition, u.edition_year from v_match m left join u on u.key={K('m.slogan')} and u.marker=m.year"""))
def j18(t):
    readings = t.view("v_match").withColumnRenamed("year", "printed_year")
    return rules.resolve_printed_year(readings, games(t)).select(*ids, "edition", "edition_year")


@query("f25_marker_matches", on("v_match", "v_catalogue", body=f"""
select {IDS}, coalesce(p=year,false) or coalesce(p=g,false) as ok from (select *, case when k4<>2 then 1993+cast(k1%6 as int) end as p,
 case when needed=1 then year+1 end as g from v_match)"""))
def f25(t):
    printed = F.when(c("k4") != 2, 1993 + (c("k1") % 6).cast("int"))
    game = F.when(c("needed") == 1, c("year") + 1)
    return t.view("v_match").select(*ids, nm.marker_matches(c("year"), game, printed).alias("ok"))


@query("a17_token_df", on("v_text", body=f"select token, count(*) as df from (select unnest(list_distinct({expr(TOKENS, 'text')})) as token from v_text) group by 1"))
def a17(t):
    return rules.token_df(t.view("v_text"), "text")


RARITY = f""", df as (select token, count(*) as df from (select unnest(list_distinct({expr(TOKENS, 'slogan')})) as token from v_catalogue) group by 1),
rarity as (select phrase, least(0.04*avg(1.0/(df*df)),0.04) as bonus from (
  select phrase, unnest({expr(CONTENT, 'phrase')}) as token from (select distinct slogan as phrase from v_catalogue)) join df using (token) group by 1)"""


@query("f8_rarity_bonus", on("v_catalogue", body="").rstrip() + RARITY + " select phrase, round(bonus,10) as bonus from rarity")
def f8(t):
    cat = t.view("v_catalogue")
    return rules.rarity_bonus(cat.select(c("slogan").alias("phrase")), rules.token_df(cat, "slogan")).withColumn("bonus", F.round("bonus", 10))


@query("j9_slogan_peers", on("v_catalogue", body=f"""
, ent as (select min(entry_id) as idx, year, {K('slogan')} as key, any_value(slogan) as phrase from v_catalogue group by 2,3),
tok as (select idx, year, unnest({expr(CONTENT, 'phrase')}) as token from ent),
pr as (select a.idx, b.idx as peer, cast(count(*) as int) as shared from tok a join tok b using (token) where a.year<>b.year group by 1,2)
select * from (select *, row_number() over (partition by idx order by shared desc, peer) as rank from pr) where rank<=10"""))
def j9(t):
    entries = rules.identity(t.view("v_catalogue")).groupBy("year", "key").agg(F.min("entry_id").alias("idx"), F.min_by("slogan", "entry_id").alias("phrase"))
    return rules.slogan_peers(entries)


@query("u4_shared_tokens", on("v_match", "v_catalogue", body=f"""
select {IDS}, len(list_intersect({expr(CONTENT, 'm.slogan')}, {expr(CONTENT, 'v.slogan')})) as shared
from v_match m join v_catalogue v on v.entry_id=m.k2"""))
def u4(t):
    other = t.view("v_catalogue").select(c("entry_id").alias("k2"), c("slogan").alias("other"))
    both = F.array_intersect(tx.content_tokens(c("slogan")), tx.content_tokens(c("other")))
    return t.view("v_match").join(other, "k2").select(*ids, F.size(both).cast("bigint").alias("shared"))


TOP5 = """, top5 as (select * from (select *, row_number() over (partition by item_id order by overall desc, k1, k2, k3, k4, year) as rk from v_match) where rk<=5)"""


def top5(t):
    return top_k(t.view("v_match"), ["item_id"], best_first(), 5)


@query("a10_attractors", on("v_match", body="").rstrip() + TOP5 + " select year, slogan, count(*) as n from top5 group by 1,2 order by n desc, year, slogan limit 25")
def a10(t):
    return rules.attractors(top5(t))


@query("a10_attractor_slogans", on("v_match", body="").rstrip() + TOP5 + " select slogan, count(distinct item_id) as n_items from top5 group by 1 order by n_items desc, slogan limit 25")
def a10_slogans(t):
    return rules.attractor_slogans(top5(t))


@query("a11_degenerate", on("v_match", body="").rstrip() + TOP5 + " select item_id from top5 group by 1 having count(*)>=2 and count(distinct slogan)=1")
def a11(t):
    return rules.degenerate(top5(t))


@query("a11_zero_score", scan("select item_id from v_scan where best_score=0"))
def a11_zero(t):
    return rules.zero_score(scan_records(t))
