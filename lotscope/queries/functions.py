"""Scalar functions, each applied to a whole table."""

from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import numbers as nm
from lotscope.functions import text as tx
from lotscope.queries.registry import query
from lotscope.queries.sql import CONTENT, DECADES, KEY, TEXT_KEY, TITLE_COUNT, TITLE_YEARS, TOKENS, expr, on

c = F.col
joined = lambda a: F.array_join(a, ",")
sj = lambda e: f"array_to_string({e},',')"


@query("f1_extract_years", on("v_listing", body=f"select item_id, {sj(expr(TITLE_YEARS, 'title'))} as years from v_listing"))
def f1(t):
    return t.view("v_listing").select("item_id", joined(tx.extract_years(c("title"))).alias("years"))


@query("f2_extract_decades", on("v_listing", body=f"select item_id, {sj(expr(DECADES, 'title'))} as years from v_listing"))
def f2(t):
    return t.view("v_listing").select("item_id", joined(tx.extract_decades(c("title"))).alias("years"))


@query("f3_extract_lot_count", on("v_listing", body=f"select item_id, {expr(TITLE_COUNT, 'title')} as n from v_listing"))
def f3(t):
    return t.view("v_listing").select("item_id", tx.extract_lot_count(c("title")).alias("n"))


def text_key(t, fn):
    return t.view("v_text").select("id", F.md5(fn(c("text"))).alias("key"), F.length(fn(c("text"))).alias("size"))


def text_key_sql(e):
    return on("v_text", body=f"select id, md5(k) as key, length(k) as size from (select id, {e} as k from v_text)")


@query("f4_normalize_key", text_key_sql(expr(KEY, "text")))
def f4(t):
    return text_key(t, tx.normalize_key)


@query("f5_normalize_text", text_key_sql(expr(TEXT_KEY, "text")))
def f5(t):
    return text_key(t, tx.normalize_text)


@query("f6_basic_norm", text_key_sql("regexp_replace(lower(text),'[^\\p{L}\\p{N}]','','g')"))
def f6(t):
    return text_key(t, tx.basic_norm)


@query("f7_tokenize", on("v_text", body=f"select id, len(k) as n, md5(array_to_string(k,' ')) as tokens from (select id, {expr(TOKENS, 'text')} as k from v_text)"))
def f7(t):
    return t.view("v_text").select("id", tx.tokenize(c("text")).alias("k")).select(
        "id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens"))


@query("f9_parse_price", on("v_catalogue", body="""select entry_id, coalesce(try_cast(trim(replace(price,'$','')) as double),0) as plain,
  coalesce(try_cast(trim(replace('$1,' || price,'$','')) as double),0) as with_comma from v_catalogue"""))
def f9(t):
    return t.view("v_catalogue").select("entry_id", tx.parse_price(c("price")).alias("plain"),
                                        tx.parse_price(F.concat(F.lit("$1,"), "price")).alias("with_comma"))


@query("f10_parse_price_source", on("v_reply", body="""
select id, case when ok then price end as price, case when ok then trim(p[2]) else '' end as source,
  case when ok then try_cast(case when regexp_full_match(trim(p[3]),'[+-]?[0-9]+') then trim(p[3]) end as int) end as count
from (select id, p, price, price is not null and contains(reply,'|') as ok from (
  select id, reply, string_split(reply,'|') as p,
    try_cast(replace(trim(ltrim(trim(string_split(reply,'|')[1]),'$')),',','') as double) as price from v_reply))"""))
def f10(t):
    return t.view("v_reply").select("id", tx.parse_price_source(c("reply")).alias("r")).select("id", "r.*")


ERA_SQL = """case when regexp_matches({c},'all|any|everything|both') then 'all'
  when regexp_matches({c},'central|counties|cc') then 'Central Counties'
  when contains({c},'mellon') then 'Mellon' when contains({c},'citizen') then 'Citizens' end"""


@query("f11_parse_confirmation", on("v_reply", body=f"""select id, try_cast(regexp_extract(reply,'(?:^|[^0-9])([0-9]{{1,3}})(?:[^0-9]|$)',1) as int) as count,
  {ERA_SQL.format(c='lower(reply)')} as era from v_reply"""))
def f11(t):
    return t.view("v_reply").select("id", tx.parse_confirmation(c("reply")).alias("r")).select("id", "r.*")


@query("f12_parse_era", on("v_reply", body=f"select id, {ERA_SQL.format(c='lower(reply)')} as era from v_reply"))
def f12(t):
    return t.view("v_reply").select("id", tx.parse_era(c("reply")).alias("era"))


@query("f13_era_year_set", on("v_reply", body=f"""
select id, era, array_to_string(case era when 'Central Counties' then range(1972,1984) when 'Mellon' then range(1984,2002)
  when 'Citizens' then range(2001,2027) else [] end,',') as years,
  case when coalesce(era,'')<>'Mellon' then 'Mellon' else 'Citizens' end as other_voted,
  case when coalesce(era,'')<>'Central Counties' then 'Central Counties' else 'Mellon' end as other_declared
from (select id, {ERA_SQL.format(c='lower(reply)')} as era from v_reply)"""))
def f13(t):
    ranked = F.array(F.lit("Mellon"), F.lit("Citizens"))
    r = t.view("v_reply").select("id", tx.parse_era(c("reply")).alias("era"))
    return r.select("id", "era", joined(tx.era_year_set(c("era"))).alias("years"),
                    tx.other_era(c("era"), ranked).alias("other_voted"),
                    tx.other_era(c("era"), F.array().cast("array<string>")).alias("other_declared"))


SCORED = "select item_id, k1, k2, k3, k4, overall, case when k4=1 then null else image_score end as gap from v_match"


def scored(t):
    return t.view("v_match").select("item_id", "k1", "k2", "k3", "k4", "overall", "image_score",
                                    F.when(c("k4") != 1, c("image_score")).alias("gap"))


@query("f14_norm_sim", on("v_match", body="select item_id, k1, k2, k3, k4, round(greatest(0,least(1,(image_score-0.15)/0.2)),6) as score from v_match"))
def f14(t):
    return scored(t).select("item_id", "k1", "k2", "k3", "k4", F.round(nm.norm_sim(c("image_score")), 6).alias("score"))


@query("f15_tier", on("v_match", body=f"""select item_id, k1, k2, k3, k4, case when overall>=0.82 or coalesce(gap>=0.12,false) then 'green'
  when overall<0.65 then 'red' else 'yellow' end as tier from ({SCORED})"""))
def f15(t):
    return scored(t).select("item_id", "k1", "k2", "k3", "k4", nm.tier(c("overall"), c("gap")).alias("tier"))


@query("f16_is_confirmed", on("v_match", body=f"select item_id, k1, k2, k3, k4, overall>=0.85 or overall>=0.82 or coalesce(gap>=0.12,false) as ok from ({SCORED})"))
def f16(t):
    return scored(t).select("item_id", "k1", "k2", "k3", "k4", nm.is_confirmed(c("overall"), c("gap")).alias("ok"))


@query("f17_is_confirmed_guarded", on("v_match", body=f"""select item_id, k1, k2, k3, k4,
  not (coalesce(gap<0.05,true) and overall<0.9) and (overall>=0.82 or coalesce(gap>=0.12,false)) as ok from ({SCORED})"""))
def f17(t):
    return scored(t).select("item_id", "k1", "k2", "k3", "k4", nm.is_confirmed_guarded(c("overall"), c("gap")).alias("ok"))


@query("f18_label_years", on("v_label", body="""
select id, coalesce(try_cast(case when regexp_full_match(trim(label),'[+-]?[0-9]+') then trim(label) end as int),
    try_cast(regexp_extract(label,'([0-9]{4})',1) as int)) as year_int,
  case when length(d)>=4 then left(d,4) else trim(label) end as year4,
  try_cast(case when regexp_full_match(string_split(label,' ')[1],'[0-9]+') then string_split(label,' ')[1] end as int) as label_year,
  trim(substr(label, length(string_split(label,' ')[1])+1)) as phrase
from (select *, regexp_replace(label,'[^0-9]','','g') as d from v_label)"""))
def f18(t):
    return t.view("v_label").select("id", tx.year_int(c("label")).alias("year_int"), tx.year4(c("label")).alias("year4"),
                                    tx.label_year(c("label")).alias("label_year"), tx.label_phrase(c("label")).alias("phrase"))


@query("f19_synth_id", on("v_listing", body="""select item_id, 'backfill|' || left(md5(seller || chr(0) || title),16) as synth,
  item_id%7=0 as synthetic from v_listing"""))
def f19(t):
    ids = t.view("v_listing").select("item_id", tx.synth_id(c("seller"), c("title")).alias("synth"))
    given = F.when(c("item_id") % 7 == 0, c("synth")).otherwise(c("item_id").cast("string"))
    return ids.select("item_id", "synth", tx.is_synthetic(given).alias("synthetic"))


@query("f20_buying_format", on("v_listing", body="select item_id, fmt as format from v_listing"))
def f20(t):
    options = F.when(c("fmt") == "auction", F.array(F.lit("FIXED_PRICE"), F.lit("AUCTION"))) \
        .when(c("fmt") == "fixed", F.array(F.lit("FIXED_PRICE")))
    return t.view("v_listing").select("item_id", nm.buying_format(options).alias("format"))


@query("f21_price_band", on("v_obs", body="""select seq, case when value<5 then '<5' when value<15 then '5-15' when value<30 then '15-30'
  when value<75 then '30-75' else '75+' end as band from v_obs"""))
def f21(t):
    return t.view("v_obs").select("seq", nm.price_band(c("value")).alias("band"))


RESTRICT_YEARS = """,
restricted as (select item_id, case when search_year is not null then list_sort(list_distinct(list_concat([search_year], decades)))
  when search_era is not null then case search_era when 'Mellon' then range(1984,2002) else range(2001,2027) end
  when len(decades)>0 then decades
  when len(years)=1 and years[1] in (select year from v_image_bank) then years end as years
from (select item_id, case when fmt='auction' and condition='BUILDING' then 1989 end as search_year,
  case condition when 'MACHINERY' then 'Mellon' when 'FURNITURE' then 'Citizens' end as search_era,
  %s as years, %s as decades from v_listing))""" % (expr(TITLE_YEARS, "title"), expr(DECADES, "title"))


def restrictions(t):
    """Years that each listing may be matched against, the image bank's years being the known ones."""
    year = F.when((c("fmt") == "auction") & (c("condition") == "BUILDING"), F.lit(1989))
    era = F.when(c("condition") == "MACHINERY", "Mellon").when(c("condition") == "FURNITURE", "Citizens")
    years, decades = tx.extract_years(c("title")), tx.extract_decades(c("title"))
    facts = t.view("v_listing").select("item_id", year.alias("y"), era.alias("e"), years.alias("ty"), decades.alias("td"), F.get(years, F.lit(0)).alias("first"))
    known = t.view("v_image_bank").select(c("year").cast("int").alias("first"), F.lit(True).alias("known")).distinct()
    facts = facts.join(known, "first", "left")
    return facts.select("item_id", nm.restrict_years(c("y"), c("e"), c("ty"), c("td"), F.coalesce("known", F.lit(False))).alias("years"))


@query("f38_restrict_years", on("v_listing", "v_image_bank", body="").rstrip() + RESTRICT_YEARS + " select item_id, array_to_string(years, ',') as years from restricted")
def f38(t):
    return restrictions(t).select("item_id", joined(c("years")).alias("years"))


@query("f40_rerank_delta", on("v_match", body="""select item_id, k1, k2, k3, k4,
  round(greatest(-1,least(1,(overall-0.5)*4))*0.05 + greatest(-1,least(1,image_score-0.3))*0.05,6) as delta from v_match"""))
def f40(t):
    return scored(t).select("item_id", "k1", "k2", "k3", "k4",
                            F.round(nm.rerank_delta((c("overall") - 0.5) * 4, c("image_score") - 0.3), 6).alias("delta"))


CRC = ("list_reduce(list_transform(string_split({c},''), lambda x: cast(ord(x) as bigint)), lambda a, b: "
       "list_reduce([0,1,2,3,4,5,6,7]::bigint[], lambda d, k: xor(d >> 1, case when d % 2 = 1 then 3988292384::bigint else 0::bigint end), "
       "xor(a, b)), 4294967295::bigint)")


@query("f41_shard_of", on("v_listing", body="select cast(xor(crc, 4294967295) % 4 as int) as shard, count(*) as n from (select "
       + CRC.replace("{c}", "name") + " as crc from (select 'pipeline/input/' || item_id || '.png' as name from v_listing)) group by 1"))
def f41(t):
    names = t.view("v_listing").select(F.concat(F.lit("pipeline/input/"), c("item_id"), F.lit(".png")).alias("name"))
    return names.groupBy(tx.shard_of(c("name"), 4).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("f42_log_cells", on("v_obs", body="""select seq, round(value/7,5) as cell, strftime(ts,'%Y-%m-%dT%H:%M:%S') as iso,
  'pipeline/labels/' || replace(source || '/' || item_id,'/','_') || '.json' as label_name from v_obs"""))
def f42(t):
    from lotscope.sources.sinks import label_name
    return t.view("v_obs").select("seq", nm.round_or_null(c("value") / 7).alias("cell"),
                                  F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                                  label_name(F.concat_ws("/", "source", "item_id")).alias("label_name"))


@query("u2_union_years", on("v_listing", body=f"""select item_id,
  {sj('list_sort(list_distinct(list_concat(y, d)))')} as years from (select item_id, {expr(TITLE_YEARS, 'title')} as y, {expr(DECADES, 'title')} as d from v_listing)"""))
def u2(t):
    both = F.array_sort(F.array_union(tx.extract_years(c("title")), tx.extract_decades(c("title"))))
    return t.view("v_listing").select("item_id", joined(both).alias("years"))


@query("p3_exclude_keywords", on("v_listing", body="select item_id from v_listing where not regexp_matches(lower(title), '"
       + "|".join(S.EXCLUDED_KEYWORDS) + "')"))
def p3(t):
    from lotscope.operators.filters import exclude_keywords
    return exclude_keywords(t.view("v_listing")).select("item_id")


@query("p3_exclude_keywords_text", on("v_text", body="select id from v_text where not regexp_matches(lower(text), '"
       + "|".join(S.EXCLUDED_KEYWORDS) + "')"))
def p3_text(t):
    from lotscope.operators.filters import exclude_keywords
    return exclude_keywords(t.view("v_text"), title="text").select("id")


@query("p4_non_alerting", on("v_log_line", body="select event_id from v_log_line where contains(lower(payload),'slogan 5')"))
def p4(t):
    return t.view("v_log_line").where(tx.is_non_alerting(c("payload"), ("SLOGAN 5",))).select("event_id")
