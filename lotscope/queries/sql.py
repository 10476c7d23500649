"""SQL building blocks for the checks (DuckDB)."""

from lotscope.bindings import ctes, view_sql

TITLE_YEARS = ("list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array({c},'[^0-9]+'), "
               "lambda p: regexp_full_match(p,'(19|20)[0-9][0-9]')), lambda p: cast(p as int))))")
_UNITS = "(?:button|pin|badge|pinback|pinbacks|pins|buttons|badges|pc|pcs|piece|pieces)"
TITLE_COUNT = ("list_max(list_filter(list_transform(list_concat("
               "regexp_extract_all({c},'(?i)(?:lot|set|group|grouping|collection)\\s+of\\s+\\(?([0-9]{{1,3}})',1),"
               "regexp_extract_all({c},'(?i)(?:^|[^0-9])([0-9]{{1,3}})\\s*\\+?\\s*" + _UNITS + "\\b',1),"
               "regexp_extract_all({c},'(?i)\\(([0-9]{{1,3}})\\)\\s*(?:button|pin|badge|pinback|pc|pcs|piece)',1)),"
               "lambda x: cast(x as int)), lambda x: x > 0))")
DECADES = ("list_sort(list_distinct(flatten(list_transform(list_concat("
           "list_transform(regexp_extract_all({c},'(?i)(?:^|[^0-9])((?:19|20)[0-9])0''?s\\b',1), lambda d: cast(d as int)*10),"
           "list_transform(regexp_extract_all({c},'(?i)(?:^|[^0-9''])''?([0-9])0s\\b',1), "
           "lambda d: case when cast(d as int)>=7 then 1900 else 2000 end + cast(d as int)*10)),"
           "lambda s: range(s, s+10)))))")
KEY = "regexp_replace(lower({c}),'[^\\p{{L}}\\p{{N}}_]','','g')"
TEXT_KEY = "trim(regexp_replace(lower({c}),'[^\\p{{L}}\\p{{N}}_\\s]','','g'))"
TOKENS = ("list_filter(regexp_split_to_array(lower(replace(replace({c},'''',''),'’','')),'[^\\p{{L}}\\p{{N}}_]+'), "
          "lambda w: regexp_full_match(w,'[a-z0-9]+'))")
STOP = "['a','an','the','and','or','in','on','at','to','for','of','its','is']"
CONTENT = "list_filter(list_distinct(" + TOKENS + "), lambda w: not list_contains(" + STOP + ", w))"


def expr(template: str, column: str) -> str:
    return template.format(c=column)


MATCH_ORDER = "overall desc, k1, k2, k3, k4, year"

# scan records derived by SQL: one row per listing
SCAN = f""",
yc as (select item_id, year, count(*) as n from v_match group by 1,2),
ycs as (select item_id, count(*) as n_years, min(year) as only_year, cast(sum(n) as bigint) as crops from yc group by 1),
best as (select item_id, max(overall) as best_score from v_match group by 1),
v_scan as (
  select l.*, {expr(TITLE_COUNT, 'title')} as title_count, {expr(TITLE_YEARS, 'title')} as title_years,
         coalesce(n_years,0) as n_years, only_year, coalesce(crops,0) as crops, coalesce(best_score,0) as best_score
  from v_listing l left join ycs using (item_id) left join best using (item_id)),
v_derived as (
  select *, coalesce(nullif(cast(title_count as bigint),0), nullif(crops,0), 1) as unit_count,
         case when len(title_years)=1 then cast(title_years[1] as string)
              when n_years=1 then cast(only_year as string) end as single_year
  from v_scan),
comp as (select single_year as year, asking/unit_count as cost, unit_count from v_derived
         where asking>0 and single_year is not null),
supply as (select cast(year as string) as year, count(*) as supply from yc group by 1)"""


def scan(body: str) -> str:
    return ctes("v_match", "v_listing") + SCAN + "\n" + body


def on(*views: str, body: str) -> str:
    return ctes(*views) + "\n" + body
