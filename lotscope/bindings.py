"""Domain views over the parquet tables, one SQL text per view for both engines.

``{table}`` names a parquet table. Every view uses whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

VIEWS = {
    # scored entities per item
    "v_match": """
select l_orderkey as item_id, cast(year(l_shipdate) as int) as year, p_name as slogan, p_brand as type,
       l_quantity/50 as overall, l_discount*10 as image_score, p_retailprice as price,
       cast(p_partkey%4 as int) as needed, l_partkey as k1, l_suppkey as k2, l_extendedprice as k3,
       l_linenumber as k4
from {lineitem} join {part} on l_partkey=p_partkey""",
    # listings
    "v_listing": """
select o_orderkey as item_id,
       'Lot of ' || o_orderkey%120 || ' pins ' || year(o_orderdate)
         || case o_custkey%5 when 0 then ' 1990s' when 1 then ' (12) buttons' when 2 then ' ''80s shirt' else '' end as title,
       o_totalprice as asking, c_name as seller,
       case o_orderstatus when 'P' then 'auction' when 'O' then 'fixed' else 'unknown' end as fmt,
       c_mktsegment as condition, o_orderdate as ordered
from {orders} join {customer} on o_custkey=c_custkey""",
    # repeated observations of items
    "v_obs": """
select user_id as item_id, ts, event_type as source, case when event_type='purchase' then value end as asking,
       event_id as seq, event_type='error' as synthetic, value from {events}""",
    # reference banks: every vector is a crop to match and a reference photo of another item
    "v_image_bank": """
select vec_id as ref_id, 1990+label as year, 'Slogan ' || vec_id%7 as phrase, vec_id%7 as slogan_key, embedding
from {embeddings}""",
    "v_text_bank": """
select vec_id as entry_id, cast(1990+vec_id%12 as int) as year, 'Slogan ' || vec_id%7 as phrase,
       case when vec_id%3=0 then 'Basketball' else 'Football' end as type, embedding
from {embeddings}""",
    # history with real and stand-in ids, some missing
    "v_hist": """
select event_id as seq, case when event_type='error' then 'backfill|' || event_id%400
         when event_id%11=0 then null else 'v1|' || user_id end as item_id,
       'Seller ' || user_id%13 as seller,
       case when event_type='error' then 'lot of ' || (user_id+event_id%3*60) || '!' else 'Lot of ' || user_id end as title,
       case when event_type='purchase' then value end as asking,
       case event_type when 'click' then 'auction' when 'view' then 'fixed' else 'unknown' end as buying_format,
       cast(ts as string) as observed_at, event_type as source, value as best_score
from {events}""",
    "v_catalogue": """
select p_partkey as entry_id, p_name as slogan, 1960+p_size as year, p_type as type,
       '$' || p_retailprice as price, cast(p_partkey%4 as int) as needed, p_brand as brand
from {part}""",
    # price rules as a sheet delivers them: all text, blanks, repeats, spelling variants
    "v_rules": """
select p_partkey as seq, ' ' || (1960+p_size) || ' ' as year,
       case when p_partkey%50=0 then ' ' when p_partkey%3=0 then upper(p_name) || '!' else p_name end as slogan,
       '$' || p_retailprice as max_price_single, cast(p_retailprice*3 as string) as max_price_year, p_brand as notes,
       case p_partkey%5 when 0 then '' when 1 then '2' when 2 then '3.0' when 3 then '0' else 'x' end as amount_needed
from {part}""",
    # candidates per crop of a job
    "v_cand": """
select l_orderkey as job, cast(l_linenumber%2 as int) as crop, split_part(p_name,' ',2) as slogan,
       cast(year(l_shipdate) as int) as year, p_brand as type, l_quantity/50 as overall, l_discount*10 as image_score,
       case when p_type='ECONOMY' then cast(year(l_shipdate)+1 as int) end as game_year,
       l_partkey as k1, l_suppkey as k2, l_extendedprice as k3, l_linenumber as k4
from {lineitem} join {part} on l_partkey=p_partkey""",
    # the same candidates under their full names; the type tells editions of one slogan apart
    "v_named": """
select l_orderkey as job, cast(l_linenumber%2 as int) as crop, p_name as slogan, cast(year(l_shipdate) as int) as year,
       p_brand || ' ' || p_type as type, l_quantity/50 as overall, l_partkey as k1, l_suppkey as k2, l_extendedprice as k3, l_linenumber as k4
from {lineitem} join {part} on l_partkey=p_partkey""",
    # one second reading per crop
    "v_reading": """
select job, crop, slogan, confidence, flagged, anchored, printed_year from (
  select l_orderkey as job, cast(l_linenumber%2 as int) as crop,
         case when p_size%7=0 then 'unlisted words' else upper(split_part(p_name,' ',2)) end as slogan,
         case when l_linenumber<>5 then l_discount*10 end as confidence, p_size%11=0 as flagged, l_tax<0.07 as anchored,
         case when l_returnflag='R' then cast(year(l_shipdate)+p_size%2 as int) end as printed_year,
         row_number() over (partition by l_orderkey, l_linenumber%2 order by l_partkey, l_suppkey, l_extendedprice, l_linenumber) as rn
  from {lineitem} join {part} on l_partkey=p_partkey) where rn=1""",
    # marks on a page, and readings of the same page by a second reader
    "v_mark": """
select l_orderkey as job, cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice,
         l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as bigint) as i, l_extendedprice%800 as x,
       l_quantity*12 as y, 20+l_discount*200 as r, l_tax*10 as fill, l_returnflag='N' as is_reading,
       l_linestatus as status, l_discount*10 as confidence, l_linenumber as line
from {lineitem}""",
    # graded counts: what the detector selected, and what a reader counted
    "v_graded": """
select o_orderkey as seq, cast(o_orderdate as date) as day, case o_orderstatus when 'P' then 'auto' when 'O' then 'suggest' else 'manual' end as gate,
       o_orderpriority as path, selected, reader_count
from {orders} join (select l_orderkey, count(*) as selected, max(l_linenumber) as reader_count from {lineitem} group by l_orderkey) g on l_orderkey=o_orderkey""",
    "v_log_line": """
select event_id, cast(ts as string) as ts, case
  when event_type='purchase' then '>>> TITLE: [needed ' || value || ' ' || (1970+user_id%40) || ' Slogan ' || user_id%9
       || '] [seller' || user_id%13 || '] lot of ' || user_id%50
  when event_type='view' then '>>> TITLE: [low-conf ' || value || '] [seller' || user_id%13 || '] lot of ' || user_id%50
  when event_type='click' then '>>> TITLE: [rejected ' || value || '] [seller' || user_id%13 || '] lot of ' || user_id%50
  else '>>> IMAGE: noise' end as payload from {events}""",
    "v_judged": """
select d.doc_id as seq, quality as truth, toxic as wrong, source as path, lang as gate, n_chars
from {labels} l join {documents} d on l.doc_id=d.doc_id""",
    "v_text": """
select 'd' || doc_id as id, text from {documents} union all select 'p' || page_id, html from {pages}
union all select 'c' || conv_id || '.' || turn, text from {conversations}""",
    # replies typed by a reviewer
    "v_reply": """
select p_partkey as id, case p_partkey%6
  when 0 then '$' || p_retailprice || ' | ' || p_brand || ' | ' || p_size
  when 1 then p_retailprice || '|' || p_name
  when 2 then 'no pipe ' || p_size || ' cc'
  when 3 then '$1,' || (p_size+100) || '.5 | x | many'
  when 4 then 'go ' || p_size || ' citizens'
  else 'anything, mellon' end as reply, p_size, p_partkey from {part}""",
    # what a reviewer did with a user's lot of a day: listed, answered or marked as seen
    "v_role": """
select event_id as key, user_id || ' ' || cast(cast(ts as date) as string) as item_id, ts,
       case event_type when 'purchase' then 'context' when 'click' then 'answer' when 'error' then 'seen' end as role
from {events}""",
    # reference labels as text, with and without slogan, some unreadable
    "v_label": """
select p_partkey as id, case p_partkey%5 when 0 then cast(1960+p_size as string) when 1 then 'unknown ' || p_name
  when 2 then (1960+p_size) || ' (' || p_brand || ')' else (1960+p_size) || ' ' || p_name end as label from {part}""",
}

def view_sql(name: str) -> str:
    """The view as DuckDB reads it: tables by plain name."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def ctes(*names: str) -> str:
    """``with`` clause that defines the named views."""
    return "with " + ",\n".join(f"{n} as ({view_sql(n)})" for n in names)


class Tables:
    """Lazy access to a folder of parquet tables and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)
