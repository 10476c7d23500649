"""Payload ingest: listings, photos, readings, notifications."""

from pyspark.sql import functions as F

from lotscope.functions import numbers as nm
from lotscope.operators import filters
from lotscope.queries.registry import query
from lotscope.queries.sql import on
from lotscope.sources import listings, notifications, readings

c = F.col
lit = F.lit


def pages_a(t):
    """One search page per order, two items each: one complete, one with a bad price and gaps."""
    v = t.view("v_listing")
    j = lambda *parts: F.concat(*[p if not isinstance(p, str) else lit(p) for p in parts])
    body = j('{"itemSummaries":[{"itemId":"v1|', c("item_id"), '|0","title":"', c("title"), '","seller":{"username":"', c("seller"),
             '"},"price":{"value":"', c("asking"), '","currency":"EUR"},"image":{"imageUrl":"p', c("item_id"), '.jpg"},"categories":[{"categoryId":"1"},{"categoryId":"',
             F.when(c("fmt") == "fixed", "11450").otherwise("64482"), '"}],"itemWebUrl":"u', c("item_id"), '","buyingOptions":["AUCTION"],"condition":"Used","bidCount":3},',
             '{"itemId":"v2|', c("item_id"), '","price":{"value":"n/a"},"thumbnailImages":[{"imageUrl":"t', c("item_id"), '.jpg"}]},{"title":"no id"}]}')
    return v.select("item_id", "fmt", body.alias("payload")).withColumnRenamed("item_id", "page")


PAGES = """, pg as (select item_id as page, fmt, 'v1|' || item_id || '|0' as item_id, title, asking as current_price, 'EUR' as currency, 'u' || item_id as listing_url,
 'p' || item_id || '.jpg' as gallery_url, seller, 'AUCTION' as buying_options, 'Used' as condition, 3 as bid_count from v_listing union all
 select item_id, fmt, 'v2|' || item_id, '', 0.0, 'USD', '', 't' || item_id || '.jpg', '', '', '', null from v_listing)"""
COLS = ["item_id", "title", "current_price", "currency", "listing_url", "gallery_url", "seller", "buying_options", "condition", "bid_count"]


@query("s4_flatten_listings_a", on("v_listing", body="").rstrip() + PAGES + " select " + ", ".join(COLS) + " from pg")
def s4(t):
    return listings.flatten_listings_a(pages_a(t)).withColumn("buying_options", F.array_join("buying_options", ",")).select(*COLS)


@query("p2_exclude_categories", on("v_listing", body="").rstrip() + PAGES + " select item_id from pg where not (fmt='fixed' and item_id like 'v1%')")
def p2(t):
    return filters.exclude_categories(listings.flatten_listings_a(pages_a(t))).select("item_id")


def pages_b(t):
    v = t.view("v_listing")
    head = F.concat(lit('{"results":[{"listing_id":'), c("item_id"), lit(',"title":"'), c("title"), lit('","url":"b'), c("item_id"), lit('","price":{"amount":'),
                    c("asking"), lit(',"divisor":'), F.when(c("fmt") == "fixed", "0").when(c("fmt") == "auction", "1000").otherwise("100"), lit('},"images":['),
                    F.when(c("fmt") == "auction", '{"url_570xN":"s","url_fullxfull":"f"}').when(c("fmt") == "fixed", '{"url_570xN":"s"}').otherwise(""),
                    lit('],"shop":{"shop_name":"'), c("seller"), lit('"}},{"title":"malformed"}]}'))
    return v.select(head.alias("payload"))


@query("s5_flatten_listings_b", on("v_listing", body="""select 'etsy_' || item_id as item_id, title, round(asking/case fmt when 'auction' then 1000 else 100 end,6) as current_price, 'USD' as currency,
 'b' || item_id as listing_url, case fmt when 'auction' then 'f' when 'fixed' then 's' else '' end as gallery_url, seller from v_listing"""))
def s5(t):
    return listings.flatten_listings_b(pages_b(t)).withColumn("current_price", F.round("current_price", 6))


def items(t):
    v = t.view("v_listing")
    images = F.when(c("fmt") == "auction", '"image":{"imageUrl":"main.jpg"},"additionalImages":[{"imageUrl":"a.jpg"},{"imageUrl":""},{"imageUrl":"b.jpg"}],') \
        .when(c("fmt") == "fixed", '"additionalImages":[{"imageUrl":"only.jpg"}],').otherwise("")
    body = F.concat(lit('{"itemId":"v1|'), c("item_id"), lit('","title":"'), c("title"), lit('",'), images, lit('"price":{"value":"'), c("asking"), lit('"}}'))
    return v.select("item_id", body.alias("payload"))


@query("s6_flatten_item", on("v_listing", body="""select 'v1|' || item_id as item_id, title, asking as current_price, 'USD' as currency,
 case fmt when 'auction' then 'main.jpg' when 'fixed' then 'only.jpg' else '' end as gallery_url from v_listing"""))
def s6(t):
    return listings.flatten_item(items(t)).select("item_id", "title", "current_price", "currency", "gallery_url")


@query("s7_item_photos", on("v_listing", body="""select item_id, cast(k as int) as photo_idx, u[k+1] as url from (select item_id, case fmt when 'auction' then ['main.jpg','a.jpg','b.jpg']
 when 'fixed' then ['only.jpg'] else [] end as u from v_listing) cross join (select unnest([0,1,2]) as k) where k<len(u)"""))
def s7(t):
    return listings.item_photos(items(t), keep=["item_id"])


def responses(t):
    """Stored reader responses in five shapes: object, chat text, fenced text, bare analysis, junk."""
    v = t.view("v_mark")
    px = F.when(c("line") % 2 == 0, c("x") / 8 * 10 + 110).otherwise(c("x") / 8)
    body = F.concat(lit('{"total_button_count": "'), c("line"), lit('", "detected_slogans": [{"index": 1, "slogan": " Beat '), c("status"), lit(' ", "x": '), px, lit(', "y": "'), c("y") / 6,
                    lit('", "radius": '), c("r"), lit(', "confidence": "'), F.when(c("fill") > 0.4, "High").when(c("fill") > 0.2, "medium").otherwise("0.65"),
                    lit('", "printed_year": "'), F.when(c("line") == 1, "'97").when(c("line") == 2, "1984").when(c("line") == 3, "90").otherwise("junk"),
                    lit('"}, {"slogan": " "}, {"index": "3.5", "slogan": "Second", "edge": {"x": 14, "y": 9}, "size_class": "LARGE", "confidence": 0.7}], "flagged_problem_slogans": [{"index": 2}]}'))
    quoted = F.replace(body, lit('"'), lit('\\"'))
    text = F.when(c("job") % 5 == 0, F.concat(lit('{"fileName":"f","response":'), body, lit("}"))) \
        .when(c("job") % 5 == 1, F.concat(lit('{"response":{"raw_response":"Reader said\\n\\n'), quoted, lit('"}}'))) \
        .when(c("job") % 5 == 2, F.concat(lit('{"response":"```json\\n'), quoted, lit('\\n```"}'))) \
        .when(c("job") % 5 == 3, body).otherwise("not json {")
    return v.select("job", "i", c("x").alias("mx"), text.alias("raw"))


@query("s11_parse_readings", on("v_mark", body="""
, p as (select *, line%2=0 as mille, case when line%2=0 then x/8*10+110 else x/8 end as px from v_mark where job%5<>4)
select job, i, x as mx, 1 as index, 'Beat ' || status as slogan, round(case when mille then px/10 else px end,6) as x, round(case when mille then y/60 else y/6 end,6) as y, round(case when mille then r/10 else r end,6) as size,
 cast(null as string) as size_class, cast(null as double) as edge_x, case when fill>0.4 then 0.9 when fill>0.2 then 0.6 else 0.65 end::double as confidence, case line when 1 then 1997 when 2 then 1984 end as printed_year, case when mille then 'permille' else 'percent' end as coord_scale from p
union all select job, i, x, 4, 'Second', null, null, null, 'large', case when mille then 1.4 else 14.0 end::double, 0.7::double, null, case when mille then 'permille' else 'percent' end from p"""))
def s11(t):
    out = readings.parse_readings(responses(t), "raw", ["job", "i", "mx"])
    return out.select("job", "i", "mx", "index", "slogan", *[F.round(n, 6).alias(n) for n in ("x", "y", "size")], "size_class", "edge_x", "confidence", "printed_year", "coord_scale")


@query("s11_flagged", on("v_mark", body="""
select job, i, x as mx, k as index, k=4 as flagged from v_mark, (values (1), (4)) as e(k) where job%5<>4"""))
def s11_flagged(t):
    """The same responses with a second flag, on an index written as text."""
    raw = F.replace(c("raw"), lit('"flagged_problem_slogans": [{"index": 2}'), lit('"flagged_problem_slogans": [{"index": 2}, {"index": "4"}, {"index": "NaN"}'))
    quoted = F.replace(raw, lit('\\"flagged_problem_slogans\\": [{\\"index\\": 2}'), lit('\\"flagged_problem_slogans\\": [{\\"index\\": 2}, {\\"index\\": \\"4\\"}, {\\"index\\": \\"99999999999\\"}'))
    return readings.parse_readings(responses(t).withColumn("raw", quoted), "raw", ["job", "i", "mx"]).select("job", "i", "mx", "index", "flagged")


@query("s11_parse_analysis", on("v_mark", body="select job, i, x as mx, case when job%5=4 then 0 else cast(line as int) end as total, case when job%5=4 then 0 else 1 end as n_flagged from v_mark"))
def s11_counts(t):
    return readings.parse_analysis(responses(t), "raw").select("job", "i", "mx", "total", "n_flagged")


def loose(t):
    p = c("p_size")
    text = F.when(p % 7 == 0, "High").when(p % 7 == 1, " low ").when(p % 7 == 2, "0.4").when(p % 7 == 3, F.concat(lit("'"), p)).when(p % 7 == 4, (p + 1950).cast("string")) \
        .when(p % 7 == 5, "").otherwise(F.concat(p, lit(".5")))
    return t.table("part").select("p_partkey", "p_size", text.alias("v"))


LOOSE = """with l as (select p_partkey, p_size as p, case p_size%7 when 0 then 'High' when 1 then ' low ' when 2 then '0.4' when 3 then '''' || p_size when 4 then cast(p_size+1950 as string)
 when 5 then '' else p_size || '.5' end as v from part)"""


@query("f22_parse_confidence", LOOSE + " select p_partkey, case lower(trim(v)) when 'high' then 0.9 when 'low' then 0.3 when 'medium' then 0.6 else try_cast(trim(v) as double) end::double as confidence from l")
def f22(t):
    return loose(t).select("p_partkey", nm.parse_confidence(c("v")).alias("confidence"))


@query("f23_loose_numbers", LOOSE + """ select p_partkey, coalesce(cast(round_even(try_cast(trim(v) as double),0) as int), p) as i, try_cast(trim(v) as double) as f,
 case when p%7=0 then 'small' end as size_class from l""")
def f23(t):
    label = F.when(c("p_size") % 7 == 0, " Small").otherwise(c("v"))
    return loose(t).select("p_partkey", nm.loose_int(c("v"), c("p_size")).alias("i"), nm.loose_float(c("v")).alias("f"), nm.size_class(label).alias("size_class"))


@query("f24_parse_printed_year", LOOSE + """ select p_partkey, case when y between 1960 and 2035 then y end as year from (select p_partkey, case when q is null then null when q<0 or q>99 then q
 when q in (83,84) or q between 97 and 99 then q+1900 when q<=35 then q+2000 end as y from (select p_partkey, cast(trunc(try_cast(ltrim(trim(v),'''') as double)) as int) as q from l))""")
def f24(t):
    return loose(t).select("p_partkey", nm.parse_printed_year(c("v")).alias("year"))


def push_bodies(t):
    """Notification bodies in four shapes: attributes, base64 data, plain object, no name."""
    e = t.table("events")
    name = F.concat(lit("pipeline/output/"), F.when(c("event_type") == "click", "other__").otherwise("lots__"), lit("k"), c("user_id"), lit(".png"),
                    F.when(c("event_type") == "signup", "").otherwise(".response.json"))
    meta = F.concat(lit('{"name":"'), name, lit('","bucket":"b2"}'))
    body = F.when(c("event_id") % 4 == 0, F.concat(lit('{"message":{"attributes":{"bucketId":"b1","objectId":"'), name, lit('","eventType":"FINALIZE"}}}'))) \
        .when(c("event_id") % 4 == 1, F.concat(lit('{"message":{"data":"'), F.base64(meta.cast("binary")), lit('"}}'))) \
        .when(c("event_id") % 4 == 2, F.concat(lit('{"object":"'), name, lit('","generation":"'), c("event_id"), lit('"}'))).otherwise('{"message":{}}')
    return e.select("event_id", "ts", body.alias("body"))


NAMES = """with n as (select event_id, ts, event_type, user_id, 'pipeline/output/' || case event_type when 'click' then 'other__' else 'lots__' end || 'k' || user_id || '.png' || case event_type when 'signup' then '' else '.response.json' end as name,
 case event_id%4 when 0 then 'b1' when 1 then 'b2' end as bucket, case when event_id%4=0 then 'FINALIZE' end as event_type_, case when event_id%4=2 then cast(event_id as string) else '' end as generation from events where event_id%4<>3)"""


@query("s12_decode_notifications", NAMES + " select event_id, name, bucket, event_type_ as event_type, generation from n")
def s12(t):
    return notifications.decode_notifications(push_bodies(t)).drop("body", "ts")


@query("s13_route_objects", NAMES + """ select event_id, replace(name,'.response.json','') as image_name, case when event_type<>'click' then 'k' || user_id end as key, event_type<>'click' as is_ours from n where event_type<>'signup'""")
def s13(t):
    return notifications.route_objects(notifications.decode_notifications(push_bodies(t))).select("event_id", "image_name", "key", "is_ours")
