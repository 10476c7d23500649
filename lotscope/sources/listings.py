"""Marketplace payloads to listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRICE = "price:struct<value:string,currency:string>"
_IMG = "struct<imageUrl:string>"
ITEM_A = (f"itemId:string,title:string,seller:struct<username:string>,{_PRICE},image:{_IMG},thumbnailImages:array<{_IMG}>,"
          f"additionalImages:array<{_IMG}>,categories:array<struct<categoryId:string>>,itemWebUrl:string,"
          "buyingOptions:array<string>,condition:string,bidCount:int")
PAGE_A = f"itemSummaries array<struct<{ITEM_A}>>"
PAGE_B = ("results array<struct<listing_id:bigint,title:string,url:string,"
          "price:struct<amount:double,divisor:double,currency_code:string>,"
          "images:array<struct<url_570xN:string,url_fullxfull:string>>,shop:struct<shop_name:string>>>")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_url(primary: Column, others: Column) -> Column:
    """Primary image, else the first of the others, else empty."""
    return _blank(F.coalesce(F.nullif(primary, F.lit("")), F.get(others, F.lit(0))["imageUrl"]))


def _listing_a(i, fallback_images: Column) -> list[Column]:
    return [
        i("itemId").alias("item_id"), _blank(i("title")).alias("title"),
        F.coalesce(i("price.value").try_cast("double"), F.lit(0.0)).alias("current_price"),
        F.coalesce(i("price.currency"), F.lit("USD")).alias("currency"), _blank(i("itemWebUrl")).alias("listing_url"),
        _first_url(i("image.imageUrl"), fallback_images).alias("gallery_url"), _blank(i("seller.username")).alias("seller"),
        F.coalesce(i("buyingOptions"), F.array().cast("array<string>")).alias("buying_options"),
        _blank(i("condition")).alias("condition"), i("bidCount").alias("bid_count"),
        F.transform(i("categories"), lambda c: c["categoryId"]).alias("categories")]


def flatten_listings_a(pages: DataFrame, payload: str = "payload", keep=()) -> DataFrame:
    """Search pages of the first marketplace, one row per item with an id."""
    items = pages.select(*keep, F.explode_outer(F.from_json(payload, PAGE_A)["itemSummaries"]).alias("i"))
    i = lambda name: F.col(f"i.{name}")
    return items.where(i("itemId") != "").select(*keep, *_listing_a(i, i("thumbnailImages")))


def flatten_item(items: DataFrame, payload: str = "payload", keep=()) -> DataFrame:
    """Single items fetched by id; nothing is excluded."""
    parsed = items.select(*keep, F.from_json(payload, f"struct<{ITEM_A}>").alias("i"))
    i = lambda name: F.col(f"i.{name}")
    return parsed.select(*keep, *_listing_a(i, i("additionalImages"))).drop("categories")


def item_photos(items: DataFrame, payload: str = "payload", keep=()) -> DataFrame:
    """Photo addresses of an item: primary first, then the additional ones, blanks dropped, numbered from 0."""
    i = F.from_json(payload, "image struct<imageUrl:string>, additionalImages array<struct<imageUrl:string>>")
    urls = F.concat(F.array(i["image"]["imageUrl"]), F.coalesce(F.transform(i["additionalImages"], lambda a: a["imageUrl"]), F.array().cast("array<string>")))
    return items.select(*keep, F.posexplode(F.filter(urls, lambda u: u.isNotNull() & (u != ""))).alias("photo_idx", "url"))


def flatten_listings_b(pages: DataFrame, payload: str = "payload", keep=()) -> DataFrame:
    """Search pages of the second marketplace: amount over divisor (0 or missing counts as 100), prefixed ids,
    full-size image with the smaller one as fallback. Items without an id are malformed and dropped."""
    rows = pages.select(*keep, F.explode_outer(F.from_json(payload, PAGE_B)["results"]).alias("r")).where("r.listing_id is not null")
    r = lambda name: F.col(f"r.{name}")
    divisor = F.when(F.coalesce(r("price.divisor"), F.lit(0.0)) == 0, 100.0).otherwise(r("price.divisor"))
    image = F.get(r("images"), F.lit(0))
    small = _blank(image["url_570xN"])
    return rows.select(*keep, F.concat(F.lit("etsy_"), r("listing_id")).alias("item_id"), _blank(r("title")).alias("title"),
                       (F.coalesce(r("price.amount"), F.lit(0.0)) / divisor).alias("current_price"),
                       F.coalesce(r("price.currency_code"), F.lit("USD")).alias("currency"), _blank(r("url")).alias("listing_url"),
                       F.coalesce(F.nullif(image["url_fullxfull"], F.lit("")), small).alias("gallery_url"), _blank(r("shop.shop_name")).alias("seller"))
