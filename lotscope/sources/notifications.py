"""Object notifications: decoding and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope import settings as S


def decode_notifications(df: DataFrame, body: str = "body") -> DataFrame:
    """Object name, bucket and event type of push bodies: a plain object name, the message attributes, or the
    base64 payload. Bodies without a name are dropped."""
    get = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    data = F.try_to_binary(get("$.message.data"), F.lit("base64")).cast("string")
    name = F.coalesce(get("$.object"), get("$.name"), get("$.message.attributes.objectId"), F.get_json_object(data, "$.name"))
    bucket = F.coalesce(get("$.message.attributes.bucketId"), F.get_json_object(data, "$.bucket"))
    out = df.select("*", name.alias("name"), bucket.alias("bucket"), get("$.message.attributes.eventType").alias("event_type"),
                    F.coalesce(get("$.generation"), F.lit("")).alias("generation"))
    return out.where("name is not null")


def route_objects(df: DataFrame, name: str = "name", prefix: str = S.OBJECT_PREFIX) -> DataFrame:
    """Only response objects of the output folder, with their image, correlation key and dedup key."""
    n = F.col(name)
    rows = df.where(n.startswith(S.OUTPUT_PREFIX) & n.endswith(S.RESPONSE_SUFFIX))
    image = F.expr(f"left({name}, length({name}) - {len(S.RESPONSE_SUFFIX)})")
    base = F.element_at(F.split(image, "/"), -1)
    ours = base.startswith(prefix)
    key = F.when(ours, F.get(F.split(F.substr(base, F.lit(len(prefix) + 1)), r"\."), F.lit(0)))
    return rows.withColumns({"image_name": image, "key": key, "is_ours": ours})
