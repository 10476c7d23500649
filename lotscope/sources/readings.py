"""Second-reader responses: loose JSON to typed readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotscope.functions import numbers as nm

RESPONSE_KEYS = ("raw_response", "text", "output", "content", "raw")
SLOGAN = ("index string, slogan string, x string, y string, radius string, size string, size_class string, "
          "edge struct<x:string,y:string>, edge_x string, edge_y string, confidence string, printed_year string")
SLOGANS = f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in SLOGAN.split(', '))}>>"
ANALYSIS = (f"total_button_count string, blue_background_count string, white_background_count string, "
            f"detected_slogans {SLOGANS}, "
            "flagged_problem_slogans array<struct<index:string,reason:string,partial_text:string>>")


def _object_text(c: Column) -> Column:
    """The outermost braces of a text that may carry fences or a chat preamble."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def analysis_text(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_text``, the JSON of the analysis inside a stored response: under ``response`` (object or text), or in
    one of the known text fields of it, or the whole object. Every level is parsed once."""
    fields = ", ".join(f"{k} string" for k in ("total_button_count", "detected_slogans", *RESPONSE_KEYS))
    outer = df.withColumn("_e", F.from_json(raw, "response string")).withColumn("_inner", _object_text(F.col("_e.response")))
    opened = outer.withColumn("_i", F.from_json("_inner", fields))
    direct = F.col("_i.total_button_count").isNotNull() | F.col("_i.detected_slogans").isNotNull()
    parsed = lambda text: F.when(F.try_parse_json(text).isNotNull(), text)  # the first field that parses counts
    nested = F.coalesce(*[parsed(_object_text(F.col(f"_i.{k}"))) for k in RESPONSE_KEYS], F.col("_inner"))
    text = F.when(F.col("_inner").isNull(), F.col(raw)).when(direct, F.col("_inner")).otherwise(nested)
    return opened.withColumn("_text", text).drop("_e", "_i", "_inner")


def parse_analysis(df: DataFrame, raw: str) -> DataFrame:
    """Add ``a`` (the analysis struct) and its counts; unreadable text gives zero counts."""
    parsed = analysis_text(df, raw).withColumn("a", F.from_json("_text", ANALYSIS, {"mode": "PERMISSIVE"})).drop("_text")
    zero = F.lit(0)
    return parsed.withColumns({
        "total": nm.loose_int(F.col("a.total_button_count"), zero), "blue": nm.loose_int(F.col("a.blue_background_count"), zero),
        "white": nm.loose_int(F.col("a.white_background_count"), zero),
        "n_flagged": F.coalesce(F.size("a.flagged_problem_slogans"), zero)})


def parse_readings(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """One row per detected slogan with typed fields, blanks dropped, and whether the reader flagged its index. The
    coordinate scale of a response is read off its own array, so nothing is shuffled; typing happens after the explode,
    in generated code.

    The explode is an outer one because Spark would otherwise push a size filter, and with it the whole parsing, down
    to the scan and parse everything twice; the blank filter removes the empty rows."""
    found = analysis_text(df, raw).select(*keys, F.from_json(
        "_text", f"detected_slogans {SLOGANS}, flagged_problem_slogans array<struct<index:string>>").alias("_a"))
    flags = F.transform("_a.flagged_problem_slogans", lambda f: nm.loose_int(f["index"], F.lit(None).cast("int")))
    slogans = found.select(*keys, F.col("_a.detected_slogans").alias("_s"), flags.alias("_f"))
    coords = lambda s: F.when(F.trim(s["slogan"]) != "", F.greatest(*[nm.loose_float(v) for v in (
        s["x"], s["y"], F.coalesce(s["edge"]["x"], s["edge_x"]), F.coalesce(s["edge"]["y"], s["edge_y"]))]))
    rows = slogans.select(*keys, "_f", F.array_max(F.transform("_s", coords)).alias("_top"), F.posexplode_outer("_s").alias("pos", "s"))
    s = lambda name: F.col(f"s.{name}")
    typed = rows.where(F.trim(s("slogan")) != "").select(
        *keys, "_top", "pos", nm.loose_int(s("index"), F.col("pos") + 1).alias("index"), F.trim(s("slogan")).alias("slogan"),
        nm.loose_float(s("x")).alias("x"), nm.loose_float(s("y")).alias("y"),
        nm.loose_float(F.coalesce(s("radius"), s("size"))).alias("size"), nm.size_class(F.coalesce(s("size_class"), s("size"))).alias("size_class"),
        nm.loose_float(F.coalesce(s("edge.x"), s("edge_x"))).alias("edge_x"), nm.loose_float(F.coalesce(s("edge.y"), s("edge_y"))).alias("edge_y"),
        nm.parse_confidence(s("confidence")).alias("confidence"), nm.parse_printed_year(s("printed_year")).alias("printed_year"), "_f")
    flagged = F.coalesce(F.array_contains("_f", F.col("index")), F.lit(False))
    return _rescale(typed.withColumn("flagged", flagged).drop("_f"))


def _rescale(rows: DataFrame) -> DataFrame:
    down = lambda name: F.when(F.col("_top") > 100, F.col(name) / 10).otherwise(F.col(name))
    scale = F.when(F.col("_top") > 100, "permille").when(F.col("_top").isNotNull(), "percent")
    return rows.withColumns({**{n: down(n) for n in ("x", "y", "size", "edge_x", "edge_y")}, "coord_scale": scale}).drop("_top")


def normalize_scale(readings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """If any coordinate of a response exceeds 100, its coordinates and sizes are per mille: divide by ten."""
    keys = keys or ["job"]
    top = readings.groupBy(*keys).agg(F.max(F.greatest("x", "y", "edge_x", "edge_y")).alias("_top"))
    return _rescale(readings.join(top, keys))
