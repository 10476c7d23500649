"""JSON arrays of any size, read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("int")


def _unescaped(piece: Column) -> Column:
    """A piece without escaped backslashes and quotes. No piece ends in a lone backslash."""
    return F.replace(F.replace(piece, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))


def _opened(bare: Column, in_string: bool) -> Column:
    """Opening braces outside strings, when the piece begins inside a string or not."""
    return _count(F.regexp_replace(F.concat(F.lit('"'), bare) if in_string else bare, r'"[^"]*("|\z)', ""), "{")


def array_elements(spark: SparkSession, path) -> DataFrame:
    """(file, value): the text of every object that stands directly in the JSON array of each file.

    A file is read as pieces that end at a closing brace, so it is split into byte ranges like a text file. Whether a
    piece begins inside a string follows from the quotes before it, and how deep it stands from the braces before it.
    A range is summed up for both cases, beginning inside a string or not; one row per range, without text, is then
    carried along a file and tells every range its true beginning and which range has the last end before it. An object
    ends where the depth is back at zero; pieces of one object are put together.

    Several arrays in a file are read one after the other. Elements that are no objects vanish, and so does what
    follows the last whole object. Compressed files are not split.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"))  # ordered inside a range
    bare = _unescaped(F.col("value"))
    pieces = pieces.withColumns({"quotes": _count(bare, '"'), "out": _opened(bare, False), "ins": _opened(bare, True),
                                 "bytes": F.octet_length("value").cast("long") + 1})
    along = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def step(state):
        """What a piece adds to the depth when its range begins outside (0) or inside (1) a string."""
        begins = (F.col("through") - F.col("quotes") + state) % 2 == 1
        return F.when(begins, F.col("ins")).otherwise(F.col("out")) - ((F.col("through") + state) % 2 == 0).cast("int")

    through = {"through": F.sum("quotes").over(along)}
    both = pieces.select("file", "start", "at", "quotes", "out", "ins", "bytes").withColumns(through)
    both = both.withColumns({"d0": F.sum(step(0)).over(along), "d1": F.sum(step(1)).over(along)})
    sums = both.groupBy("file", "start").agg(F.sum("quotes").alias("q"), F.sum("bytes").alias("bytes"), *[
        e for k in "01" for e in (F.max_by(f"d{k}", "at").alias(f"t{k}"), F.min(f"d{k}").alias(f"low{k}"))])
    zero = lambda column: F.coalesce(F.sum(column).over(ranges), F.lit(0))
    sums = sums.withColumns({"state": zero("q") % 2, "before": zero("bytes")})
    of = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    sums = sums.withColumn("base", zero(of("t")))
    sums = sums.withColumn("owner", F.last(F.when(F.col("base") + of("low") == 0, F.col("start")), ignorenulls=True).over(ranges))
    begun = sums.select("file", "start", "state", "before", "base", F.coalesce("owner", F.lit(-1)).alias("owner"))

    placed = pieces.join(begun, ["file", "start"]).withColumns(through | {"read": F.col("before") + F.sum("bytes").over(along)})
    placed = placed.withColumn("depth", F.col("base") + F.sum(step(F.col("state"))).over(along))
    open_end = (F.col("read") == F.col("size") + 1) & ~F.col("file").rlike(COMPRESSED)  # no brace follows the last piece
    closed = ((F.col("through") + F.col("state")) % 2 == 0) & ~open_end & (F.col("depth") == 0)
    placed = placed.withColumn("ends", closed.cast("int"))
    placed = placed.withColumns({"nth": F.sum("ends").over(along) - F.col("ends"), "n": F.sum("ends").over(Window.partitionBy("file", "start"))})
    # pieces before the first end of a range go on with what the owner left open after its last end
    home = F.when(F.col("nth") == 0, F.struct(F.col("owner").alias("start"), F.lit(-1).cast("long").alias("nth"))).otherwise(
        F.struct("start", F.when(F.col("nth") == F.col("n"), F.lit(-1)).otherwise(F.col("nth")).cast("long").alias("nth")))
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "value")))
    objects = placed.groupBy("file", home.alias("home")).agg(parts.alias("parts"), F.max("ends").alias("whole"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return objects.where("whole = 1").select("file", F.substring(text, F.instr(text, "{"), F.length(text)).alias("value"))


def read_json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Objects of JSON-array files as rows of ``schema``; an object that does not fit it is a row of NULLs."""
    return array_elements(spark, path).select(F.from_json("value", schema).alias("v")).select("v.*")
