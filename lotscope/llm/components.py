"""Connected components of a table of links, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.llm.tables import through_table
from lotscope.plans.lineage import new_folder


def components(links: DataFrame) -> DataFrame:
    """For every end of a link (columns ``a`` and ``b``, bigint) the least id of its component: ``node``, ``root``.

    Rounds of two steps hang larger neighbours, then smaller ones, on the least neighbour of each node until every link
    points to a root. Each round is written to the shared folder, so a lost executor replays one round at most. Minima
    are taken map-side first, and joins leave hot nodes to the skew handling of adaptive execution.
    """
    folder = new_folder(links.sparkSession, "components")
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = through_table(edges, f"{folder}/0")
    state, step = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, step = now, step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                 F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").filter("u <> v").distinct())
        edges = through_table(small, f"{folder}/{step}")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
