"""Point matching, suppression and nearest neighbours inside jobs, on grids of cells.

Ordinary jobs, of at most ``SMALL`` points, are folded whole, all in one stage. No plan here forms all pairs of a larger
job: its points meet only inside neighbouring cells; cells start near the spacing of a job's points and grow until every
point is settled. Rounds carry a frontier of what is still open, what is settled is appended, and checkpoints cut them.
Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.plans import folds
from lotscope.plans.lineage import cut_lineage
from lotscope.plans.prefix import number_rows
from lotscope.plans.ranked import first_by

SMALL = 256


def _cells(df: DataFrame, size: str, reach: int = 0) -> DataFrame:
    """Cell coordinates of each point, or one row per cell within ``reach`` cells."""
    cx, cy = F.floor(F.col("x") / F.col(size)), F.floor(F.col("y") / F.col(size))
    if reach == 0:
        return df.withColumns({"cx": cx, "cy": cy})
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
                      for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    return df.withColumn("_o", F.explode(steps)).withColumns({"cx": cx + F.col("_o.dx"), "cy": cy + F.col("_o.dy")}).drop("_o")


def _scales(points: DataFrame, limit: DataFrame | float | None, small: int) -> DataFrame:
    """(job, n, cap, base): the largest distance that matters and the first cell size of each job."""
    stats = points.groupBy("job").agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    whole = F.hypot("w", "h") + 1.0
    if isinstance(limit, DataFrame):
        stats = stats.join(limit, "job", "left").withColumn("cap", F.coalesce(F.col("limit"), whole))
    else:
        stats = stats.withColumn("cap", whole if limit is None else F.lit(float(limit)))
    spacing = F.greatest(F.sqrt(F.col("w") * F.col("h") / F.col("n")), F.greatest("w", "h") / F.col("n"), F.lit(1e-3))
    return stats.select("job", "n", "cap", F.when(F.col("n") <= small, F.col("cap")).otherwise(F.least("cap", spacing)).alias("base"))


def _levels(scales: DataFrame) -> int:
    need = scales.agg(F.max(F.ceil(F.log2(F.col("cap") / F.col("base")))).alias("k")).first()["k"]
    return 1 + int(need or 0)


def _sizes(scales: DataFrame, level: int) -> DataFrame:
    """Cell size of every job that is still growing at this level."""
    grown = F.col("base") * float(2 ** level)
    rows = scales if level == 0 else scales.where(grown / 2 < F.col("cap"))
    return rows.select("job", "cap", F.least(F.col("cap"), grown).alias("size"))


def _settle(edges: DataFrame) -> DataFrame:
    """Greedy one-to-one matching by increasing distance: an edge that is the first of both its ends is taken and
    closes the other edges of those ends. Only open edges go on to the next round."""
    edges, taken = cut_lineage(edges), []
    while True:
        first = lambda end, other: F.row_number().over(Window.partitionBy("job", end).orderBy("d", other)) == 1
        marked = cut_lineage(edges.withColumn("_i", first("i", "j")).withColumn("_t", F.col("_i") & first("j", "i")).drop("_i"))
        won = marked.where("_t").drop("_t")
        taken.append(won)
        edges = marked.where("not _t").drop("_t").join(won.select("job", "i"), ["job", "i"], "left_anti").join(won.select("job", "j"), ["job", "j"], "left_anti")
        edges = cut_lineage(edges)
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def split_pages(points: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary jobs, and the names of the larger ones (None when there are none)."""
    large = cut_lineage(points.groupBy("job").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("job"))
    return (points, None) if large.isEmpty() else (points.join(large, "job", "left_anti"), large)


def match_points(a: DataFrame, b: DataFrame, limit: DataFrame | float | None = None, small: int = SMALL) -> DataFrame:
    """One-to-one nearest matching of (job, i, x, y) with (job, j, x, y), shortest distance first, ties by i then j.

    ``limit`` refuses longer pairs: a number, or (job, limit) where null or a missing job means none. Result: (job, i, j,
    d). Coincident copies of large jobs are paired by position in their order first, which is what the shortest-first
    rule does with them.
    """
    sides = a.select("job", F.lit(0).alias("side"), F.col("i").cast("long").alias("i"), "x", "y").unionByName(
        b.select("job", F.lit(1).alias("side"), F.col("j").cast("long").alias("i"), "x", "y"))
    few, large = split_pages(sides, small)
    if isinstance(limit, DataFrame):
        few = few.join(limit.select("job", F.col("limit").cast("double").alias("limit")), "job", "left")
    else:
        few = few.withColumn("limit", F.lit(limit).cast("double"))
    kind = a.schema["job"].dataType.simpleString()
    folded = folds.fold_pages(few.select("job", "side", "i", "x", "y", "limit"), [F.col("side"), F.col("i")], folds.match,
                              f"job {kind}, i bigint, j bigint, d double")
    if large is None:
        return folded
    return folded.unionByName(_match_large(a.join(large, "job", "left_semi"), b.join(large, "job", "left_semi"), limit))


def _match_large(a: DataFrame, b: DataFrame, limit: DataFrame | float | None) -> DataFrame:
    scales = cut_lineage(_scales(a.select("job", "x", "y").unionByName(b.select("job", "x", "y")), limit, 0))
    levels = _levels(scales)
    a, b = a.select("job", "i", "x", "y"), b.select("job", "j", "x", "y")
    nth = lambda df, k: number_rows(df, ["job", "x", "y"], [F.asc(k)], F.floor(F.col(k) / 65536), "_n")
    parts = [cut_lineage(nth(a, "i").join(nth(b, "j"), ["job", "x", "y", "_n"]).select("job", "i", "j", F.lit(0.0).alias("d")))]
    a, b = a.join(parts[0], ["job", "i"], "left_anti"), b.join(parts[0], ["job", "j"], "left_anti")
    for level in range(levels):
        size = _sizes(scales, level).drop("cap")
        left = _cells(a.join(size, "job"), "size")
        right = _cells(b.join(size, "job"), "size", 1).drop("size").withColumnsRenamed({"x": "bx", "y": "by"})
        d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
        edges = left.join(right, ["job", "cx", "cy"]).withColumn("d", d).where(F.col("d") <= F.col("size")).select("job", "i", "j", "d")
        taken = _settle(edges)
        parts.append(taken)
        if level + 1 < levels:
            a = cut_lineage(a.join(taken, ["job", "i"], "left_anti"))
            b = cut_lineage(b.join(taken, ["job", "j"], "left_anti"))
    return reduce(DataFrame.unionByName, parts)


def nearest(a: DataFrame, b: DataFrame, self_join: bool = False, small: int = SMALL) -> DataFrame:
    """Distance from each (job, i, x, y) to the nearest point of ``b`` in its job: (job, i, nn).

    With ``self_join`` a point is not its own neighbour. Points of jobs without a neighbour are absent. Copies at
    one place count once, so they cost nothing extra.
    """
    places = b.groupBy("job", "x", "y").agg(F.count(F.lit(1)).alias("copies"))
    scales = cut_lineage(_scales(a.select("job", "x", "y").unionByName(b.select("job", "x", "y")), None, small))
    levels = _levels(scales)
    open_ = a.select("job", "i", "x", "y")
    done: list[DataFrame] = []
    for level in range(levels):
        size = _sizes(scales, level)
        left = _cells(open_.join(size, "job"), "size")
        right = _cells(places.join(size.drop("cap"), "job"), "size", 1).drop("size").withColumnsRenamed({"x": "bx", "y": "by"})
        d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
        if self_join:
            d = F.when((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")), F.when(F.col("copies") > 1, 0.0)).otherwise(d)
        found = left.join(right, ["job", "cx", "cy"]).groupBy("job", "i", "x", "y", "size", "cap").agg(F.min(d).alias("nn"))
        settled = found.where((F.col("nn") <= F.col("size")) | ((F.col("size") >= F.col("cap")) & F.col("nn").isNotNull())).select("job", "i", "nn")
        if level + 1 < levels:
            settled = cut_lineage(settled)
            open_ = cut_lineage(open_.join(settled, ["job", "i"], "left_anti"))
        done.append(settled)
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out


def suppress(points: DataFrame, strength: str, sep: float, small: int = SMALL) -> DataFrame:
    """Keep the strongest points so that no two kept ones of a job are closer than ``sep`` (lowest i on ties).

    Jobs of at most ``small`` points are folded; in larger ones the leaders of cells compete.
    """
    if sep <= 0:
        return points
    few, large = split_pages(points, small)
    rows = few.select("job", F.col("i").cast("long").alias("i"), "x", "y", F.col(strength).cast("double").alias("_s"))
    kind = points.schema["job"].dataType.simpleString()
    fold = folds.separate(sep)
    chosen = folds.fold_pages(rows, [F.desc_nulls_last("_s"), F.asc("i")], lambda page: fold(r[:4] for r in page), f"job {kind}, i bigint")
    kept = few.join(chosen, ["job", "i"], "left_semi").select(*points.columns)
    if large is None:
        return kept
    many = points.join(large, "job", "left_semi").withColumn("_o", F.struct(F.col(strength).cast("double").alias("s"), (-F.col("i")).alias("m")))
    return kept.unionByName(_suppress_by_cells(cut_lineage(many), points.columns, sep))


def _closer(x: str, y: str, sep: float) -> Column:
    dx, dy = F.col("x") - F.col(x), F.col("y") - F.col(y)
    return dx * dx + dy * dy < sep * sep


def _suppress_by_cells(points: DataFrame, columns: list[str], sep: float) -> DataFrame:
    """A cell is small enough that at most one of its points can survive; each round only the leader of a cell
    competes with the leaders around it, so crowded cells and copies cost one row per round."""
    left = cut_lineage(_cells(points.withColumn("_size", F.lit(sep / 2 ** 0.5 * (1 - 1e-9))), "_size"))
    out = points.select(*columns).where(F.lit(False))
    while not left.isEmpty():
        lead = first_by(left, ["job", "cx", "cy"], [F.desc("_o")])
        around = _cells(lead.select("job", "x", "y", "_size", F.col("_o").alias("_r")), "_size", 2).groupBy("job", "cx", "cy").agg(F.max("_r").alias("_r"))
        won = cut_lineage(lead.join(around, ["job", "cx", "cy"]).where(F.col("_o") >= F.col("_r")).drop("_r"))
        out = out.unionByName(won.select(*columns))
        near = _cells(won.select("job", "_size", "x", "y"), "_size", 2).drop("_size").withColumnsRenamed({"x": "wx", "y": "wy"})
        same = (left["job"] == near["job"]) & (left["cx"] == near["cx"]) & (left["cy"] == near["cy"])
        left = cut_lineage(left.join(near, same & _closer("wx", "wy", sep), "left_anti"))
    return out


def covering(circles: DataFrame, radius: Column, cell: float) -> DataFrame:
    """One row per grid cell that a disc around (x, y) may touch; discs are bounded by the image, so are the rows."""
    lo = lambda v: F.floor((F.col(v) - F.col("_rad")) / cell)
    hi = lambda v: F.floor((F.col(v) + F.col("_rad")) / cell)
    rows = circles.withColumn("_rad", radius).withColumn("cx", F.explode(F.sequence(lo("x"), hi("x"))))
    return rows.withColumn("cy", F.explode(F.sequence(lo("y"), hi("y")))).drop("_rad")


def inside_any(points: DataFrame, circles: DataFrame, radius: Column, cell: float = 64.0) -> DataFrame:
    """Points (job, x, y, …) whose place lies strictly inside some disc (job, x, y, r) of their job."""
    discs = covering(circles.select("job", "x", "y", radius.alias("rad")).distinct(), F.col("rad"), cell).withColumnsRenamed({"x": "ax", "y": "ay"})
    at = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    hit = (at["job"] == discs["job"]) & (at["cx"] == discs["cx"]) & (at["cy"] == discs["cy"]) \
        & (F.hypot(at["x"] - discs["ax"], at["y"] - discs["ay"]) < discs["rad"])
    return at.join(discs, hit, "left_semi").drop("cx", "cy")
