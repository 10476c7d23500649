"""Marks on a page: radius votes, set quality, bands, grid holes, matching with readings, vetoes and labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotscope import settings as S
from lotscope.functions import geometry as geo
from lotscope.functions.numbers import clamp
from lotscope.plans import folds, spatial
from lotscope.plans import order_stats as st
from lotscope.plans.lineage import cut_lineage
from lotscope.plans.prefix import number_rows, running
from lotscope.plans.ranked import first_by
from lotscope.sources.sinks import label_name


# --- votes ---------------------------------------------------------------------------------------------------

def weighted_median(votes: DataFrame, value: str = "radius", weight: str = "weight") -> DataFrame:
    """Lower weighted median per job: the first value whose weight up to it reaches half of the total.
    Equal values are added up before anything is ordered."""
    rows = votes.where(F.col(weight) > 0).groupBy("job", F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    total = rows.groupBy("job").agg(F.sum("w").alias("total"))
    run = running(rows, ["job"], [F.asc("v")], st.coarse(F.col("v")), {"through": (F.col("w"), "sum")})
    reached = run.join(total, "job").where(F.round("through", 9) >= F.round(F.col("total") / 2, 9))
    return reached.groupBy("job").agg(F.min("v").alias(value))


def consensus_radius(votes: DataFrame) -> DataFrame:
    """Radius per job by weighted median, its confidence (1 - weighted variation; a lone vote at most 0.6), and the
    number of merged votes."""
    w, r = F.col("weight"), F.col("radius")
    sums = votes.groupBy("job").agg(F.sum(w).alias("sw"), F.sum(w * r).alias("swr"), F.sum(w * r * r).alias("swrr"),
                                    F.count(F.lit(1)).alias("n"), F.count_if("merged").alias("n_merged"))
    mean = F.col("swr") / F.col("sw")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("swrr") / F.col("sw") - mean * mean)) / mean
    conf = clamp(1.0 - spread, 0.0, 1.0)
    out = sums.join(weighted_median(votes), "job")
    return out.select("job", F.col("radius").alias("r_est"), F.when(F.col("n") == 1, F.least(conf, F.lit(S.LONE_VOTE_CONF))).otherwise(conf).alias("scale_conf"), "n_merged")


# --- set quality ---------------------------------------------------------------------------------------------

def median_radius(marks: DataFrame) -> DataFrame:
    """Median of the positive radii per job."""
    return st.median(marks.where("r > 0"), ["job"], F.col("r"), "median_r").select("job", "median_r")


def mark_set_score(marks: DataFrame, w: float, h: float, small: int = spatial.SMALL) -> DataFrame:
    """Quality of a mark set in [0, 1]: fill, even spacing, even radii, plausible coverage. Ordinary pages are folded."""
    few, large = spatial.split_pages(marks, small)
    both = folds.fold_pages(_doubles(few.select("job", "x", "y", "r", "fill"), "x", "y", "r", "fill"), [], folds.quality,
                            f"{_kind(marks)}, n bigint, fill double, r_mean double, r_sd double, nn_mean double, nn_sd double, median_r double")
    if large is not None:
        both = both.unionByName(_quality_large(marks.join(large, "job", "left_semi")))
    one_less_cv = lambda sd, mean: F.greatest(F.lit(0.0), 1.0 - F.when(F.col(mean) > 0, F.col(sd) / F.col(mean)).otherwise(1.0))
    cover = F.col("n") * math.pi * F.col("median_r") * F.col("median_r") / (w * h)
    tent = F.when(cover <= 0.40, cover / 0.40).otherwise(F.greatest(F.lit(0.0), 1.0 - (cover - 0.40) / 0.60))
    spacing = F.when(F.col("n") >= 2, one_less_cv("nn_sd", "nn_mean")).otherwise(0.5)
    return both.select("job", "n", (0.40 * F.col("fill") + 0.30 * spacing + 0.20 * one_less_cv("r_sd", "r_mean") + 0.10 * tent).alias("score"))


def _quality_large(marks: DataFrame) -> DataFrame:
    base = marks.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.avg("fill").alias("fill"), F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_sd"))
    nn = spatial.nearest(marks, marks, self_join=True).groupBy("job").agg(F.avg("nn").alias("nn_mean"), F.stddev_pop("nn").alias("nn_sd"))
    return base.join(nn, "job", "left").join(median_radius(marks), "job")


def spacing_radius(marks: DataFrame, w: float, h: float, small: int = spatial.SMALL) -> DataFrame:
    """Radius from spacing: half the median nearest distance, held near the radius that would tile the frame. Ordinary
    pages are folded."""
    few, large = spatial.split_pages(marks, small)
    both = folds.fold_pages(_doubles(few.select("job", "x", "y"), "x", "y"), [], folds.spacing, f"{_kind(marks)}, n bigint, nn double")
    if large is not None:
        both = both.unionByName(_spacing_large(marks.join(large, "job", "left_semi")))
    tile = F.sqrt(F.lit(w * h) / F.col("n")) * 0.42
    near = F.greatest(tile * 0.6, F.least(0.5 * F.col("nn"), tile * 1.8))
    return both.select("job", F.when(F.col("nn").isNotNull(), near).otherwise(tile).alias("radius"))


def _spacing_large(marks: DataFrame) -> DataFrame:
    counts = marks.groupBy("job").agg(F.count(F.lit(1)).alias("n"))
    nn = st.median(spatial.nearest(marks, marks, self_join=True), ["job"], F.col("nn"), "nn").select("job", "nn")
    return counts.join(nn, "job", "left")


# --- bands and layout ----------------------------------------------------------------------------------------

def _kind(marks: DataFrame) -> str:
    return "job " + marks.schema["job"].dataType.simpleString()


def _doubles(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("double") for n in names})


def banded(marks: DataFrame, col: str, name: str = "band", small: int = spatial.SMALL) -> DataFrame:
    """Marks with the number of their band along a coordinate. A new band starts after a gap wider than 1.5 times
    the job's median gap and 1.5 median radii. Ordinary pages are folded."""
    few, large = spatial.split_pages(marks, small)
    rows = few.select("job", *[c for c in few.columns if c != "job"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {name} bigint"
    out = folds.fold_pages(rows, [], folds.band(rows.columns.index(col), rows.columns.index("r")), schema)
    return out if large is None else out.unionByName(_banded_large(marks.join(large, "job", "left_semi"), col, name))


def _banded_large(marks: DataFrame, col: str, name: str) -> DataFrame:
    """Equal coordinates are one place with a count, and places are ordered in one-pixel blocks, so a crowded job
    spreads over many tasks."""
    places = marks.groupBy("job", F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    block = F.floor("v")
    steps = cut_lineage(running(places, ["job"], [F.asc("v")], block, {"prev": (F.col("v"), "max")}, inclusive=False)
                        .withColumn("gap", F.col("v") - F.col("prev")))
    gaps = steps.select("job", F.explode(F.array(F.struct(F.col("gap").alias("g"), F.lit(1).cast("long").alias("k")),
                                                 F.struct(F.lit(0.0).alias("g"), (F.col("c") - 1).alias("k")))).alias("s")).select("job", "s.g", "s.k")
    med = st.median(gaps.where("g is not null and k > 0"), ["job"], F.col("g"), "med_gap", F.col("k")).select("job", "med_gap")
    marked = steps.join(median_radius(marks), "job").join(med, "job", "left")
    cut = F.coalesce(F.col("gap") > F.greatest(F.col("med_gap") * 1.5, F.col("median_r") * 1.5), F.lit(False))
    marked = cut_lineage(marked.select("job", "v", cut.cast("int").alias("cut")))
    numbered = running(marked, ["job"], [F.asc("v")], block, {name: (F.col("cut"), "sum")})
    return marks.join(numbered.select("job", F.col("v").alias(col), name), ["job", col])


def bands(marks: DataFrame, col: str) -> DataFrame:
    """(job, band, n, center) along a coordinate."""
    return banded(marks, col).groupBy("job", "band").agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("center"))


def gridded(marks: DataFrame) -> DataFrame:
    """Marks with their row and column band, materialised because several steps read them."""
    return cut_lineage(_banded_large(cut_lineage(_banded_large(marks, "y", "row")), "x", "col"))


def layout(marks: DataFrame, small: int = spatial.SMALL) -> DataFrame:
    """Rows, columns, share of marks near a grid crossing, and outliers. Ordinary pages are folded."""
    few, large = spatial.split_pages(marks, small)
    out = folds.fold_pages(_doubles(few.select("job", "x", "y", "r"), "x", "y", "r"), [], folds.layout,
                           f"{_kind(marks)}, est_rows bigint, est_cols bigint, layout_conf double, outliers bigint")
    return out if large is None else out.unionByName(_layout_large(marks.join(large, "job", "left_semi")))


def _layout_large(marks: DataFrame) -> DataFrame:
    """The nearest band centre of a mark is that of its own band or of a neighbour, so each mark meets three centres per axis."""
    both = gridded(marks)

    def with_distance(df, band, col, out):
        centers = df.groupBy("job", band).agg(F.avg(col).alias("c"))
        near = centers.select("job", F.explode(F.array(F.col(band) - 1, F.col(band), F.col(band) + 1)).alias(band), "c")
        spans = near.groupBy("job", band).agg(F.collect_list("c").alias("cs"))
        away = F.array_min(F.transform("cs", lambda c: F.abs(F.col(col) - c)))
        return df.join(spans, ["job", band]).withColumn(out, away).drop("cs")
    placed = with_distance(with_distance(both, "row", "y", "dy"), "col", "x", "dx").join(median_radius(marks), "job")
    inlier = F.hypot("dx", "dy") <= 1.2 * F.col("median_r")
    out = placed.groupBy("job").agg((F.max("row") + 1).alias("est_rows"), (F.max("col") + 1).alias("est_cols"),
                                    F.count_if(inlier).alias("inliers"), F.count(F.lit(1)).alias("n"))
    return out.select("job", "est_rows", "est_cols", (F.col("inliers") / F.col("n")).alias("layout_conf"), (F.col("n") - F.col("inliers")).alias("outliers"))


def reading_order(marks: DataFrame) -> DataFrame:
    """Position of each mark in reading order: by row band, then x, then i. Marks are numbered inside their row; the
    marks of earlier rows, one number per row, are added."""
    rows = cut_lineage(banded(marks, "y", "row"))
    inside = number_rows(rows, ["job", "row"], [F.asc("x"), F.asc("i")], F.floor("x"), "_n")
    earlier = Window.partitionBy("job").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("job", "row").agg(F.count(F.lit(1)).alias("_c")).select(
        "job", "row", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    return inside.join(before, ["job", "row"]).withColumn("position", F.col("_n") + F.col("_before")).drop("_n", "_before")


def grid_holes(marks: DataFrame, small: int = spatial.SMALL) -> DataFrame:
    """Empty cells with marks on both sides in their row, on regular grids (every mark within half a median radius
    of its column centre). Columns are the x bands, so each is occupied by some row. Ordinary pages are folded."""
    few, large = spatial.split_pages(marks, small)
    out = folds.fold_pages(_doubles(few.select("job", "x", "y", "r"), "x", "y", "r"), [], folds.holes,
                           f"{_kind(marks)}, row bigint, col bigint, cx double, cy double")
    return out if large is None else out.unionByName(_holes_large(marks.join(large, "job", "left_semi")))


def _holes_large(marks: DataFrame) -> DataFrame:
    grid = gridded(marks)
    cols = grid.groupBy("job", "col").agg(F.avg("x").alias("cx"))
    rows = grid.groupBy("job", "row").agg(F.avg("y").alias("cy"), F.min("col").alias("lo"), F.max("col").alias("hi"))
    off = grid.join(cols, ["job", "col"]).join(median_radius(marks), "job").where(F.abs(F.col("x") - F.col("cx")) > 0.5 * F.col("median_r"))
    between = rows.where("hi - lo >= 2").select("job", "row", "cy", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("col"))
    empty = between.join(grid.select("job", "row", "col").distinct(), ["job", "row", "col"], "left_anti")
    return empty.join(off.select("job").distinct(), "job", "left_anti").join(cols, ["job", "col"]).select("job", "row", "col", "cx", "cy")


# --- matching with readings ----------------------------------------------------------------------------------

def associate(marks: DataFrame, readings: DataFrame) -> DataFrame:
    """Nearest one-to-one link of marks and readings, with distance and whether the reading sits on the mark."""
    pairs = spatial.match_points(marks, readings.withColumnRenamed("i", "j"))
    linked = pairs.join(marks.select("job", "i", "r"), ["job", "i"]).join(
        readings.select("job", F.col("i").alias("j"), "confidence", F.col("x").alias("gx"), F.col("y").alias("gy")), ["job", "j"])
    return linked.withColumn("anchored", geo.is_anchored(F.col("d"), F.col("r")))


def _sides(marks: DataFrame, readings: DataFrame, *more: str) -> DataFrame:
    """Marks (side 0) and readings (side 1) of the pages, as the folds read them."""
    rows = [d.select("job", F.lit(k).alias("side"), F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "r")], *more)
            for k, d in enumerate((marks, readings))]
    return rows[0].unionByName(rows[1])


def covered(marks: DataFrame, readings: DataFrame, factor: float = 1.0, small: int = spatial.SMALL) -> DataFrame:
    """Links no longer than ``factor`` median radii; of any length on pages without a positive radius. Ordinary pages
    are folded."""
    if "r" not in readings.columns:
        readings = readings.withColumn("r", F.lit(None).cast("double"))
    few, large = spatial.split_pages(_sides(marks, readings), small)
    out = folds.fold_pages(few, [], folds.cover(factor), f"{_kind(marks)}, i bigint, j bigint, d double")
    return out if large is None else out.unionByName(_covered_large(*[d.join(large, "job", "left_semi") for d in (marks, readings)], factor))


def _covered_large(marks: DataFrame, readings: DataFrame, factor: float = 1.0) -> DataFrame:
    limit = median_radius(marks).where("median_r > 0").select("job", (F.col("median_r") * factor).alias("limit"))
    return spatial.match_points(marks, readings.withColumnRenamed("i", "j"), limit)


def matchable(marks: DataFrame, readings: DataFrame) -> DataFrame:
    """Pages on which a mark without a link says something: they have readings and a positive median radius."""
    return median_radius(marks).where("median_r > 0").select("job").join(readings.select("job").distinct(), "job", "left_semi")


def reconcile(marks: DataFrame, readings: DataFrame, small: int = spatial.SMALL) -> DataFrame:
    """Plan per job: ``covered`` pairs; ``recovered`` readings, as many as marks are missing, farthest first;
    unbacked off-mask marks ``dropped``, each ``swapped`` for a confident uncovered reading while there is one.
    Ordinary pages are folded."""
    few, large = spatial.split_pages(_sides(marks, readings, "fill", "confidence"), small)
    out = folds.fold_pages(few, [], folds.plan(S.SWAP_OFF_MASK, S.SWAP_MIN_CONFIDENCE),
                           f"{_kind(marks)}, action string, i bigint, j bigint")
    return out if large is None else out.unionByName(_reconcile_large(*[d.join(large, "job", "left_semi") for d in (marks, readings)]))


def _reconcile_large(marks: DataFrame, readings: DataFrame) -> DataFrame:
    links = cut_lineage(_covered_large(marks, readings))
    free_marks = marks.join(links, ["job", "i"], "left_anti")
    free = readings.join(links.select("job", F.col("j").alias("i")), ["job", "i"], "left_anti")
    away = spatial.nearest(free, marks)
    far = free.select("job", "i", "confidence").join(away, ["job", "i"], "left").withColumn("nn", F.coalesce("nn", F.lit(1e9)))
    n_r, n_m = [d.groupBy("job").agg(F.count(F.lit(1)).alias(c)) for d, c in ((readings, "n_r"), (marks, "n_m"))]
    deficit = n_r.join(n_m, "job", "left").select("job", F.greatest(F.lit(0), F.col("n_r") - F.coalesce("n_m", F.lit(0))).alias("deficit"))
    order = [F.desc("nn"), F.desc("i")]
    ranked = cut_lineage(number_rows(far, ["job"], order, -F.ceil("nn"), "k").join(deficit, "job"))
    recovered = ranked.where("k <= deficit")
    spare = number_rows(ranked.where((F.col("k") > F.col("deficit")) & (F.col("confidence") >= S.SWAP_MIN_CONFIDENCE)), ["job"], order, -F.ceil("nn"), "s")
    phantoms = number_rows(free_marks.where(F.col("fill") < S.SWAP_OFF_MASK), ["job"], [F.asc("fill"), F.asc("i")],
                           F.floor(F.col("fill") * 1000), "s").join(matchable(marks, readings), "job", "left_semi")
    swaps = phantoms.select("job", F.col("i"), "s").join(spare.select("job", F.col("i").alias("j"), "s"), ["job", "s"], "left")
    none = F.lit(None).cast("bigint")
    return links.select("job", F.lit("covered").alias("action"), "i", "j") \
        .unionByName(recovered.select("job", F.lit("recovered").alias("action"), none.alias("i"), F.col("i").alias("j"))) \
        .unionByName(swaps.select("job", F.when(F.col("j").isNull(), "dropped").otherwise("swapped").alias("action"), "i", "j"))


def agreement_summary(marks: DataFrame, readings: DataFrame) -> DataFrame:
    """Per job: links, upper median and maximum link length, marks and readings left over. The marks left over are
    unknown (NULL) where matching could not run."""
    links = cut_lineage(covered(marks, readings))
    snap = st.order_stats(links, ["job"], F.col("d"), {"snap_median": F.floor(F.col("n") / 2) + 1, "snap_max": F.col("n")}) \
        .withColumnRenamed("n", "n_agree")
    count = lambda d, c: d.groupBy("job").agg(F.count(F.lit(1)).alias(c))
    out = count(marks, "n_m").join(count(readings, "n_r"), "job", "full").join(snap, "job", "left")
    out = out.join(matchable(marks, readings).withColumn("_known", F.lit(True)), "job", "left").fillna(0, ["n_m", "n_r", "n_agree"])
    return out.select("job", "n_agree", "snap_median", "snap_max", F.when(F.col("_known"), F.col("n_m") - F.col("n_agree")).alias("only_marks"),
                      (F.col("n_r") - F.col("n_agree")).alias("only_readings"))


def anchor_recovery(links: DataFrame, marks: DataFrame) -> DataFrame:
    """Confident readings whose link does not sit on its mark and that are farther than a median radius from every
    mark: (job, j). ``links`` as from :func:`associate`."""
    loose = links.where(~F.col("anchored") & (F.col("confidence") >= S.SWAP_MIN_CONFIDENCE)) \
        .select("job", "j", F.col("gx").alias("x"), F.col("gy").alias("y"))
    discs = marks.select("job", "x", "y").join(median_radius(marks), "job")
    return clear_of(loose, discs, F.col("median_r"))


def clear_of(points: DataFrame, discs: DataFrame, radius) -> DataFrame:
    """Points outside every disc of their job (a point on the rim counts as inside)."""
    hit = spatial.inside_any(points, discs, radius * (1 + 1e-12))
    return points.join(hit.select("job", "j"), ["job", "j"], "left_anti")


# --- vetoes and merging --------------------------------------------------------------------------------------

def veto_proposals(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Why a proposal is a phantom: its centre lies inside an accepted disc, or its radius is off the cohort's
    median (from two accepted marks on); NULL when it is fine."""
    inside = spatial.inside_any(proposals, accepted.where("r > 0"), F.col("r") * S.VETO_CENTER).select("job", "i", F.lit(True).alias("_in"))
    cohort = st.median(accepted, ["job"], F.col("r"), "med_r").where("n >= 2 and med_r > 0").select("job", "med_r")
    out = proposals.join(inside, ["job", "i"], "left").join(cohort, "job", "left")
    off = ~F.col("r").between(S.VETO_RADIUS[0] * F.col("med_r"), S.VETO_RADIUS[1] * F.col("med_r"))
    return out.withColumn("veto", F.when(F.col("_in"), "center").when(off, "radius")).drop("_in", "med_r")


def merge_marks(primary: DataFrame, proposals: DataFrame, fill_floor: float) -> DataFrame:
    """Primary marks plus the proposals, in order of i, that are filled enough and that no mark accepted before them
    vetoes: its disc must not hold their centre, and from two accepted marks on the radius must fit the median of all
    marks accepted so far, which moves as proposals come in.

    What a primary disc holds goes first, on all tasks. The rest of a page passes one task in order, because every step
    changes the median; it is read row by row, the primary cohort as numbers of marks per radius, and only accepted
    proposals are kept, whose discs cannot crowd.
    """
    inner, low, high = S.VETO_CENTER, *S.VETO_RADIUS
    fit = proposals.where(F.col("fill") >= fill_floor)
    held = spatial.inside_any(fit, primary.where("r > 0"), F.col("r") * inner).select("job", "i")
    free = fit.join(held, ["job", "i"], "left_anti").select("job", F.col("i").cast("long").alias("i"), "x", "y", F.col("r").cast("double").alias("r"), F.lit(1).cast("long").alias("times"))
    none = lambda kind: F.lit(None).cast(kind)
    cohort = primary.groupBy("job", F.col("r").cast("double").alias("r")).agg(F.count(F.lit(1)).alias("times")).join(free.select("job").distinct(), "job", "left_semi")
    rows = cohort.select("job", none("long").alias("i"), none("double").alias("x"), none("double").alias("y"), "r", "times").unionByName(free)
    kind = primary.schema["job"].dataType.simpleString()
    chosen = folds.fold_pages(rows, [F.asc_nulls_first("i"), F.asc("r")], folds.accept(inner, low, high), f"job {kind}, i bigint")
    return primary.unionByName(proposals.join(chosen, ["job", "i"], "left_semi").select(*primary.columns))


def collapse_concentric(marks: DataFrame, small: int = spatial.SMALL) -> DataFrame:
    """Of rings around one centre keep the better filled, larger rings first.

    Marks within 0.35 of the larger radius belong together. Ordinary pages are folded; on larger ones each round settles
    the marks that no unsettled earlier mark can still influence over two links. Identical circles are one candidate:
    the best filled copy.
    """
    few, large = spatial.split_pages(marks, small)
    kind = marks.schema["job"].dataType.simpleString()
    rows = few.select("job", F.col("i").cast("long").alias("i"), "x", "y", "r", "fill")
    chosen = folds.fold_pages(rows, [F.desc("r"), F.asc("x"), F.asc("y"), F.asc("i")], folds.collapse, f"job {kind}, i bigint")
    kept = few.join(chosen, ["job", "i"], "left_semi").select(*marks.columns)
    return kept if large is None else kept.unionByName(_collapse_large(marks.join(large, "job", "left_semi")).select(*marks.columns))


def _collapse_large(marks: DataFrame) -> DataFrame:
    own = first_by(marks, ["job", "x", "y", "r"], [F.desc("fill"), F.asc("i")]).withColumn(
        "o", F.struct((-F.col("r")).alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), F.col("i").alias("d")))
    state = cut_lineage(own.select("job", "i", "x", "y", "r", "fill", "o", F.lit(0).alias("st"), F.col("o").alias("slot")))
    disc = spatial.covering(state.select("job", F.col("i").alias("k"), "x", "y", F.col("r").alias("kr")), 0.35 * F.col("kr"), 64.0).withColumnsRenamed({"x": "kx", "y": "ky"})
    at = state.select("job", "i", "x", "y", "r", F.floor(F.col("x") / 64.0).alias("cx"), F.floor(F.col("y") / 64.0).alias("cy"))
    touch = (F.col("i") != F.col("k")) & (F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky")) < 0.35 * F.col("kr"))
    half = at.join(disc, ["job", "cx", "cy"]).where(touch).select("job", "i", "k")
    edges = cut_lineage(half.unionByName(half.select("job", F.col("k").alias("i"), F.col("i").alias("k"))).distinct())
    while not state.where("st = 0").isEmpty():
        first = state.select("job", "i", F.when(F.col("st") == 0, F.col("o")).alias("m"))
        for _ in range(2):
            seen = edges.join(first.select("job", F.col("i").alias("k"), F.col("m").alias("km")), ["job", "k"]).groupBy("job", "i").agg(F.min("km").alias("km"))
            first = first.join(seen, ["job", "i"], "left").select("job", "i", F.least("m", "km").alias("m"))
        ready = state.where("st = 0").join(first, ["job", "i"]).where(F.col("o") == F.col("m")).drop("m")
        reps = state.where("st = 1").select("job", F.col("i").alias("k"), F.col("fill").alias("k_fill"), F.col("slot").alias("k_slot"))
        clash = ready.select("job", "i").join(edges, ["job", "i"]).join(reps, ["job", "k"]).groupBy("job", "i").agg(
            F.min(F.struct("k_slot", "k", "k_fill")).alias("c"))
        decided = ready.join(clash, ["job", "i"], "left").withColumn("wins", F.col("c").isNull() | (F.col("fill") > F.col("c.k_fill")))
        news = decided.select("job", "i", F.when(F.col("wins"), 1).otherwise(2).alias("n_st"), F.coalesce("c.k_slot", "o").alias("n_slot"))
        lost = decided.where(F.col("wins") & F.col("c").isNotNull()).select("job", F.col("c.k").alias("i"), F.lit(2).alias("n_st"), F.col("c.k_slot").alias("n_slot"))
        state = cut_lineage(state.join(news.unionByName(lost), ["job", "i"], "left").select(
            "job", "i", "x", "y", "r", "fill", "o", F.coalesce("n_st", "st").alias("st"), F.coalesce("n_slot", "slot").alias("slot")))
    return marks.join(state.where("st = 1").select("job", "i"), ["job", "i"], "left_semi")


def low_res_guard(marks: DataFrame) -> DataFrame:
    return marks.withColumn("guard", geo.low_res_guard(F.col("r")))


def label_pages(marks: DataFrame, readings: DataFrame, part_size: int = 1000, small: int = spatial.SMALL) -> DataFrame:
    """Label records of marks matched with readings (``build_labels`` over ``covered``). Ordinary pages are folded."""
    few, large = spatial.split_pages(_sides(marks, readings.withColumn("source", F.lit(None).cast("string")), "source"), small)
    circle = "struct<i: bigint, shape: string, x: int, y: int, r: int, source: string, reader_backed: boolean>"
    out = folds.fold_pages(few, [], folds.label(part_size), f"{_kind(marks)}, part bigint, circles array<{circle}>")
    out = out.select(F.lit(S.LABEL_SCHEMA).alias("schema"), "job", "part", label_name(F.col("job").cast("string")).alias("name"), "circles")
    if large is None:
        return out
    of = [d.join(large, "job", "left_semi") for d in (marks, readings)]
    return out.unionByName(build_labels(of[0], cut_lineage(_covered_large(*of)), of[1], part_size))


def build_labels(marks: DataFrame, links: DataFrame, readings: DataFrame, part_size: int = 1000) -> DataFrame:
    """Label records: the marks of a job with shape, source and whether a reading backs them, in parts of at most
    ``part_size`` marks so that a crowded page never has to fit one task. The flag is NULL where matching could not
    run, that is on pages without readings or without a positive median radius."""
    sized = median_radius(marks).where("median_r > 0").select("job")
    known = readings.select("job").distinct().join(sized, "job", "left_semi").withColumn("_known", F.lit(True))
    backed = links.select("job", "i").withColumn("_b", F.lit(True))
    rows = marks.join(known, "job", "left").join(backed, ["job", "i"], "left")
    numbered = number_rows(rows, ["job"], [F.asc("i")], F.floor(F.col("i") / (1 << 32)), "n")
    flag = F.when(F.col("_known"), F.coalesce("_b", F.lit(False)))
    circle = F.struct((F.col("n") - 1).alias("i"), F.lit("circle").alias("shape"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "r")],
                      F.col("source").alias("source"), flag.alias("reader_backed"))
    parts = numbered.groupBy("job", F.floor((F.col("n") - 1) / part_size).alias("part")).agg(F.array_sort(F.collect_list(circle)).alias("circles"))
    return parts.select(F.lit(S.LABEL_SCHEMA).alias("schema"), "job", "part", label_name(F.col("job").cast("string")).alias("name"), "circles")
