"""Mark geometry, gates and mask policy as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotscope import settings as S


def pct_to_px(pct: Column, extent: Column) -> Column:
    return pct / 100.0 * extent


def size_to_radius(size_pct: Column, w: Column, h: Column) -> Column:
    r = size_pct / 100.0 * F.least(w, h)
    return F.when(r > 0, r)


def radius_from_edge(edge_x: Column, edge_y: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Distance from a centre (pixels) to its rim point (percent); NULL when missing or zero."""
    r = F.hypot(pct_to_px(edge_x, w) - cx, pct_to_px(edge_y, h) - cy)
    return F.when(r > 0, r)


def synth_box(cx: Column, cy: Column, r: Column, w: Column, h: Column, pad: float = 0.1) -> Column:
    """Box around a circle with padding, clamped to the image."""
    p = F.floor(r * pad)
    low = lambda c: F.greatest(F.lit(0), F.bround(c - r - p, 0).cast("int"))
    high = lambda c, m: F.least(m.cast("int"), F.bround(c + r + p, 0).cast("int"))
    return F.struct(low(cx).alias("x1"), low(cy).alias("y1"), high(cx, w).alias("x2"), high(cy, h).alias("y2"))


def is_anchored(dist: Column, r: Column) -> Column:
    """A reading sits on its mark; unknown distance or radius counts as anchored."""
    return F.coalesce(dist <= S.ANCHOR_FRACTION * r, F.lit(True))


def grid_consistent(n: Column, rows: Column, cols: Column) -> Column:
    fits = (n >= 1) & (rows >= 1) & (cols >= 1) & (n >= rows * cols - (cols - 1)) & (n <= rows * cols)
    return F.coalesce(fits, F.lit(False))


def gate(confidence: Column, layout: Column, n: Column, rows: Column, cols: Column, path: Column) -> Column:
    """How far a detection may be trusted: auto, suggest or manual."""
    count = F.coalesce(n, F.lit(0))
    auto = (confidence >= S.GATE_AUTO_CONFIDENCE) & (F.coalesce(layout, F.lit(0.0)) >= S.GATE_AUTO_LAYOUT) \
        & (count >= 1) & grid_consistent(n, rows, cols) & (path.isNull() | (path == "scale_first"))
    return (F.when(confidence.isNull(), "manual").when(auto, "auto")
            .when((confidence >= S.GATE_SUGGEST_CONFIDENCE) & (count >= 1), "suggest").otherwise("manual"))


def demote_gate(gate_: Column, detector: Column) -> Column:
    """An auto gate survives only when the guided detector really engaged."""
    engaged = F.coalesce(detector, F.lit("")).startswith("hough")
    return F.when((gate_ == "auto") & ~engaged, "suggest").otherwise(gate_)


def use_background_diff(spread: Column) -> Column:
    return F.coalesce(spread <= S.BG_DIFF_MAX_SPREAD, F.lit(False))


def background_threshold(spread: Column) -> Column:
    return F.greatest(F.lit(S.BG_DIFF_BASE), F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.0)) * S.BG_DIFF_MULT)


def suffix_label(base: Column, used: Column, suffix: str) -> Column:
    base = F.coalesce(base, F.lit(""))
    return F.when(used, F.concat(base, F.lit(suffix))).otherwise(base)


def clamp_radius(value: Column, lo: Column, hi: Column) -> Column:
    r = F.coalesce(F.bround(value, 0).cast("int"), lo.cast("int"))
    return F.greatest(lo.cast("int"), F.least(hi.cast("int"), r))


def blob_vote(r_inner: Column, r_outer: Column, r_area: Column, circularity: Column) -> Column:
    """One blob's radius vote: struct(radius, weight, merged), NULL for degenerate measurements."""
    merged = r_outer > r_inner * S.MERGED_RATIO
    solo = F.when(circularity >= S.MIN_CIRCULARITY, F.least(F.lit(1.0), circularity)).otherwise(S.MIN_VOTE_WEIGHT)
    vote = F.struct(F.when(merged, r_inner).otherwise(r_area).alias("radius"),
                    F.when(merged, S.MERGED_VOTE_WEIGHT)
                    .otherwise(F.greatest(F.lit(S.MIN_VOTE_WEIGHT), solo)).alias("weight"),
                    merged.alias("merged"))
    usable = (r_inner > 0) & (r_outer > 0) & (r_area > 0) & circularity.isNotNull()
    return F.when(usable, vote)


def flood_decision(expected: Column, mask: Column, explained: Column, enabled: Column) -> Column:
    floods = enabled & (F.coalesce(expected, F.lit(0)) > 5) & (mask > S.FLOOD_MASK)
    residual = mask * (1.0 - F.coalesce(explained, F.lit(0.0)))
    return F.when(~floods, "n/a").when(residual <= S.FLOOD_RESIDUAL, "accept_dense").otherwise("refuse")


def deficit_decision(enabled: Column, kept: Column, expected: Column, enough: Column, small: Column,
                     mask: Column) -> Column:
    skip = enough | small | ~enabled | (F.coalesce(kept, F.lit(0)) == 0) | (F.coalesce(expected, F.lit(0)) == 0) \
        | (kept < expected * S.DEFICIT_MIN_FRACTION)
    return F.when(skip, "n/a").when(mask > S.FLOOD_MASK, "decline").otherwise("commit")


def infer_grid(n: Column, h: Column, w: Column) -> Column:
    """(rows, cols) whose cell shape is nearest to square, fewest rows on ties; struct(rows, cols)."""
    rows = F.filter(F.sequence(F.lit(1), n), lambda r: n % r == 0)
    scored = F.transform(rows, lambda r: F.struct(
        F.abs(F.log(F.greatest((w / (n / r)) / (h / r), F.lit(1e-9)))).alias("score"), r.cast("int").alias("rows")))
    best = F.array_min(scored)["rows"]
    return F.struct(best.alias("rows"), (n / best).cast("int").alias("cols"))


def sweep_radii(base: Column, scales=S.RADIUS_SCALES, floor: int = S.RADIUS_FLOOR) -> Column:
    """Search radii: base times each scale, floored, without repeats, in order."""
    scaled = [F.greatest(F.lit(floor), F.floor(base * s).cast("int")) for s in scales]
    return F.array_distinct(F.array(*scaled))


def low_res_guard(r: Column) -> Column:
    return F.when(2 * r < S.LOW_RES_DIAMETER, "review").otherwise("ok")
