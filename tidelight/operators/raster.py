"""Rasters as tables: rows are horizontal runs or pixels (scene_id, row, col, values)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelight import fixed
from tidelight.operators.greedy import components, spread_minimum
from tidelight.session import cut

TILE = 64  # columns of a raster row that are read together


def runs_of(pixels: DataFrame, flag: Column) -> DataFrame:
    """Horizontal runs (scene_id, row, c0, c1) of flagged pixels; a raster row is bounded by its width."""
    w = Window.partitionBy("scene_id", "row").orderBy("col")
    hot = pixels.where(flag).withColumn("_g", F.col("col") - F.row_number().over(w))
    return hot.groupBy("scene_id", "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g")


BAND_ROWS = 128  # rows of a raster that are labelled inside one task


def _touching(row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of 8-connected runs in neighbouring rows; runs sorted by (row, c0)."""
    width = int(c1.max()) + 3
    start, end = row * width + c0, row * width + c1
    below = (row + 1) * width
    lo, hi = np.searchsorted(end, below + c0 - 1, "left"), np.searchsorted(start, below + c1 + 1, "right")
    n = np.maximum(hi - lo, 0)
    first = np.repeat(np.arange(len(row)), n)
    return first, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def label_runs(runs: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Add ``label``: the first (row, c0) run of the 8-connected component.

    Bands of rows are labelled inside tasks; only labels that touch across a band edge take part in
    the rounds over the whole raster.
    """
    kind = dict(runs.dtypes)
    schema = f"scene_id {kind['scene_id']}, row {kind['row']}, c0 {kind['c0']}, c1 {kind['c1']}, lr {kind['row']}, lc {kind['c0']}"

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["row", "c0"], ignore_index=True)
        row, c0, c1 = (p[c].to_numpy(np.int64) for c in ("row", "c0", "c1"))
        head = spread_minimum(len(p), *_touching(row, c0, c1))
        return p[["scene_id", "row", "c0", "c1"]].assign(lr=p["row"].to_numpy()[head], lc=p["c0"].to_numpy()[head])

    banded = runs.withColumn("_band", F.floor(F.col("row") / band_rows))
    local = cut(banded.groupBy("scene_id", "_band").applyInPandas(lambda _, pdf: band(pdf), schema).withColumn(
        "local", F.struct(F.col("lr").alias("row"), F.col("lc").alias("c0"))).drop("lr", "lc"), "bands")
    last = local.where(F.col("row") % band_rows == band_rows - 1).select(
        "scene_id", (F.col("row") + 1).alias("row"), F.col("c0").alias("u0"), F.col("c1").alias("u1"), F.col("local").alias("a"))
    next_ = local.where(F.col("row") % band_rows == 0)
    # Buckets of columns keep the join from pairing all runs of two long rows.
    size = 256
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    edges = last.withColumn("_b", span(F.col("u0"), F.col("u1"))).join(
        next_.withColumn("_b", span(F.col("c0") - 1, F.col("c1") + 1)), ["scene_id", "row", "_b"]).where(
        (F.col("u0") <= F.col("c1") + 1) & (F.col("u1") >= F.col("c0") - 1))
    edges = cut(edges.select("scene_id", "a", F.col("local").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return local.withColumnRenamed("local", "label")
    joined = components(edges, ["scene_id"]).withColumnRenamed("id", "local")
    return local.join(joined, ["scene_id", "local"], "left").withColumn("label", F.coalesce("label", "local")).drop("local")


def sized_components(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("scene_id", "label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n_px"))


def land_runs(pixels: DataFrame, nir_min: float, res_m: float, min_area_m2: float = fixed.MIN_LAND_AREA_M2) -> tuple[DataFrame, DataFrame]:
    """Runs of land (large bright components) and per-scene counts of large and small components."""
    labelled = cut(label_runs(runs_of(pixels, F.col("valid") & (F.col("nir") > nir_min))), "labelled")
    size = sized_components(labelled).withColumn("large", F.col("n_px") * res_m * res_m >= min_area_m2)
    report = size.groupBy("scene_id").agg(F.count_if("large").alias("n_land"), F.count_if(~F.col("large")).alias("n_small"))
    land = labelled.join(size.where("large"), ["scene_id", "label"], "left_semi")
    return land.select("scene_id", "row", "c0", "c1"), report


def disk_half_widths(radius_px: int) -> list[tuple[int, int]]:
    """(row offset, half width) of the digital disk of a radius."""
    return [(d, round(math.sqrt(radius_px**2 - d * d))) for d in range(-radius_px, radius_px + 1)]


def grow_runs(runs: DataFrame, buffer_m: float, res_m: float) -> DataFrame:
    """Runs dilated by a disk, merged per row. Runs are widened, so pixels are never multiplied."""
    r = max(1, round(buffer_m / max(res_m, 1e-6)))
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in disk_half_widths(r)])
    wide = runs.withColumn("_s", F.explode(steps)).select(
        "scene_id", (F.col("row") + F.col("_s.d")).alias("row"), (F.col("c0") - F.col("_s.w")).alias("c0"), (F.col("c1") + F.col("_s.w")).alias("c1"))
    wide = wide.groupBy("scene_id", "row", "c0").agg(F.max("c1").alias("c1"))
    w = Window.partitionBy("scene_id", "row").orderBy("c0")
    reach = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chain = wide.withColumn("_new", F.when(F.col("c0") <= reach + 1, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    return chain.groupBy("scene_id", "row", "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_g")


def pixels_in_runs(runs: DataFrame) -> DataFrame:
    return runs.select("scene_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def water_mask(pixels: DataFrame, land: DataFrame, buffer_m: float, res_m: float) -> DataFrame:
    """Add ``water`` = valid, not within the buffer of land, and clear; ``clear`` must be known for every pixel."""
    near = pixels_in_runs(grow_runs(land, buffer_m, res_m)).withColumn("_near", F.lit(True))
    out = pixels.join(near, ["scene_id", "row", "col"], "left").withColumn("near_land", F.coalesce("_near", F.lit(False))).drop("_near")
    clear = F.when(F.col("clear").isNull(), F.raise_error(F.lit("clear mask does not cover the scene")).cast("boolean")).otherwise(F.col("clear"))
    return out.withColumn("water", F.col("valid") & ~F.col("near_land") & clear)


def mask_report(masked: DataFrame, land: DataFrame) -> DataFrame:
    """What each step of the water mask removed, per scene; ``buffered_px`` is the shore buffer without the land itself."""
    size = land.groupBy("scene_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("land_px"))
    rep = masked.groupBy("scene_id").agg(
        F.count_if("valid").alias("valid_px"), F.count_if("water").alias("water_px"),
        F.count_if("near_land").alias("_near"),
        F.count_if(F.col("valid") & ~F.col("near_land") & ~F.col("clear")).alias("cloud_px"))
    rep = rep.join(size, "scene_id", "left").withColumn("land_px", F.coalesce("land_px", F.lit(0)))
    return rep.withColumn("buffered_px", F.col("_near") - F.col("land_px")).drop("_near")


def robust_threshold(pixels: DataFrame, value: str, n_mad: float = fixed.BLOB_MAD, fail: bool = True, scenes: DataFrame | None = None) -> DataFrame:
    """Per scene median + n x sigma; sigma is 1.4826 MAD, or the population deviation when MAD is 0.

    Values are digital numbers with a bounded range, counted before the medians are taken. With ``scenes``,
    one of them that has no pixel left (an empty mask) stops the job, or gets NULLs if not ``fail``.
    """
    c = pixels.groupBy("scene_id", value).agg(F.count(F.lit(1)).alias("n"))
    v = F.col(value).cast("double")
    med = c.groupBy("scene_id").agg(F.percentile(value, F.lit(0.5), F.col("n")).alias("med"), F.sum("n").alias("n_px"),
                                    (F.sum(v * F.col("n")) / F.sum("n")).alias("_mean"))
    dev = c.join(med, "scene_id").groupBy("scene_id", "med", "n_px").agg(
        F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5), F.col("n")).alias("mad"),
        F.sqrt(F.sum(F.pow(v - F.col("_mean"), 2) * F.col("n")) / F.max("n_px")).alias("_std"))
    sigma = F.when(F.col("mad") > 0, F.col("mad") * fixed.MAD_TO_SIGMA).when(F.col("_std") > 0, F.col("_std"))
    flat = F.raise_error(F.lit("no spread in the values")).cast("double") if fail else F.lit(None).cast("double")
    out = dev.withColumn("sigma", F.coalesce(sigma, flat)).withColumn("threshold", F.col("med") + n_mad * F.col("sigma")).drop("_std")
    if scenes is None:
        return out
    empty = F.raise_error(F.lit("a scene has no usable pixel")).cast("bigint") if fail else F.lit(0).cast("bigint")
    return scenes.select("scene_id").distinct().join(out, "scene_id", "left").withColumn("n_px", F.coalesce("n_px", empty))


def _hull_chain(points: Column) -> Column:
    """One side of the convex hull of points (structs of doubles x, y) that come in order."""
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    def add(chain: Column, p: Column) -> Column:
        left = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chain) - 1, F.lit(1))), lambda i: turn(F.get(chain, i - 1), F.get(chain, i), p) > 0)
        return F.concat(F.slice(chain, 1, F.coalesce(F.array_max(left), F.lit(0)) + 1), F.array(p))  # what turns right before p leaves

    return F.aggregate(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1), add)


def smallest_rectangle(points: Column) -> Column:
    """Struct (long_px, short_px): sides of the smallest rectangle around an array of points (x, y), among those along an edge of the hull.

    Of equal areas the more compact one counts. A single point has no extent.
    """
    p = F.array_sort(F.array_distinct(F.transform(points, lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y")))))
    sides = lambda c: F.slice(c, 1, F.size(c) - 1)
    hull = F.concat(sides(_hull_chain(p)), sides(_hull_chain(F.reverse(p))))

    def fitted(h: Column) -> Column:
        def around(a: Column, i: Column) -> Column:
            b = F.get(h, (i + 1) % F.size(h))
            n = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
            u, v = (b["x"] - a["x"]) / n, (b["y"] - a["y"]) / n
            def extent(f):
                d = F.transform(h, f)
                return F.array_max(d) - F.array_min(d)
            along, across = extent(lambda q: q["x"] * u + q["y"] * v), extent(lambda q: q["y"] * u - q["x"] * v)
            return F.struct(F.round(along * across, 9).alias("area"), F.greatest(along, across).alias("long_px"), F.least(along, across).alias("short_px"))
        return F.array_min(F.transform(h, around))

    best = F.transform(F.array(hull), fitted)[0]  # the hull is worked out once
    one = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("long_px"), F.lit(0.0).alias("short_px"))
    return F.when(F.size(p) > 1, best).otherwise(one)


def blobs(masked: DataFrame, value: str, thresholds: DataFrame, res_m: float) -> DataFrame:
    """Bright components on water with centroid, size, fill, peak and SNR.

    The smallest rectangle is fitted to the outermost points of each component.
    """
    hot = masked.join(thresholds.select("scene_id", "threshold", "med", "sigma"), "scene_id").where(
        F.col("water") & (F.col(value) >= F.col("threshold")))
    hot = cut(hot.select("scene_id", "row", "col", F.col(value).cast("double").alias("v"), "med", "sigma"), "bright")
    labelled = cut(label_runs(runs_of(hot, F.lit(True))), "blobs")
    px = labelled.select("scene_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "label")
    stat = hot.join(px, ["scene_id", "row", "col"]).groupBy("scene_id", "label").agg(
        F.count(F.lit(1)).alias("n_px"), F.avg("row").alias("row"), F.avg("col").alias("col"),
        F.max("v").alias("nir_peak"), F.first("med").alias("_med"), F.first("sigma").alias("_sigma"))
    # Per component keep the extreme points of every row and of every column: its hull is among them.
    ends = labelled.groupBy("scene_id", "label", "row").agg(F.min("c0").alias("a"), F.max("c1").alias("z"))
    pts = ends.select("scene_id", "label", "row", F.explode(F.array_distinct(F.array("a", "z"))).alias("col"))
    low_high = pts.groupBy("scene_id", "label", "col").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    pts = low_high.select("scene_id", "label", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("row"), "col")
    outline = pts.groupBy("scene_id", "label").agg(F.collect_list(F.struct(F.col("row").alias("x"), F.col("col").alias("y"))).alias("p"))  # at most the raster's sides
    sides = outline.select("scene_id", "label", smallest_rectangle(F.col("p")).alias("_s"))
    sides = sides.select("scene_id", "label", *[(F.col(f"_s.{c}") + 1).alias(c) for c in ("long_px", "short_px")])
    out = stat.join(sides, ["scene_id", "label"])
    return out.select("scene_id", F.col("label.row").alias("label_row"), F.col("label.c0").alias("label_col"), "row", "col", "n_px",
                      (F.col("long_px") * res_m).alias("length_m"), (F.col("short_px") * res_m).alias("width_m"),
                      (F.col("n_px") / F.greatest(F.col("long_px") * F.col("short_px"), F.lit(1e-6))).alias("fill"), "nir_peak",
                      ((F.col("nir_peak") - F.col("_med")) / F.col("_sigma")).alias("nir_snr"))


# ---- boxes on pixels -------------------------------------------------------------------------

def box_pixels(boxes: DataFrame, pixels: DataFrame, tile: int = 64) -> DataFrame:
    """Pixels under each clamped box: rows [floor(y1), ceil(y2)+1), columns alike. Joined by raster tile."""
    r0, r1 = F.floor("y1"), F.ceil("y2")
    c0, c1 = F.floor("x1"), F.ceil("x2")
    b = boxes.withColumns({"_r0": F.greatest(r0, F.lit(0)), "_r1": r1, "_c0": F.greatest(c0, F.lit(0)), "_c1": c1})
    b = b.where("_r1 >= _r0 AND _c1 >= _c0")
    b = b.withColumn("_tr", F.explode(F.sequence(F.floor(F.col("_r0") / tile), F.floor(F.col("_r1") / tile)))).withColumn(
        "_tc", F.explode(F.sequence(F.floor(F.col("_c0") / tile), F.floor(F.col("_c1") / tile))))
    p = pixels.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    return b.join(p, ["scene_id", "_tr", "_tc"]).where(
        F.col("row").between(F.col("_r0"), F.col("_r1")) & F.col("col").between(F.col("_c0"), F.col("_c1"))).drop(
        "_tr", "_tc", "_r0", "_r1", "_c0", "_c1")


def box_support(boxes: DataFrame, pixels: DataFrame, thresholds: DataFrame, value: str = "nir") -> DataFrame:
    """Annotate every box with peak, bright pixels, fill and grade; no box is ever dropped."""
    from tidelight.functions.maths import support_grade

    t = thresholds.select("scene_id", "threshold", "med")
    got = box_pixels(boxes.select("scene_id", "box", "x1", "y1", "x2", "y2"), pixels.select("scene_id", "row", "col", value)).join(
        t, "scene_id").groupBy("scene_id", "box").agg(
        F.count(F.lit(1)).alias("n_px"), F.max(value).alias("nir_peak"), F.count_if(F.col(value) > F.col("threshold")).alias("bright_px"),
        F.max("med").alias("_med"))
    out = boxes.join(got, ["scene_id", "box"], "left")
    bright = F.coalesce("bright_px", F.lit(0))
    return out.withColumns({
        "bright_px": bright, "nir_fill": F.coalesce(F.try_divide(F.col("bright_px"), F.col("n_px")), F.lit(0.0)),
        "nir_x_water": F.when(F.col("_med") > 0, F.col("nir_peak") / F.col("_med")), "nir_support": support_grade(bright),
        "possible_false_positive": (bright == 0).cast("int")}).drop("_med")


def at_box_centre(boxes: DataFrame, pixels: DataFrame, columns: Sequence[str], height: int, width: int, clamp: bool = True) -> DataFrame:
    """Pixel values at the rounded box centre (halves to even), clamped to the raster."""
    r, c = F.bround((F.col("y1") + F.col("y2")) / 2, 0).cast("int"), F.bround((F.col("x1") + F.col("x2")) / 2, 0).cast("int")
    if clamp:
        r, c = F.greatest(F.lit(0), F.least(r, F.lit(height - 1))), F.greatest(F.lit(0), F.least(c, F.lit(width - 1)))
    return boxes.withColumn("row", r).withColumn("col", c).join(pixels.select("scene_id", "row", "col", *columns), ["scene_id", "row", "col"], "left")


def water_quantile(peaks: DataFrame, masked: DataFrame, value: str = "nir", peak: str = "nir_peak") -> DataFrame:
    """Share of the scene's water pixels strictly below each box peak, from the scene's value counts."""
    c = masked.where("water").groupBy("scene_id", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("scene_id").agg(F.sum("n").alias("n_water"))
    # Distinct peaks per scene are as few as digital numbers; each finds its place once.
    asked = peaks.select("scene_id", F.col(peak).alias("p")).distinct()
    marks = asked.select("scene_id", F.col("p").alias("x"), F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("n")).unionByName(
        c.select("scene_id", F.col("v").alias("x"), F.lit(1).alias("t"), "n"))
    run = Window.partitionBy("scene_id").orderBy("x", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = marks.withColumn("below", F.coalesce(F.sum("n").over(run), F.lit(0))).where("t = 0").select("scene_id", F.col("x").alias(peak), "below")
    return peaks.join(placed, ["scene_id", peak], "left").join(total, "scene_id", "left").withColumn(
        "nir_pct", F.try_divide(F.coalesce("below", F.lit(0)), F.col("n_water"))).drop("below", "n_water")


def shore_distance(boxes: DataFrame, masked: DataFrame, height: int, width: int, res_m: float) -> DataFrame:
    """Exact distance in metres from each box centre to the nearest non-water pixel, NULL in all-water scenes.

    First the vertical distance from every row with a centre to non-water inside each raster column; the raster need not have pixels there.
    That of the centre's own column bounds the answer, so only columns this near are looked at along the centre's row, tile by tile; all of
    them if the own column has no shore.
    """
    r = F.greatest(F.lit(0), F.least(F.bround((F.col("y1") + F.col("y2")) / 2, 0).cast("int"), F.lit(height - 1)))
    c = F.greatest(F.lit(0), F.least(F.bround((F.col("x1") + F.col("x2")) / 2, 0).cast("int"), F.lit(width - 1)))
    b = boxes.select("scene_id", "box", r.alias("_row"), c.alias("_c"))
    spots = b.select("scene_id", "_row", "_c").distinct()
    shore = masked.where(~F.col("water")).select("scene_id", F.col("col").alias("_col"), F.col("row").alias("_row"), F.col("row").alias("_dry"))
    asked = spots.select("scene_id", "_row").distinct().join(shore.select("scene_id", "_col").distinct(), "scene_id")
    lines = shore.unionByName(asked, allowMissingColumns=True)
    up = Window.partitionBy("scene_id", "_col").orderBy("_row")  # rows of the same place see each other
    down = Window.partitionBy("scene_id", "_col").orderBy(F.desc("_row"))
    v = lines.withColumns({"_a": F.last("_dry", True).over(up), "_b": F.last("_dry", True).over(down)}).where("_dry IS NULL")
    v = v.select("scene_id", "_row", "_col", F.least(F.col("_row") - F.col("_a"), F.col("_b") - F.col("_row")).alias("g"))
    own = v.select("scene_id", "_row", F.col("_col").alias("_c"), F.col("g").alias("_most"))
    near = spots.join(own, ["scene_id", "_row", "_c"], "left")
    first, last = F.greatest(F.lit(0), F.coalesce(F.col("_c") - F.col("_most"), F.lit(0))), F.least(F.lit(width - 1), F.coalesce(F.col("_c") + F.col("_most"), F.lit(width - 1)))
    near = near.select("scene_id", "_row", "_c", F.explode(F.sequence(F.floor(first / TILE), F.floor(last / TILE))).alias("_tile"))
    d2 = F.pow(F.col("_col") - F.col("_c"), 2) + F.pow(F.col("g"), 2)
    best = near.join(v.withColumn("_tile", F.floor(F.col("_col") / TILE)), ["scene_id", "_row", "_tile"]).groupBy("scene_id", "_row", "_c").agg((F.sqrt(F.min(d2)) * res_m).alias("shore_m"))
    return boxes.join(b.join(best, ["scene_id", "_row", "_c"], "left").select("scene_id", "box", "shore_m"), ["scene_id", "box"], "left")


# ---- scaling and tiles -----------------------------------------------------------------------

def stretch(pixels: DataFrame, value: str, lo: float = 0.01, hi: float = 0.995) -> DataFrame:
    """Percentile stretch to 0..255 over valid pixels; invalid pixels become 0."""
    c = pixels.where("valid").groupBy("scene_id", value).agg(F.count(F.lit(1)).alias("n"))
    q = c.groupBy("scene_id").agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi)), F.col("n")).alias("q")).select(
        "scene_id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    x = (F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)) * 255
    out = pixels.join(q, "scene_id", "left")
    return out.withColumn("stretched", F.when(F.col("valid"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)))).otherwise(0).cast("int"))


def tile_classes(pixels: DataFrame, keys: Sequence[str], value: str, nodata: float = fixed.TILE_NODATA_FRACTION,
                 flat: float = fixed.TILE_FLAT_P99) -> DataFrame:
    """nodata, flat or imagery per tile, from the valid share and the 99th percentile of valid values."""
    t = pixels.groupBy(*keys).agg(F.avg(F.col("valid").cast("int")).alias("coverage"),
                                  F.floor(F.percentile(F.when(F.col("valid"), F.col(value)), 0.99)).alias("p99"))
    cls = F.when(F.col("coverage") < nodata, "nodata").when(F.col("p99") < flat, "flat").otherwise("imagery")
    return t.withColumn("tile_class", cls)


def ndwi_land(pixels: DataFrame) -> DataFrame:
    """Share of valid pixels the water index calls land (a diagnostic, never a mask)."""
    from tidelight.functions.maths import ndwi

    x = ndwi(F.col("green").cast("double"), F.col("nir").cast("double"))
    return pixels.where("valid").groupBy("scene_id").agg(F.avg(F.when(x.isNotNull(), (x < 0).cast("int"))).alias("land_share"))


def clear_fraction(area: DataFrame, pixels: DataFrame) -> DataFrame:
    """Share of the area's grid cells that are clear; cells outside the raster count as not clear."""
    j = area.join(pixels.select("scene_id", "row", "col", "clear"), ["scene_id", "row", "col"], "left")
    return j.groupBy("scene_id").agg(F.avg(F.coalesce("clear", F.lit(False)).cast("int")).alias("aoi_clear"))
