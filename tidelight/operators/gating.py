"""Which scenes to keep: containment, clarity, glint, review state, stratified selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.operators.guards import DataError


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _equal_area(lon0: float, lat0: float, m=F) -> tuple[Callable, Callable]:
    """Lambert azimuthal equal-area coordinates on the sphere of equal area, centred on the AOI, in two steps; ``m`` is F for columns, math for numbers.

    Latitudes become authalic first, so areas are those of the ellipsoid: the first step gives a latitude's authalic sine,
    the second x and y of a longitude and that sine.
    """
    a, f = fixed.WGS84
    e = math.sqrt(f * (2 - f))
    def q(s, log):
        return (1 - e**2) * (s / (1 - e**2 * s**2) - log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp = q(1.0, math.log)
    s0 = q(math.sin(math.radians(lat0)), math.log) / qp
    c0 = math.sqrt(1 - s0 * s0)

    def sine(lat):
        s = q(m.sin(m.radians(lat)), m.log) / qp
        return min(1.0, max(-1.0, s)) if m is math else F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s))

    def plane(lon, sb):
        cb, dl = m.sqrt(1 - sb * sb), m.radians(lon - lon0)
        k = a * math.sqrt(qp / 2) * m.sqrt(2 / (1 + s0 * sb + c0 * cb * m.cos(dl)))
        return k * cb * m.sin(dl), k * (c0 * sb - s0 * cb * m.cos(dl))

    return sine, plane


def clipped(points: Column, window: Column) -> Column:
    """Part of a ring (array of x, y) inside a convex window (array of half-planes px, py, qx, qy, inside on the left): one half-plane after the other."""

    def cut_off(ring: Column, h: Column) -> Column:
        side = lambda p: (h["qx"] - h["px"]) * (p["y"] - h["py"]) - (h["qy"] - h["py"]) * (p["x"] - h["px"])

        def inside(sided: Column) -> Column:
            def edge(p: Column, i: Column) -> Column:
                q = F.get(sided, (i + 1) % F.size(sided))
                s, t = p["s"], q["s"]
                cross = F.struct((p["x"] + (q["x"] - p["x"]) * s / (s - t)).alias("x"), (p["y"] + (q["y"] - p["y"]) * s / (s - t)).alias("y"))
                return F.array_compact(F.array(F.when(s >= 0, F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.when(s * t < 0, cross)))

            return F.flatten(F.transform(sided, edge))

        return _named(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("s"))), inside)

    return F.aggregate(window, points, cut_off)


def ring_area(points: Column) -> Column:
    """Area of a ring of x, y; rings of fewer than three points have none."""
    def term(p: Column, i: Column) -> Column:
        q = F.get(points, (i + 1) % F.size(points))
        return p["x"] * q["y"] - q["x"] * p["y"]
    total = F.aggregate(F.transform(points, term), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(points) >= 3, F.abs(total) / 2).otherwise(0.0)


def aoi_coverage(scenes: DataFrame, aoi: Sequence[Sequence[float]], ring: str = "ring") -> DataFrame:
    """Fraction of the area of interest a footprint ring covers, the missing square metres, and full containment.

    Areas are equal-area metres. ``aoi`` is one convex ring of (lon, lat) pairs, a constant of the
    study. Containment: every corner of the area lies inside the footprint and nothing is missing.
    """
    box = [tuple(map(float, p)) for p in aoi]
    box = box[:-1] if box[0] == box[-1] else box
    if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(box, [*box[1:], box[0]], strict=True)) < 0:
        box = box[::-1]
    lon0, lat0 = (sum(p[k] for p in box) / len(box) for k in (0, 1))
    sine, plane = _equal_area(lon0, lat0, math)
    corners = [plane(x, sine(y)) for x, y in box]
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    planes = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("px", "py", "qx", "qy"), (*p, *q), strict=True)]) for p, q in edges])
    total = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in edges)) / 2
    sine, plane = _equal_area(lon0, lat0)
    on_sphere = F.transform(ring, lambda p: F.struct(p[0].cast("double").alias("lon"), sine(p[1].cast("double")).alias("sb")))
    flat = F.transform(on_sphere, lambda p: F.struct(*[v.alias(n) for n, v in zip("xy", plane(p["lon"], p["sb"]), strict=True)]))
    # One expression, exploded from a one-element array: as plain columns, a filter on the result would move below and repeat the clipping
    # for every corner.
    area = F.transform(F.array(clipped(flat, planes)), ring_area)
    missing = lambda a: F.greatest(F.lit(0.0), F.lit(total) - a)
    parts = F.transform(area, lambda a: F.struct((a / total).alias("aoi_coverage"), missing(a).alias("aoi_missing_m2"), (missing(a) <= 1e-9 * total).alias("aoi_covered")))
    return scenes.withColumn("_c", F.explode(parts)).select(*scenes.columns, "_c.*")


def contained(scenes: DataFrame, tolerance_m2: float = 0.0) -> DataFrame:
    return scenes.where(F.col("aoi_covered") | (F.col("aoi_missing_m2") <= tolerance_m2))


def clear_enough(scenes: DataFrame, least: float = fixed.CLEAR_MIN) -> DataFrame:
    """NULL clarity fails the gate."""
    return scenes.where(F.col("aoi_clear") >= least)


def glint_above(scenes: DataFrame, least: float | None) -> DataFrame:
    return scenes if least is None else scenes.where(F.col("glint_angle") > least)


def gate_agreement(scenes: DataFrame, least: float = fixed.CLEAR_MIN, max_cloud: float = 0.10) -> DataFrame:
    """How the area's own clarity relates to the whole-scene numbers."""
    from tidelight.functions.maths import safe_corr

    ok = F.coalesce(F.col("aoi_clear") >= least, F.lit(False))
    return scenes.agg(safe_corr(F.col("aoi_clear"), F.col("clear_percent")).alias("r"),
                      F.count_if(ok & (F.col("cloud_cover") > max_cloud)).alias("recovered"),
                      F.count_if(~ok & (F.col("cloud_cover") <= max_cloud)).alias("rejected"))


def drop_ids(scenes: DataFrame, drops: DataFrame, ident: str = "id") -> DataFrame:
    """Remove listed scenes; a listed id that does not exist is an error."""
    lost = drops.select(ident).subtract(scenes.select(ident)).limit(20).collect()
    if lost:
        raise DataError(f"ids to drop are not in the table: {sorted(str(r[0]) for r in lost)}")
    return scenes.join(drops.select(ident).distinct(), ident, "left_anti")


def review_state(scenes: DataFrame, n_panels: int = fixed.REVIEW_PANELS) -> DataFrame:
    """Add ``review`` and ``shallow`` (a negative call made without opening every panel). Needs visible, unsure, reviewed, panels."""
    state = (F.when(F.col("visible"), "visible").when(F.col("unsure"), "unsure").when(F.col("reviewed"), "negative").otherwise("unreviewed"))
    seen = F.size(F.array_distinct(F.coalesce("panels", F.array().cast("array<int>"))))
    out = scenes.withColumn("review", state).withColumn("panels_seen", seen)
    return out.withColumn("shallow", (F.col("review") == "negative") & (F.col("panels_seen") < n_panels))


def review_tally(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("review").agg(F.count(F.lit(1)).alias("n_scenes"), F.sum("panels_seen").alias("panels_seen"),
                                          F.count_if("shallow").alias("n_shallow"))


def yearly(scenes: DataFrame, at: str) -> DataFrame:
    """Scenes and distinct days per year; days are counted from a distinct table of dates."""
    d = scenes.groupBy(F.to_date(at).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy(F.year("d").alias("year")).agg(F.sum("n").alias("scenes"), F.count(F.lit(1)).alias("days"))


def best_per_day(scenes: DataFrame, day: str, score: str, ident: str = "id") -> DataFrame:
    """The highest score of each day (smallest id on ties)."""
    cols = [c for c in scenes.columns if c != day]
    best = scenes.groupBy(day).agg(F.max_by(F.struct(*cols), F.struct(F.col(score), -F.col(ident))).alias("_b"))
    return best.select(day, "_b.*").select(*scenes.columns)


def clearest(scenes: DataFrame, n: int = fixed.BATCH_SIZE, score: str = "aoi_clear", ident: str = "id") -> DataFrame:
    return scenes.orderBy(F.desc(score), ident).limit(n)


def review_order(scenes: DataFrame) -> DataFrame:
    return scenes.orderBy(F.desc("aoi_clear"), F.desc("glint_angle"))


def stratified_top(scenes: DataFrame, n: int, year: str, score: str, ident: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """``n`` slots shared among years by their number of scenes (rounded, halves to even), best scores inside each year.

    Only rows that can win are ranked: each year's rank is cut inside the tasks before rows move.
    """
    per = scenes.groupBy(*by, year).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by)) if by else F.lit(scenes.count())  # one row per year
    per = per.withColumn("_t", total)
    slots = per.withColumn("slots", F.bround(n * F.col("_n") / F.col("_t"), 0).cast("int")).select(*by, year, "slots")
    w = Window.partitionBy(*by, year).orderBy(F.desc(score), ident)
    # The literal bound lets Spark keep only the first n rows of a year in every task before the shuffle.
    top = scenes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return top.join(slots, [*by, year]).where(F.col("place") <= F.col("slots")).drop("slots")


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows per key at positions int(linspace(0, count - 1, n))."""
    from tidelight.operators.ordered import RN, number_rows

    o = number_rows(rows, keys, order).rows
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spots = size.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        RN, F.floor(F.col("_i") * (F.col("_n") - 1) / F.lit(max(1, n - 1)))).select(*keys, RN).distinct()
    return o.join(spots, [*keys, RN]).drop("_block")
