"""Boxes, detections and scenes: filters with reasons, spatial matching, persistence, dominance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions.geo import affine_xy, geodesic, grid_cell, utm_to_lonlat
from tidelight.functions.maths import box_shape, size_class
from tidelight.operators.cells import suppress
from tidelight.operators.greedy import match_one_to_one
from tidelight.operators.guards import DataError, first_reason
from tidelight.operators.ordered import RN, meet, number_rows
from tidelight.session import cut


# ---- filters ---------------------------------------------------------------------------------

def conditions(columns: Sequence[str], conf: float, mask: str = "none", min_len: float = 0.0, max_len: float = float("inf"),
               max_aspect: float = float("inf"), nir_pct: float = 0.0, shore_m: float = 0.0) -> dict[tuple, Column]:
    """What a box must meet to pass one filter setting, by rule and value. Evidence that is asked for must be among ``columns``."""
    for name, asked in (("nir_pct", nir_pct), ("shore_m", shore_m)):
        if asked > 0 and name not in columns:
            raise DataError(f"boxes have no {name}; add the evidence columns first")
    out = {("conf", conf): F.col("score") >= conf, ("valid",): F.col("in_valid"), ("length", min_len, max_len): F.col("length_m").between(min_len, max_len),
           ("aspect", max_aspect): F.col("aspect_ratio") <= max_aspect}
    if mask != "none":
        out["mask", mask] = F.col({"clear": "in_clear", "water": "in_water"}[mask])
    if nir_pct > 0:
        out["nir_pct", nir_pct] = F.col("nir_pct") >= nir_pct
    if shore_m > 0:
        out["shore_m", shore_m] = F.col("shore_m") >= shore_m
    return out


def passes(columns: Sequence[str], *args, **setting) -> Column:
    """Whether a box passes one filter setting, as ``conditions`` takes it."""
    return reduce(and_, conditions(columns, *args, **setting).values())


def select_boxes(boxes: DataFrame, **setting) -> DataFrame:
    return boxes.where(passes(boxes.columns, **setting))


def box_reasons(boxes: DataFrame, min_m: float = fixed.MIN_LENGTH_M, max_m: float = fixed.MAX_LENGTH_M) -> DataFrame:
    """Add ``reject_reason``, the first rule a box breaks. Needs in_valid, in_water (NULL outside) and length_m."""
    return boxes.withColumn("reject_reason", first_reason([
        ("outside_valid", ~F.coalesce("in_valid", F.lit(False))), ("outside_water", ~F.coalesce("in_water", F.lit(False))),
        ("sub_pixel_length", F.col("length_m") < min_m), ("implausible_length", F.col("length_m") > max_m)]))


def blob_reasons(blobs: DataFrame, min_px: int = fixed.BLOB_MIN_PIXELS, min_m: float = fixed.MIN_LENGTH_M,
                 max_m: float = fixed.MAX_LENGTH_M, max_aspect: float = fixed.BLOB_MAX_ASPECT,
                 min_fill: float = fixed.BLOB_MIN_FILL) -> DataFrame:
    aspect = F.col("length_m") / F.greatest(F.col("width_m"), F.lit(1e-6))
    return blobs.withColumn("reject_reason", first_reason([
        ("too_few_px", F.col("n_px") < min_px), ("sub_pixel_length", F.col("length_m") < min_m),
        ("implausible_length", F.col("length_m") > max_m), ("too_elongated", aspect > max_aspect),
        ("too_sparse", F.col("fill") < min_fill)]))


def select_size_classes(detections: DataFrame, classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in scope, and the tally of every class over all rows."""
    d = detections.withColumn("size_class", size_class(F.col("length_m")))
    return d.where(F.col("size_class").isin(*classes)), d.groupBy("size_class").agg(F.count(F.lit(1)).alias("n_rows"))


def to_detection(boxes: DataFrame, res_m: float, detector: str) -> DataFrame:
    """Pixel boxes to rounded detection columns."""
    w, h = (F.col("x2") - F.col("x1")) * res_m, (F.col("y2") - F.col("y1")) * res_m
    s = box_shape(w, h)
    return boxes.withColumns({
        "bbox_w_m": F.round(w, 1), "bbox_h_m": F.round(h, 1), "length_class_m": F.round(s["length_m"], 1),
        "aspect_ratio": F.round(s["aspect_ratio"], 2), "wake_flag": s["wake_flag"], "confidence": F.round("score", 4),
        "detector": F.lit(detector)})


CORNERS = ("ul", "ur", "lr", "ll")
NIR_FIELDS = ("nir_peak", "nir_x_water", "nir_bright_px", "nir_fill", "nir_support", "possible_false_positive", "nir_threshold_rho")
RUN_FIELDS = ("slice_px", "imgsz", "conf_threshold", "channel_order", "weights_file")
CORNER_FIELDS = (
    "scene_id", "acq_time_utc", "detection_id", "confidence", *[f"{c}_{a}" for c in CORNERS for a in ("lon", "lat")], *[f"{c}_{a}" for c in CORNERS for a in "xy"],
    "centroid_lon", "centroid_lat", "centroid_x", "centroid_y", "range_m", "range_km", "bearing_deg_from_hydrophone", "bbox_w_m", "bbox_h_m", "length_m", "aspect_ratio",
    "area_m2", "size_class", "dist_to_scene_edge_m", *NIR_FIELDS, *RUN_FIELDS)


def corner_records(boxes: DataFrame, res_m: float, zone: int, transform: dict[str, Column], origin: tuple[float, float],
                   shape: tuple[Column, Column] | None = None, evidence: bool = True, run: dict | None = None) -> DataFrame:
    """One row of ``CORNER_FIELDS`` per box; no box is dropped.

    ``boxes``: scene_id, acq_time_utc, box, x1, y1, x2, y2, score and, with ``evidence``, the columns of ``raster.box_support`` and ``threshold``. Boxes of a scene are
    boat_1, boat_2 and on by falling score (then by box). ``shape`` is (height, width) in pixels; ``run`` has the settings of the detector. What is
    not known is NULL; without ``evidence`` its columns are left out.
    """
    o = number_rows(boxes, ["scene_id"], [-F.col("score"), F.col("box")]).rows
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    points = {"ul": (x1, y1), "ur": (x2, y1), "lr": (x2, y2), "ll": (x1, y2), "centroid": (cx, cy)}
    for name, (c, r) in points.items():
        x, y = affine_xy(c, r, transform)
        o = o.withColumns({f"_{name}_x": x, f"_{name}_y": y}).withColumn(f"_{name}", utm_to_lonlat(F.col(f"_{name}_x"), F.col(f"_{name}_y"), F.lit(zone)))
    o = o.withColumn("_g", geodesic(F.lit(origin[0]), F.lit(origin[1]), F.col("_centroid.lon"), F.col("_centroid.lat")))
    w, h = (x2 - x1) * res_m, (y2 - y1) * res_m
    s = box_shape(w, h)
    out = {"detection_id": F.concat(F.lit("boat_"), F.col(RN) + 1), "confidence": F.round("score", 4)}
    for name in points:
        out |= {f"{name}_lon": F.round(f"_{name}.lon", 6), f"{name}_lat": F.round(f"_{name}.lat", 6), f"{name}_x": F.round(f"_{name}_x", 2), f"{name}_y": F.round(f"_{name}_y", 2)}
    edge = F.lit(None).cast("double") if shape is None else F.round(F.least(cx, cy, shape[1] - cx, shape[0] - cy) * res_m, 1)
    out |= {"range_m": F.round("_g.m", 1), "range_km": F.round(F.col("_g.m") / 1000, 3), "bearing_deg_from_hydrophone": F.round("_g.azimuth_deg", 2),
            "bbox_w_m": F.round(w, 1), "bbox_h_m": F.round(h, 1), "length_m": F.round(s["length_m"], 1), "aspect_ratio": F.round(s["aspect_ratio"], 2),
            "area_m2": F.round(w * h, 1), "size_class": size_class(s["length_m"]), "dist_to_scene_edge_m": edge}
    if evidence:
        out |= {"nir_peak": F.col("nir_peak"), "nir_x_water": F.round("nir_x_water", 1), "nir_bright_px": F.col("bright_px"), "nir_fill": F.round("nir_fill", 3),
                "nir_support": F.col("nir_support"), "possible_false_positive": F.col("possible_false_positive"), "nir_threshold_rho": F.round("threshold", 5)}
    out |= {c: F.lit((run or {}).get(c)) for c in RUN_FIELDS}
    return o.select(*[out.get(c, F.col(c)).alias(c) for c in CORNER_FIELDS if evidence or c not in NIR_FIELDS])


def with_range(detections: DataFrame, origin_lon: float, origin_lat: float) -> DataFrame:
    """Geodesic range and bearing from the sensor."""
    d = detections.withColumn("_g", geodesic(F.lit(origin_lon), F.lit(origin_lat), F.col("lon").cast("double"), F.col("lat").cast("double")))
    return d.withColumn("range_km", F.col("_g.m") / 1000).withColumn("bearing_deg", F.col("_g.azimuth_deg")).drop("_g")


def scene_ids(detections: DataFrame, scene: str, order: Sequence[Column], name: str = "detection_id") -> DataFrame:
    """``scene:0000`` ids in the given order inside each scene."""
    o = number_rows(detections, [scene], order)
    place = F.lpad(F.col(RN).cast("string"), 4, "0")
    wide = F.when(F.col(RN) < 10_000, place).otherwise(F.col(RN).cast("string"))
    return o.rows.withColumn(name, F.concat_ws(":", F.col(scene).cast("string"), wide)).withColumn("rank", F.col(RN) + 1).drop(RN, "_block")


def public_view(detections: DataFrame, names: DataFrame, res_m: float) -> DataFrame:
    """Slim view for other readers: length in pixels, size class, mapped scene id (own id when unmapped)."""
    d = detections.join(names, "scene_id", "left")
    return d.select(
        F.coalesce("mapped_id", F.col("scene_id").cast("string")).alias("scene_id"), "detection_id", "length_class_m",
        (F.col("length_class_m") / res_m).alias("length_px"), size_class(F.col("length_class_m")).alias("size_class"), "confidence")


def without_evidence(detections: DataFrame) -> DataFrame:
    return detections.drop(*[c for c in detections.columns if c.startswith("nir_")])


# ---- neighbours ------------------------------------------------------------------------------

def _spread(cell: Column) -> Column:
    return F.sequence(cell - 1, cell + 1)


def near_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], radius: float | Column, cell: float) -> DataFrame:
    """Pairs (a.*, b.*, d) within ``radius`` (at most ``cell``) in plane coordinates ax, ay / bx, by.

    ``a`` is copied to its 3 x 3 cells, ``b`` stays in its own, so each pair meets exactly once.
    """
    cx, cy = F.floor(F.col("ax") / cell), F.floor(F.col("ay") / cell)
    aa = a.withColumn("_cx", F.explode(_spread(cx))).withColumn("_cy", F.explode(_spread(cy)))
    bb = b.withColumn("_cx", F.floor(F.col("bx") / cell)).withColumn("_cy", F.floor(F.col("by") / cell))
    d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return aa.join(bb, [*keys, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d", d).where(F.col("d") <= radius)


def near_pairs_any_radius(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """As ``near_pairs`` with a radius per row of ``a`` (column ``radius``): each row visits the cells its circle touches."""
    span = lambda c, k: F.explode(F.sequence(F.floor((F.col(c) - F.col("radius")) / k), F.floor((F.col(c) + F.col("radius")) / k)))
    aa = a.withColumn("_cx", span("ax", cell)).withColumn("_cy", span("ay", cell))
    bb = b.withColumn("_cx", F.floor(F.col("bx") / cell)).withColumn("_cy", F.floor(F.col("by") / cell))
    d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return aa.join(bb, [*keys, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d", d).where(F.col("d") <= F.col("radius"))


def match_by_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], tol_m: float, **limits: int) -> DataFrame:
    """One-to-one pairs, nearest first (ids break ties). ``a`` has (keys, a, ax, ay), ``b`` (keys, b, bx, by).

    Places are matched, not copies: rows at one place form one side with as many units as rows, and
    the units are handed out in id order, which is what the pass over single pairs would do.
    """
    pa = a.groupBy(*keys, "ax", "ay").agg(F.min("a").alias("a"), F.count(F.lit(1)).alias("na"))
    pb = b.groupBy(*keys, "bx", "by").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("nb"))
    pairs = near_pairs(pa, pb, keys, tol_m, tol_m)
    rank = [F.col("d"), F.col("a"), F.col("b")]
    flows = cut(match_one_to_one(pairs, keys, rank, rank, F.col("na"), F.col("nb"), **limits), "flows")
    single = (F.col("na") == 1) & (F.col("nb") == 1)  # the place's id is its only row's
    alone = flows.where(single).select(*keys, "a", "b", "d")
    piles = flows.where(~single)
    return alone if piles.isEmpty() else alone.unionByName(_handed_out(piles, a, b, keys))


def _handed_out(flows: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (a, b, d) of rows for flows between places of several rows, in id order on both sides."""

    def earlier(side: str) -> Column:  # units a place gave to nearer places; a place has few neighbours
        w = Window.partitionBy(*keys, side).orderBy("d", "a", "b").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    step = 100_000
    units = flows.withColumn("_fa", earlier("a")).withColumn("_fb", earlier("b"))
    units = units.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step)))).withColumn(
        "_i", F.explode(F.sequence(F.col("_k") * step, F.least(F.col("n"), (F.col("_k") + 1) * step) - 1)))
    units = units.select(*keys, "ax", "ay", "bx", "by", "d", (F.col("_fa") + F.col("_i")).alias("_pa"), (F.col("_fb") + F.col("_i")).alias("_pb"))

    def members(df: DataFrame, side: str) -> DataFrame:
        at = [*keys, f"{side}x", f"{side}y"]
        here = meet(df.select(*at, side), flows.select(*at).distinct(), at, "left_semi")
        return number_rows(here, at, [side]).rows.select(*at, side, F.col(RN).alias(f"_p{side}"))

    out = units.join(members(a, "a"), [*keys, "ax", "ay", "_pa"]).join(members(b, "b"), [*keys, "bx", "by", "_pb"])
    return out.select(*keys, "a", "b", "d")


def match_in_turn(a: DataFrame, b: DataFrame, keys: Sequence[str], tol_m: float, seq: str = "a_seq",
                  metres: Column | None = None) -> DataFrame:
    """Each ``a`` in turn (``seq``) takes its nearest free ``b`` within ``tol_m``.

    Boxes of one side have been through ``suppress_overlaps``, so few lie within ``tol_m`` of a row.
    Distance is geodesic over alon, alat, blon, blat, or the column ``metres``. Candidates come from
    the flat metres ax, ay, bx, by, searched a little wider so that no true neighbour is missed.
    """
    wide = tol_m * 1.02 + 1.0
    flat = near_pairs(a, b, keys, wide, wide)
    dist = geodesic("alon", "alat", "blon", "blat")["m"] if metres is None else metres
    pairs = flat.withColumn("d", dist).where(F.col("d") <= tol_m).select(*keys, "a", seq, "b", "d")
    return match_one_to_one(pairs, keys, [F.col("d"), F.col("b")], [F.col(seq), F.col("a")]).drop("n")


def fuse(a: DataFrame, b: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows keep a's box and take b's SNR (detector AB); the others follow as A and B."""
    m = matches.select(*keys, "a", "b")
    ab = a.join(m, [*keys, "a"], "left").join(b.select(*keys, "b", F.col("nir_snr").alias("_snr")), [*keys, "b"], "left")
    rows_a = ab.select(*keys, F.col("a").alias("id"), F.when(F.col("b").isNotNull(), "AB").otherwise("A").alias("detector"),
                       F.col("length_m"), F.col("_snr").alias("nir_snr"))
    rows_b = b.join(m, [*keys, "b"], "left_anti").select(*keys, F.col("b").alias("id"), F.lit("B").alias("detector"), "length_m", "nir_snr")
    return rows_a.unionByName(rows_b)


def fusion_tally(fused: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return fused.groupBy(*keys, "detector").agg(F.count(F.lit(1)).alias("n_rows"))


def fused_counts(a: DataFrame, b: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per scene: a, b, matched pairs, both (= pairs) and any (= a + b - pairs), from partial counts."""
    one = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    out = one(a, "n_a").join(one(b, "n_b"), [*keys], "full").join(one(matches, "n_both"), [*keys], "left")
    out = out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_both")])
    return out.withColumn("n_any", F.col("n_a") + F.col("n_b") - F.col("n_both"))


def pick_hulls(a: DataFrame, b: DataFrame, keys: Sequence[str], selector: str = "fill", margin_m: float = fixed.HULL_MARGIN_M,
               cell: float = 100.0) -> DataFrame:
    """Best b inside a's search circle (radius = half its larger side + margin) with the number of candidates.

    ``selector``: fill, snr (largest) or small (shortest). Rows of ``a`` without candidates keep NULLs.
    """
    key = {"fill": F.col("fill"), "snr": F.col("nir_snr"), "small": -F.col("length_m")}[selector]
    search = a.withColumn("radius", 0.5 * F.greatest("w_m", "h_m") + margin_m)
    # Rows at one place see the same neighbours: places are paired, not copies.
    spots = search.select(*keys, "ax", "ay", "radius").distinct()
    places = b.groupBy(*keys, "bx", "by").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(key.alias("k"), (-F.col("b")).alias("nb"), F.col("length_m").alias("len"))).alias("p"))
    near = near_pairs_any_radius(spots, places, keys, cell)
    best = near.groupBy(*keys, "ax", "ay", "radius").agg(
        F.sum("n").alias("n_candidates"), F.max(F.struct("p.k", "p.nb", F.col("p.len").alias("hull_length_m"), F.col("d").alias("hull_offset_m"))).alias("_h"))
    out = search.join(best, [*keys, "ax", "ay", "radius"], "left")
    return out.withColumns({
        "n_candidates": F.coalesce("n_candidates", F.lit(0)), "hull": -F.col("_h.nb"), "hull_length_m": F.col("_h.hull_length_m"),
        "hull_offset_m": F.col("_h.hull_offset_m"), "detector": F.when(F.col("_h").isNotNull(), "AB").otherwise("A")}).drop("_h")


def ranked_hulls(a: DataFrame, b: DataFrame, keys: Sequence[str], margin_m: float = fixed.HULL_MARGIN_M, cell: float = 100.0,
                 only_ambiguous: bool = False) -> DataFrame:
    """Every candidate in the circle with its place by distance and the number of candidates."""
    search = a.withColumn("radius", 0.5 * F.greatest("w_m", "h_m") + margin_m)
    near = near_pairs_any_radius(search.select(*keys, "a", "ax", "ay", "radius"), b, keys, cell)
    near = cut(near.select(*keys, "a", "b", "d"), "candidates")
    n = near.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n_candidates"))
    out = number_rows(near, [*keys, "a"], ["d", "b"]).rows.join(n, [*keys, "a"])
    out = out.withColumn("place", F.col(RN) + 1).drop(RN, "_block")
    return out.where("n_candidates >= 2") if only_ambiguous else out


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Share of each side with a partner of the other side within ``tol``; NULL where a side is empty.

    Copies of one position are counted once as a position and weighted back, so a pile of copies on
    both sides does not multiply.
    """
    pa = a.groupBy(*keys, "ax", "ay").agg(F.count(F.lit(1)).alias("wa"))
    pb = b.groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).alias("wb"))
    near = near_pairs(pa, pb, keys, tol, tol)
    hit_a = near.select(*keys, "ax", "ay", "wa").distinct().groupBy(*keys).agg(F.sum("wa").alias("ha"))
    hit_b = near.select(*keys, "bx", "by", "wb").distinct().groupBy(*keys).agg(F.sum("wb").alias("hb"))
    na, nb = pa.groupBy(*keys).agg(F.sum("wa").alias("na")), pb.groupBy(*keys).agg(F.sum("wb").alias("nb"))
    out = na.join(nb, [*keys], "full").join(hit_a, [*keys], "left").join(hit_b, [*keys], "left")
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    return out.select(*keys, F.when(both, F.coalesce("ha", F.lit(0)) / F.col("na")).alias("share_a"),
                      F.when(both, F.coalesce("hb", F.lit(0)) / F.col("nb")).alias("share_b"))


def suppress_overlaps(boxes: DataFrame, keys: Sequence[str], iou: float = fixed.NMS_IOU, cell: float = 32.0, **limits: int) -> DataFrame:
    """Non-maximum suppression: by score (larger id first on ties) keep a box unless a kept one overlaps it by ``iou`` or more."""
    # A copy of a box falls with the copy of highest priority or because of it, so copies never meet.
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    twin = F.when(size / (size + 1e-9) >= iou, F.lit(None)).otherwise(F.col("box"))
    top = boxes.groupBy(*keys, "x1", "y1", "x2", "y2", twin.alias("_twin")).agg(F.max(F.struct("score", "box")).alias("_t"))
    p = top.select(*keys, "_t.box", "_t.score", "x1", "y1", "x2", "y2", (-F.col("_t.score")).alias("_r0"), (-F.col("_t.box")).alias("_r1"))
    return suppress(cut(p, "boxes"), keys, "box", ["_r0", "_r1"], iou, cell, **limits).drop("_r0", "_r1")


# ---- scenes ----------------------------------------------------------------------------------

def persistence(detections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the number of distinct years seen in the detection's ~50 m cell and ``transient``."""
    clat, clon = grid_cell(F.col("lat"), F.col("lon"))
    d = detections.withColumn("cell_lat", clat).withColumn("cell_lon", clon)
    years = d.select(*by, "cell_lat", "cell_lon", "year").distinct().groupBy(*by, "cell_lat", "cell_lon").agg(
        F.count(F.lit(1)).alias("n_years_at_cell"))
    return d.join(years, [*by, "cell_lat", "cell_lon"]).withColumn("transient", F.col("n_years_at_cell") == 1)


def drop_persistent(detections: DataFrame, min_years: int, by: Sequence[str] = ()) -> DataFrame:
    """Drop detections in cells occupied in ``min_years`` or more years; 0 keeps everything."""
    return detections if not min_years else persistence(detections, by).where(F.col("n_years_at_cell") < min_years)


def review_queue(detections: DataFrame, min_snr: float = fixed.QUEUE_MIN_SNR) -> DataFrame:
    return detections.where(F.col("transient") & (F.col("nir_snr") >= min_snr)).orderBy(F.desc("nir_snr"), "id")


def dominance(range_km: Column, k: float = fixed.SPREADING_K) -> Column:
    """Share of the loudest source; NULL without sources; a range of 0 or less fails, one that is not finite is no source."""
    w = F.when(range_km > 0, F.pow(range_km, F.lit(-k / 10))).otherwise(F.raise_error(F.lit("range must be positive")).cast("double"))
    w = F.when(finite(range_km), w)
    return F.max(w) / F.sum(w)


def finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def classify_scenes(scenes: DataFrame, detections: DataFrame, k: float = fixed.SPREADING_K, least: float = fixed.DOMINANCE_MIN) -> DataFrame:
    """EMPTY, SINGLE-DOMINANT or CROWDED per scene, with the nearest detection's fields (smallest id on ties)."""
    agg = detections.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n_detections"), dominance(F.col("range_km"), k).alias("dominance"),
        F.min(F.when(finite(F.col("range_km")), F.struct("range_km", "id", "wake_flag"))).alias("_n"))
    out = scenes.join(agg, "scene_id", "left")
    cls = F.when(F.col("_n").isNull(), "EMPTY").when(F.col("dominance") >= least, "SINGLE-DOMINANT").otherwise("CROWDED")
    return out.select(*scenes.columns, F.coalesce("n_detections", F.lit(0)).alias("n_detections"), "dominance", cls.alias("class"),
                      F.col("_n.range_km").alias("r_dominant_km"), F.col("_n.wake_flag").alias("wake_flag_dominant"))


def candidate_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("transient").alias("n_non_transient"))


def paired_scenes(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Scenes both assets have, and the rest with the side that has them."""
    j = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    only = j.where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNotNull(), "first").otherwise("second").alias("side"))
    return j.where("_a AND _b").select(key), only


def parameter_grid(skip=lambda c: False, identity=lambda c: tuple(c.values()), **values: Sequence) -> list[dict]:
    """Every combination of settings, numbered, without the skipped ones and the repeated ones.

    ``identity`` gives what makes a combination effective: combinations that agree in it run once.
    """
    import itertools

    seen, out = set(), []
    for i, combo in enumerate(itertools.product(*values.values())):
        c = dict(zip(values, combo))
        if not skip(c) and identity(c) not in seen:
            seen.add(identity(c))
            out.append({"config": i, **c})
    return out


def sweep_counts(boxes: DataFrame, scene: str, configs: Sequence[dict], keep, per_pass: int = 64) -> DataFrame:
    """(config, scene, pred): boxes of every scene that pass each setting, zeros included.

    Settings become conditional counts of one hash aggregate, so boxes are neither copied per
    setting nor shuffled: a scene leaves each task as one row of counters.
    """
    out = None
    for i in range(0, len(configs), per_pass):
        part = configs[i:i + per_pass]
        counts = boxes.groupBy(scene).agg(*[F.count_if(keep(c)).alias(f"c{c['config']}") for c in part])
        rows = F.explode(F.array(*[F.struct(F.lit(c["config"]).alias("config"), F.col(f"c{c['config']}").alias("pred")) for c in part]))
        got = counts.select(F.col(scene).alias("scene"), rows.alias("_r")).select("_r.config", "scene", "_r.pred")
        out = got if out is None else out.unionByName(got)
    return out
