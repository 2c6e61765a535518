"""Queries over raster tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions import geo, maths, text
from tidelight.operators import detections as de
from tidelight.operators import raster as ra
from tidelight.plans import geodesy
from tidelight.plans.base import BOXES, PIXELS, Tables, query
from tidelight.session import cut

BRIGHT, RES = 64, 3.0
MIN_AREA = 6 * RES * RES

# Bright runs per row, their 8-connected components by smallest id, and land = large components.
RUNS = f"""{PIXELS}, r1 AS (SELECT scene_id, row, col, col - row_number() OVER (PARTITION BY scene_id, row ORDER BY col) AS g FROM px WHERE valid AND nir > {BRIGHT}),
ru AS (SELECT scene_id, row, min(col) AS c0, max(col) AS c1, scene_id * 1000000 + row * 1000 + min(col) AS id FROM r1 GROUP BY scene_id, row, g),
ed AS (SELECT a.id AS a, b.id AS b FROM ru a JOIN ru b ON a.scene_id = b.scene_id AND abs(a.row - b.row) = 1 AND a.c0 <= b.c1 + 1 AND a.c1 >= b.c0 - 1),
rc(id, lab) AS (SELECT id, id FROM ru UNION SELECT ed.b, rc.lab FROM rc JOIN ed ON ed.a = rc.id WHERE rc.lab < ed.b)"""
LABELS = f"""{RUNS}, lb AS (SELECT ru.scene_id, ru.row, ru.c0, ru.c1, l.lab FROM ru JOIN (SELECT id, min(lab) AS lab FROM rc GROUP BY 1) l USING (id)),
co AS (SELECT scene_id, lab, sum(c1 - c0 + 1) AS n_px FROM lb GROUP BY 1, 2)"""
LAND = f"{LABELS}, la AS (SELECT lb.* FROM lb JOIN co ON co.scene_id = lb.scene_id AND co.lab = lb.lab WHERE n_px >= 6)"


def _land(t: Tables):
    return ra.land_runs(t.pixels(), BRIGHT, RES, MIN_AREA)


@query(f"WITH RECURSIVE {LABELS} SELECT scene_id, CAST(lab % 1000000 // 1000 AS INTEGER) AS label_row, CAST(lab % 1000 AS INTEGER) AS label_col, CAST(n_px AS BIGINT) AS n_px FROM co")
def raster_components(t: Tables):
    p = t.pixels()
    c = ra.sized_components(ra.label_runs(ra.runs_of(p, F.col("valid") & (F.col("nir") > BRIGHT))))
    return c.select("scene_id", F.col("label.row").alias("label_row"), F.col("label.c0").alias("label_col"), "n_px")


@query(f"WITH RECURSIVE {LABELS} SELECT scene_id, count(*) FILTER (WHERE n_px >= 6) AS n_land, count(*) FILTER (WHERE n_px < 6) AS n_small FROM co GROUP BY 1")
def land_report(t: Tables):
    return _land(t)[1]


# A disk of two pixels: row offset -> half width.
DISK = "dk(d, w) AS (VALUES (-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0))"
WATER = f"""{LAND}, {DISK}, nr AS (SELECT DISTINCT scene_id, row + d AS row, unnest(generate_series(c0 - w, c1 + w)) AS col FROM la, dk),
wa AS (SELECT px.*, nr.col IS NOT NULL AS near_land, valid AND nr.col IS NULL AND clear AS water FROM px LEFT JOIN nr ON nr.scene_id = px.scene_id AND nr.row = px.row AND nr.col = px.col)"""


def _water(t: Tables):
    land = cut(_land(t)[0], "land")
    return cut(ra.water_mask(t.pixels(), land, 6.0, RES), "masked"), land


@query(f"WITH RECURSIVE {WATER} SELECT scene_id, row, col, near_land, water FROM wa")
def water_mask(t: Tables):
    return _water(t)[0].select("scene_id", "row", "col", "near_land", "water")


@query(f"""WITH RECURSIVE {WATER}, ls AS (SELECT scene_id, sum(c1 - c0 + 1) AS n FROM la GROUP BY 1) SELECT wa.scene_id, count(*) FILTER (WHERE valid) AS valid_px, count(*) FILTER (WHERE water) AS water_px,
count(*) FILTER (WHERE near_land) - CAST(coalesce(max(n), 0) AS BIGINT) AS buffered_px, count(*) FILTER (WHERE valid AND NOT near_land AND NOT clear) AS cloud_px, CAST(coalesce(max(n), 0) AS BIGINT) AS land_px FROM wa LEFT JOIN ls ON ls.scene_id = wa.scene_id GROUP BY 1""")
def water_mask_report(t: Tables):
    return ra.mask_report(*_water(t))


THRESH = f"""{WATER}, md AS (SELECT scene_id, median(nir) AS med, avg(nir) AS mn, count(*) AS n_px FROM wa WHERE water GROUP BY 1),
th AS (SELECT wa.scene_id, med, max(md.n_px) AS n_px, median(abs(nir - med)) AS mad, stddev_pop(nir) AS sd FROM wa JOIN md ON md.scene_id = wa.scene_id WHERE water GROUP BY 1, 2),
tt AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END AS sigma FROM th)"""


def _threshold(masked, n_mad=1.2):
    return ra.robust_threshold(masked.where("water"), "nir", n_mad)


@query(f"WITH RECURSIVE {THRESH} SELECT scene_id, med, n_px, mad, sigma, med + 1.2 * sigma AS threshold FROM tt", floats=["med", "mad", "sigma", "threshold"])
def robust_thresholds(t: Tables):
    return _threshold(_water(t)[0])


BLOBS = f"""{THRESH}, h1 AS (SELECT wa.scene_id, row, col, nir, med, sigma, col - row_number() OVER (PARTITION BY wa.scene_id, row ORDER BY col) AS g FROM wa JOIN tt ON tt.scene_id = wa.scene_id WHERE water AND nir >= med + 1.2 * sigma),
hr AS (SELECT scene_id, row, min(col) AS c0, max(col) AS c1, scene_id * 1000000 + row * 1000 + min(col) AS id FROM h1 GROUP BY scene_id, row, g),
he AS (SELECT a.id AS a, b.id AS b FROM hr a JOIN hr b ON a.scene_id = b.scene_id AND abs(a.row - b.row) = 1 AND a.c0 <= b.c1 + 1 AND a.c1 >= b.c0 - 1),
hc(id, lab) AS (SELECT id, id FROM hr UNION SELECT he.b, hc.lab FROM hc JOIN he ON he.a = hc.id WHERE hc.lab < he.b),
hl AS (SELECT id, min(lab) AS lab FROM hc GROUP BY 1), hp AS (SELECT h1.*, hl.lab FROM h1 JOIN hr ON hr.scene_id = h1.scene_id AND hr.row = h1.row AND h1.col BETWEEN hr.c0 AND hr.c1 JOIN hl ON hl.id = hr.id)"""


def _blobs(t: Tables):
    masked, _ = _water(t)
    return ra.blobs(masked, "nir", _threshold(masked), RES)


@query(f"""WITH RECURSIVE {BLOBS} SELECT scene_id, CAST(lab % 1000000 // 1000 AS INTEGER) AS label_row, CAST(lab % 1000 AS INTEGER) AS label_col, avg(row) AS row, avg(col) AS col, count(*) AS n_px, max(nir) AS nir_peak,
(max(nir) - min(med)) / min(sigma) AS nir_snr FROM hp GROUP BY 1, 2, 3""", floats=["row", "col", "nir_peak", "nir_snr"])
def bright_blobs(t: Tables):
    """Everything about the blobs except the rectangle, which a test checks against brute force."""
    return _blobs(t).select("scene_id", "label_row", "label_col", "row", "col", "n_px", "nir_peak", "nir_snr")


# Every directed edge with all points on its left is an edge of the hull; the rectangle along it spans the points' extents.
RECTS = f"""{BLOBS}, pt AS (SELECT DISTINCT scene_id, lab, row AS x, col AS y FROM hp),
eg AS (SELECT p.scene_id, p.lab, p.x AS px, p.y AS py, (q.x - p.x) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS u, (q.y - p.y) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS v, q.x AS qx, q.y AS qy
  FROM pt p JOIN pt q ON p.scene_id = q.scene_id AND p.lab = q.lab AND (p.x, p.y) <> (q.x, q.y)),
ex AS (SELECT eg.scene_id, eg.lab, px, py, qx, qy, max(r.x * u + r.y * v) - min(r.x * u + r.y * v) AS s, max(r.y * u - r.x * v) - min(r.y * u - r.x * v) AS t FROM eg JOIN pt r ON r.scene_id = eg.scene_id AND r.lab = eg.lab
  GROUP BY ALL HAVING min((qx - px) * (r.y - py) - (qy - py) * (r.x - px)) >= 0),
rg AS (SELECT scene_id, lab, arg_min(greatest(s, t), (round(s * t, 9), round(greatest(s, t), 9))) AS a, arg_min(least(s, t), (round(s * t, 9), round(greatest(s, t), 9))) AS b FROM ex GROUP BY 1, 2),
bb AS (SELECT hp.scene_id, hp.lab, count(*) AS n_px, coalesce(max(a), 0) + 1 AS long_px, coalesce(max(b), 0) + 1 AS short_px FROM hp LEFT JOIN rg ON rg.scene_id = hp.scene_id AND rg.lab = hp.lab GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {RECTS} SELECT scene_id, CAST(lab % 1000000 // 1000 AS INTEGER) AS label_row, CAST(lab % 1000 AS INTEGER) AS label_col, long_px * {RES} AS length_m, short_px * {RES} AS width_m, n_px / (long_px * short_px) AS fill FROM bb",
       floats=["length_m", "width_m", "fill"])
def blob_rectangles(t: Tables):
    """Sides and fill of the smallest rectangle around every blob."""
    return _blobs(t).select("scene_id", "label_row", "label_col", "length_m", "width_m", "fill")


@query(f"""WITH RECURSIVE {RECTS} SELECT reject_reason, count(*) AS n_rows FROM (SELECT CASE WHEN n_px < 2 THEN 'too_few_px' WHEN long_px * {RES} < {fixed.MIN_LENGTH_M} THEN 'sub_pixel_length' WHEN long_px * {RES} > 60 THEN 'implausible_length'
WHEN long_px / greatest(short_px, 1e-6 / {RES}) > {fixed.BLOB_MAX_ASPECT} THEN 'too_elongated' WHEN n_px / (long_px * short_px) < {fixed.BLOB_MIN_FILL} THEN 'too_sparse' ELSE 'kept' END AS reject_reason FROM bb) GROUP BY 1""")
def blob_reasons(t: Tables):
    b = de.blob_reasons(_blobs(t), min_px=2, max_m=60.0)
    return b.groupBy("reject_reason").agg(F.count("*").alias("n_rows"))


@query(f"WITH {PIXELS} SELECT scene_id, avg(CASE WHEN green + nir <> 0 THEN CAST((green - nir) / (green + nir) < 0 AS INTEGER) END) AS land_share FROM px WHERE valid GROUP BY 1", floats=["land_share"])
def ndwi_land_share(t: Tables):
    return ra.ndwi_land(t.pixels())


# ---- boxes on pixels ---------------------------------------------------------------------------

UNDER = f"""{PIXELS}, {BOXES}, md AS (SELECT scene_id, median(nir) AS med FROM px WHERE valid GROUP BY 1), tt AS (SELECT px.scene_id, med, med + 2 * 1.4826 * median(abs(nir - med)) AS threshold FROM px JOIN md ON md.scene_id = px.scene_id WHERE valid GROUP BY 1, 2),
un AS (SELECT b.scene_id, b.box, count(px.nir) AS n_px, max(px.nir) AS nir_peak, count(*) FILTER (WHERE px.nir > tt.threshold) AS bright_px, max(med) AS med FROM bx b LEFT JOIN tt ON tt.scene_id = b.scene_id LEFT JOIN px
ON px.scene_id = b.scene_id AND px.row >= floor(y1) AND px.row < ceil(y2) + 1 AND px.col >= floor(x1) AND px.col < ceil(x2) + 1 GROUP BY 1, 2)"""


@query(f"""WITH {UNDER} SELECT scene_id, box, nir_peak, bright_px, coalesce(bright_px / nullif(n_px, 0), 0) AS nir_fill, CASE WHEN n_px > 0 AND med > 0 THEN nir_peak / med END AS nir_x_water,
CASE WHEN bright_px = 0 THEN 'none' WHEN bright_px <= 2 THEN 'weak' ELSE 'strong' END AS nir_support, CAST(bright_px = 0 AS INTEGER) AS possible_false_positive FROM un""", floats=["nir_fill", "nir_x_water"])
def box_evidence(t: Tables):
    p = t.pixels()
    th = ra.robust_threshold(p.where("valid"), "nir", 2.0)
    return ra.box_support(t.boxes(), p, th).select("scene_id", "box", "nir_peak", "bright_px", "nir_fill", "nir_x_water", "nir_support", "possible_false_positive")


@query(f"""WITH {PIXELS}, {BOXES}, c AS (SELECT scene_id, box, greatest(0, least(63, CAST(round_even((y1 + y2) / 2, 0) AS INTEGER))) AS r, greatest(0, least(63, CAST(round_even((x1 + x2) / 2, 0) AS INTEGER))) AS k FROM bx)
SELECT c.scene_id, box, valid, clear FROM c LEFT JOIN px ON px.scene_id = c.scene_id AND px.row = r AND px.col = k""")
def box_centre_masks(t: Tables):
    return ra.at_box_centre(t.boxes(), t.pixels(), ["valid", "clear"], 64, 64).select("scene_id", "box", "valid", "clear")


@query(f"""WITH RECURSIVE {WATER}, {BOXES}, pk AS (SELECT b.scene_id, b.box, max(px.nir) AS p FROM bx b LEFT JOIN px ON px.scene_id = b.scene_id AND px.row >= floor(y1) AND px.row < ceil(y2) + 1 AND px.col >= floor(x1) AND px.col < ceil(x2) + 1 GROUP BY 1, 2)
SELECT scene_id, box, CASE WHEN (SELECT count(*) FROM wa WHERE wa.scene_id = pk.scene_id AND water) > 0 THEN (SELECT count(*) FROM wa WHERE wa.scene_id = pk.scene_id AND water AND nir < pk.p) / (SELECT count(*) FROM wa WHERE wa.scene_id = pk.scene_id AND water) END AS nir_pct FROM pk""", floats=["nir_pct"])
def box_water_quantiles(t: Tables):
    masked, _ = _water(t)
    b = t.boxes()
    got = ra.box_pixels(b.select("scene_id", "box", "x1", "y1", "x2", "y2"), t.pixels().select("scene_id", "row", "col", "nir")).groupBy("scene_id", "box").agg(F.max("nir").alias("nir_peak"))
    peaks = b.select("scene_id", "box").join(got, ["scene_id", "box"], "left")
    return ra.water_quantile(peaks, masked).select("scene_id", "box", "nir_pct")


@query(f"""WITH RECURSIVE {WATER}, {BOXES}, c AS (SELECT scene_id, box, greatest(0, least(63, CAST(round_even((y1 + y2) / 2, 0) AS INTEGER))) AS r, greatest(0, least(63, CAST(round_even((x1 + x2) / 2, 0) AS INTEGER))) AS k FROM bx)
SELECT c.scene_id, box, sqrt(min((row - r) * (row - r) + (col - k) * (col - k))) * 3 AS shore_m FROM c LEFT JOIN wa ON wa.scene_id = c.scene_id AND NOT water GROUP BY 1, 2""", floats=["shore_m"])
def box_shore_distance(t: Tables):
    masked, _ = _water(t)
    return ra.shore_distance(t.boxes(), masked, 64, 64, RES).select("scene_id", "box", "shore_m")


@query(f"""WITH {PIXELS}, q AS (SELECT scene_id, quantile_cont(nir, 0.01) AS lo, quantile_cont(nir, 0.995) AS hi FROM px WHERE valid GROUP BY 1)
SELECT px.scene_id, row, col, CASE WHEN valid THEN CAST(floor(greatest(0, least(255, (nir - lo) / greatest(hi - lo, 1) * 255))) AS INTEGER) ELSE 0 END AS stretched FROM px JOIN q ON q.scene_id = px.scene_id""")
def stretched_pixels(t: Tables):
    return ra.stretch(t.pixels(), "nir").select("scene_id", "row", "col", "stretched")


@query(f"""WITH {PIXELS}, g AS (SELECT scene_id, row // 8 AS ty, col // 8 AS tx, avg(CAST(valid AS INTEGER)) AS coverage, CAST(floor(quantile_cont(nir, 0.99) FILTER (WHERE valid)) AS BIGINT) AS p99 FROM px GROUP BY 1, 2, 3)
SELECT *, CASE WHEN coverage < 0.9 THEN 'nodata' WHEN p99 < 80 THEN 'flat' ELSE 'imagery' END AS tile_class FROM g""", floats=["coverage"])
def tile_classes(t: Tables):
    p = t.pixels().withColumn("ty", F.floor(F.col("row") / 8)).withColumn("tx", F.floor(F.col("col") / 8))
    return ra.tile_classes(p, ["scene_id", "ty", "tx"], "nir", 0.9, 80)


@query(f"""WITH {PIXELS}, a AS (SELECT s.scene_id, r, c FROM (SELECT DISTINCT scene_id FROM px) s, range(10, 74) t(r), range(5, 40) u(c)) SELECT a.scene_id, avg(CAST(coalesce(clear, false) AS INTEGER)) AS aoi_clear
FROM a LEFT JOIN px ON px.scene_id = a.scene_id AND px.row = r AND px.col = c GROUP BY 1""", floats=["aoi_clear"])
def aoi_clear_share(t: Tables):
    """The area reaches beyond the raster; cells outside count as not clear."""
    area = t.pixels().select("scene_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(10), F.lit(73)))).withColumn("col", F.explode(F.sequence(F.lit(5), F.lit(39))))
    return ra.clear_fraction(area, t.pixels())


@query(f"""WITH {PIXELS} SELECT scene_id, row, col, CASE WHEN scene_id % 2 = 0 THEN nir / 10000.0 ELSE nir * 2e-5 END AS rho, least(1.0, greatest(0.0, (CASE WHEN scene_id % 2 = 0 THEN nir / 10000.0 ELSE nir * 2e-5 END) * 100)) AS shown, nir > 0 AND green > 0 AS lit FROM px""",
       floats=["rho", "shown"], digits=9)
def reflectances(t: Tables):
    """Surface products are scaled by 10000, sensor products by the coefficient of their band."""
    kind = F.when(F.col("scene_id") % 2 == 0, "sr").otherwise("toa")
    rho = maths.reflectance(F.col("nir"), kind, F.lit(2e-5))
    return t.pixels().select("scene_id", "row", "col", rho.alias("rho"), maths.clip(rho * 100, 0.0, 1.0).alias("shown"), ((F.col("nir") > 0) & (F.col("green") > 0)).alias("lit"))


@query(f"""WITH {BOXES} SELECT box, corner, 500000 + 3 * (c + 0.5) AS x, 5400000 - 3 * (r + 0.5) AS y, least(least((x1 + x2) / 2, (y1 + y2) / 2), least(64 - (x1 + x2) / 2, 64 - (y1 + y2) / 2)) * 3 AS edge_m
FROM (SELECT *, unnest(['ul', 'ur', 'lr', 'll']) AS corner, unnest([x1, x2, x2, x1]) AS c, unnest([y1, y1, y2, y2]) AS r FROM bx)""", floats=["x", "y", "edge_m"])
def box_corner_points(t: Tables):
    b = t.boxes().withColumn("k", F.explode(geo.box_corners(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))))
    tr = {"a": F.lit(3.0), "b": F.lit(0.0), "c": F.lit(500_000.0), "d": F.lit(0.0), "e": F.lit(-3.0), "f": F.lit(5_400_000.0)}
    x, y = geo.affine_xy(F.col("k.col"), F.col("k.row"), tr)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return b.select("box", "k.corner", x.alias("x"), y.alias("y"), (F.least(cx, cy, 64 - cx, 64 - cy) * 3).alias("edge_m"))


_CORNERS = "(SELECT box, corner, 500000 + 3 * (c + 0.5) AS x, 5400000 - 3 * (r + 0.5) AS y FROM (SELECT *, unnest(['ul', 'ur', 'lr', 'll']) AS corner, unnest([x1, x2, x2, x1]) AS c, unnest([y1, y1, y2, y2]) AS r FROM bx))"


@query(f"WITH {BOXES} SELECT box, corner, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({geodesy.unproject(_CORNERS, 'x', 'y', 10)})")
def box_corner_lonlat(t: Tables):
    b = t.boxes().withColumn("k", F.explode(geo.box_corners(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))))
    tr = {"a": F.lit(3.0), "b": F.lit(0.0), "c": F.lit(500_000.0), "d": F.lit(0.0), "e": F.lit(-3.0), "f": F.lit(5_400_000.0)}
    x, y = geo.affine_xy(F.col("k.col"), F.col("k.row"), tr)
    ll = geo.utm_to_lonlat(x, y, F.lit(10))
    return b.withColumn("ll", ll).select("box", "k.corner", F.round("ll.lon", 6).alias("lon"), F.round("ll.lat", 6).alias("lat"))


_P5 = "(SELECT box, corner, 500000 + 3 * (c + 0.5) AS x, 5400000 - 3 * (r + 0.5) AS y FROM (SELECT box, unnest(['ul', 'ur', 'lr', 'll', 'centroid']) AS corner, unnest([x1, x2, x2, x1, (x1 + x2) / 2]) AS c, unnest([y1, y1, y2, y2, (y1 + y2) / 2]) AS r FROM bx))"
_PV = "(SELECT box, " + ", ".join(f"max({v}) FILTER (WHERE corner = '{c}') AS {c}_{v}" for c in ("ul", "ur", "lr", "ll", "centroid") for v in ("lon", "lat", "x", "y")) + f" FROM ({geodesy.unproject(_P5, 'x', 'y', 10)}) GROUP BY 1)"
_ORIGIN = (-122.9, 48.7)
_SIZE = "greatest(x2 - x1, y2 - y1) * 3"
RECORDS = f"""{UNDER}, gd AS ({geodesy.inverse(_PV, repr(_ORIGIN[0]), repr(_ORIGIN[1]), 'centroid_lon', 'centroid_lat')}), nb AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, box) AS i FROM bx)
SELECT nb.scene_id, 'T' || nb.scene_id AS acq_time_utc, 'boat_' || i AS detection_id, round(score, 4) AS confidence, {', '.join(f'round({c}_{v}, {6 if v in ("lon", "lat") else 2}) AS {c}_{v}' for c in ('ul', 'ur', 'lr', 'll', 'centroid') for v in ('lon', 'lat', 'x', 'y'))},
round(m, 1) AS range_m, round(m / 1000, 3) AS range_km, round(azimuth_deg, 2) AS bearing_deg_from_hydrophone, round((x2 - x1) * 3, 1) AS bbox_w_m, round((y2 - y1) * 3, 1) AS bbox_h_m, round({_SIZE}, 1) AS length_m,
round({_SIZE} / greatest(least(x2 - x1, y2 - y1) * 3, 1e-6), 2) AS aspect_ratio, round((x2 - x1) * 3 * ((y2 - y1) * 3), 1) AS area_m2, CASE WHEN {_SIZE} < 12 THEN '0-12m' WHEN {_SIZE} < 24 THEN '12-24m' ELSE '>24m' END AS size_class,
round(least((x1 + x2) / 2, (y1 + y2) / 2, 64 - (x1 + x2) / 2, 64 - (y1 + y2) / 2) * 3, 1) AS dist_to_scene_edge_m, un.nir_peak, round(CASE WHEN n_px > 0 AND un.med > 0 THEN un.nir_peak / un.med END, 1) AS nir_x_water,
bright_px AS nir_bright_px, round(coalesce(bright_px / nullif(n_px, 0), 0), 3) AS nir_fill, CASE WHEN bright_px = 0 THEN 'none' WHEN bright_px <= 2 THEN 'weak' ELSE 'strong' END AS nir_support, CAST(bright_px = 0 AS INTEGER) AS possible_false_positive,
round(threshold, 5) AS nir_threshold_rho, 640 AS slice_px, 640 AS imgsz, 0.05 AS conf_threshold, 'bgr' AS channel_order, CAST(NULL AS VARCHAR) AS weights_file
FROM nb JOIN un ON un.scene_id = nb.scene_id AND un.box = nb.box JOIN gd ON gd.box = nb.box LEFT JOIN tt ON tt.scene_id = nb.scene_id"""
_REC_F = ["confidence", *[f"{c}_{v}" for c in ("ul", "ur", "lr", "ll", "centroid") for v in ("lon", "lat", "x", "y")], "range_m", "range_km", "bearing_deg_from_hydrophone", "bbox_w_m", "bbox_h_m",
          "length_m", "aspect_ratio", "area_m2", "dist_to_scene_edge_m", "nir_x_water", "nir_fill", "nir_threshold_rho", "conf_threshold"]


@query(f"WITH {RECORDS}", floats=_REC_F)
def corner_records(t: Tables):
    """Every box as a row of the 46 hand-off columns, numbered by falling score."""
    p = t.pixels()
    th = ra.robust_threshold(p.where("valid"), "nir", 2.0)
    b = ra.box_support(t.boxes(), p, th).join(th.select("scene_id", "threshold"), "scene_id", "left").withColumn("acq_time_utc", F.concat(F.lit("T"), F.col("scene_id")))
    tr = {"a": F.lit(3.0), "b": F.lit(0.0), "c": F.lit(500_000.0), "d": F.lit(0.0), "e": F.lit(-3.0), "f": F.lit(5_400_000.0)}
    return de.corner_records(b, 3.0, 10, tr, _ORIGIN, (F.lit(64), F.lit(64)), run={"slice_px": 640, "imgsz": 640, "conf_threshold": 0.05, "channel_order": "bgr"})


_AXIS = "list_distinct(list_concat(generate_series(0, greatest(0, {e} - 20), 16), [greatest(0, {e} - 20)]))"


@query(f"""WITH s AS (SELECT p_partkey AS scene_id, 10 + p_size AS height, 5 + p_partkey % 90 AS width FROM part), x AS (SELECT scene_id, height, unnest({_AXIS.format(e='width')}) AS x0 FROM s) SELECT scene_id, x0, unnest({_AXIS.format(e='height')}) AS y0 FROM x""")
def scoring_tiles(t: Tables):
    s = t.raw("part").select(F.col("p_partkey").alias("scene_id"), (10 + F.col("p_size")).alias("height"), (5 + F.col("p_partkey") % 90).alias("width"))
    return geo.image_tiles(s, 20, 0.2, ("scene_id",))


TILED = f"""{PIXELS}, ax(s) AS (VALUES (0), (16), (32), (44)), tp AS (SELECT px.*, y.s AS y0, x.s AS x0 FROM px JOIN ax y ON row BETWEEN y.s AND y.s + 19 JOIN ax x ON col BETWEEN x.s AND x.s + 19),
bt AS (SELECT scene_id, y0, x0, max(nir) AS score, arg_max(row, (nir, -row, -col)) AS r, arg_max(col, (nir, -row, -col)) AS c FROM tp WHERE valid GROUP BY 1, 2, 3),
fb AS (SELECT scene_id, (y0::BIGINT * 1048576 + x0) * 1048576 AS box, c - 2 AS x1, r - 2 AS y1, c + 3 AS x2, r + 3 AS y2, score FROM bt),
cf AS (SELECT scene_id * 1000000000000000::HUGEINT + a.box AS winner, scene_id * 1000000000000000::HUGEINT + b.box AS loser FROM fb a JOIN fb b USING (scene_id) WHERE (a.score, a.box) > (b.score, b.box)
  AND greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / (50 - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) + 1e-9) >= 0.4),
st(kind, winner, loser) AS (SELECT 'open', winner, loser FROM cf UNION ALL (WITH o AS (SELECT winner, loser FROM st WHERE kind = 'open'), lost AS (SELECT DISTINCT loser FROM o WHERE winner NOT IN (SELECT loser FROM o))
  SELECT 'lost', NULL, loser FROM lost UNION ALL SELECT 'open', winner, loser FROM o WHERE loser NOT IN (SELECT loser FROM lost) AND winner NOT IN (SELECT loser FROM lost)))"""


@query(f"""WITH RECURSIVE {TILED} SELECT scene_id, x1, y1, x2, y2, score FROM fb WHERE scene_id * 1000000000000000::HUGEINT + box NOT IN (SELECT loser FROM st WHERE kind = 'lost')""", floats=["x1", "y1", "x2", "y2", "score"])
def tiled_scoring(t: Tables):
    """A user's scorer (here the brightest valid pixel) on overlapping tiles over all pixels; what two tiles find of one object counts once."""
    from tidelight.operators.scoring import score_overlapping

    def model(pixels):
        p = pixels[pixels["valid"]].sort_values(["nir", "row", "col"], ascending=[False, True, True])
        r, c = float(p["row"].iloc[0] - p["y0"].iloc[0]), float(p["col"].iloc[0] - p["x0"].iloc[0])
        return [(c - 2, r - 2, c + 3, r + 3, float(p["nir"].iloc[0]))]

    px = t.pixels().select("scene_id", "row", "col", "nir", "valid")
    scenes = px.select("scene_id").distinct().withColumns({"height": F.lit(64), "width": F.lit(64)})
    return score_overlapping(px, scenes, model, 20, 0.2, iou=0.4)


@query("""WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/20230715_190458_12_2439_3B_AnalyticMS_SR_clip.tif' WHEN 1 THEN 'b/c/20200730_184501_1009_3B_AnalyticMS_clip.tif' ELSE 'x/scene_Visual.tif' END AS path FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '20230715_190458_12_2439' WHEN 1 THEN '20200730_184501_1009' ELSE 'scene' END AS scene_id, CASE page_id % 3 WHEN 0 THEN '2023-07-15T19:04:58Z' WHEN 1 THEN '2020-07-30T18:45:01Z' ELSE '' END AS acquired_text,
CASE page_id % 3 WHEN 0 THEN 'sr' ELSE 'toa' END AS kind, CASE page_id % 3 WHEN 0 THEN 'a/20230715_190458_12_2439_3B_udm2_clip.tif' WHEN 1 THEN 'b/c/20200730_184501_1009_3B_udm2_clip.tif' ELSE 'x/scene_Visual.tif' END AS mask, [2e-5, 3e-5 + page_id] AS coefs FROM d""")
def scene_file_names(t: Tables):
    path = (F.when(F.col("page_id") % 3 == 0, "a/20230715_190458_12_2439_3B_AnalyticMS_SR_clip.tif").when(F.col("page_id") % 3 == 1, "b/c/20200730_184501_1009_3B_AnalyticMS_clip.tif")
            .otherwise("x/scene_Visual.tif"))
    band = lambda i, v: F.concat(F.lit(f"<ps:bandNumber>{i}</ps:bandNumber><ps:reflectanceCoefficient>"), v, F.lit("</ps:reflectanceCoefficient>"))
    xml = F.concat(band(1, F.lit("2e-5")), band(2, (F.lit(3e-5) + F.col("page_id")).cast("string")), band(3, F.lit("1")), band(4, F.lit("1")))
    p = t.raw("pages").withColumn("path", path).withColumn("m", text.scene_meta(path)).withColumn("c", text.band_coefficients(xml))
    return p.select("page_id", "m.scene_id", "m.acquired_text", text.product_kind(F.col("path")).alias("kind"), text.mask_sibling(F.col("path")).alias("mask"), F.array(F.col("c")[1], F.col("c")[2]).alias("coefs"))
