"""Queries over detections: filters, matching, persistence, scene classes, configuration sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight.functions import geo, maths
from tidelight.operators import detections as de
from tidelight.operators import estimators as es
from tidelight.operators import sweeps
from tidelight.operators.guards import tally
from tidelight.plans import geodesy
from tidelight.plans.base import BOXES, MARKS, Tables, query
from tidelight.session import cut

SCENE = ["scene_id"]


def _side(t: Tables, which: str, prefix: str):
    m = t.marks().where(F.col("side") == which)
    return m.withColumnsRenamed({"x": f"{prefix}x", "y": f"{prefix}y", "id": prefix})


A = "a AS (SELECT *, id AS a FROM mk WHERE side = 'A')"
B = "b AS (SELECT *, id AS b FROM mk WHERE side = 'B')"
PAIRS = f"""{MARKS}, {A}, {B}, pairs AS (SELECT a.scene_id, a.a, b.b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM a JOIN b ON a.scene_id = b.scene_id
AND b.x BETWEEN a.x - 40 AND a.x + 40 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 40)"""


def _match(ra: str, rb: str) -> str:
    return f"""st(kind, scene_id, a, b, d) AS (SELECT 'open', scene_id, a, b, d FROM pairs UNION ALL
(WITH o AS (SELECT scene_id, a, b, d FROM st WHERE kind = 'open'), pa AS (SELECT scene_id, a, arg_min(b, {ra}) AS b FROM o GROUP BY 1, 2), pb AS (SELECT scene_id, b, arg_min(a, {rb}) AS a FROM o GROUP BY 1, 2),
acc AS (SELECT pa.scene_id, pa.a, pa.b FROM pa JOIN pb ON pa.scene_id = pb.scene_id AND pa.a = pb.a AND pa.b = pb.b)
SELECT 'acc', o.scene_id, o.a, o.b, o.d FROM o JOIN acc ON acc.scene_id = o.scene_id AND acc.a = o.a AND acc.b = o.b
UNION ALL SELECT 'open', scene_id, a, b, d FROM o WHERE (scene_id, a) NOT IN (SELECT (scene_id, a) FROM acc) AND (scene_id, b) NOT IN (SELECT (scene_id, b) FROM acc)))"""


GREEDY = f"{PAIRS}, {_match('(d, a, b)', '(d, a, b)')}, mt AS (SELECT scene_id, a, b, d FROM st WHERE kind = 'acc')"


def _matches(t: Tables):
    return de.match_by_distance(_side(t, "A", "a"), _side(t, "B", "b"), SCENE, 40.0)


@query(f"WITH RECURSIVE {GREEDY} SELECT * FROM mt", floats=["d"])
def matched_by_distance(t: Tables):
    return _matches(t).select("scene_id", "a", "b", "d")


@query(f"""WITH RECURSIVE {GREEDY}, na AS (SELECT scene_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT scene_id, count(*) AS n FROM b GROUP BY 1), nm AS (SELECT scene_id, count(*) AS n FROM mt GROUP BY 1)
SELECT na.scene_id, na.n AS n_a, nb.n AS n_b, coalesce(nm.n, 0) AS n_both, na.n + nb.n - coalesce(nm.n, 0) AS n_any FROM na JOIN nb USING (scene_id) LEFT JOIN nm USING (scene_id)""")
def fused_scene_counts(t: Tables):
    return de.fused_counts(_side(t, "A", "a"), _side(t, "B", "b"), _matches(t), SCENE)


HAV = """2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b.lat) / 2 - radians(a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) * 1000"""
TURN = f"""{MARKS}, {A}, {B}, pairs AS (SELECT a.scene_id, a.a, b.b, {HAV} AS d FROM a JOIN b ON a.scene_id = b.scene_id AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001
AND {HAV} <= 30), {_match('(d, b)', 'a')}, mt AS (SELECT scene_id, a, b, d FROM st WHERE kind = 'acc')"""


def _in_turn(t: Tables, metres=None):
    a = _side(t, "A", "a").withColumnsRenamed({"lon": "alon", "lat": "alat"}).withColumn("a_seq", F.col("a"))
    b = _side(t, "B", "b").withColumnsRenamed({"lon": "blon", "lat": "blat"})
    flat = lambda df, p: df.withColumns(dict(zip((f"{p}x", f"{p}y"), geo.local_metres(F.col(f"{p}lon"), F.col(f"{p}lat"), F.lit(48.81)))))
    return de.match_in_turn(flat(a, "a"), flat(b, "b").select("scene_id", "b", "bx", "by", "blon", "blat"), SCENE, 30.0, metres=metres)


def _haversine_m():
    return geo.haversine_km(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")) * 1000


@query(f"WITH RECURSIVE {TURN} SELECT * FROM mt", floats=["d"], digits=4)
def matched_in_turn(t: Tables):
    return _in_turn(t, _haversine_m()).select("scene_id", "a", "b", "d")


@query(f"""WITH RECURSIVE {TURN} SELECT detector, count(*) AS n_rows, CAST(sum(snr) AS BIGINT) AS snr_total FROM (SELECT CASE WHEN mt.b IS NULL THEN 'A' ELSE 'AB' END AS detector, round(b.nir_snr) AS snr FROM a LEFT JOIN mt ON mt.scene_id = a.scene_id AND mt.a = a.a LEFT JOIN b ON b.scene_id = mt.scene_id AND b.b = mt.b
UNION ALL SELECT 'B', round(nir_snr) FROM b WHERE (scene_id, b.b) NOT IN (SELECT (scene_id, mt.b) FROM mt)) GROUP BY 1""")
def fusion_tally(t: Tables):
    m = cut(_in_turn(t, _haversine_m()), "matches")
    f = de.fuse(_side(t, "A", "a"), _side(t, "B", "b"), m, SCENE)
    return f.groupBy("detector").agg(F.count("*").alias("n_rows"), F.sum(F.round("nir_snr").cast("bigint")).alias("snr_total"))


_NEAR = f"(SELECT a.scene_id, a.a, b.b, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM a JOIN b ON a.scene_id = b.scene_id AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND {HAV} <= 40)"
ELLIPSOID = f"""{MARKS}, {A}, {B}, pairs AS (SELECT scene_id, a, b, m AS d FROM ({geodesy.inverse(_NEAR, 'lon1', 'lat1', 'lon2', 'lat2')}) WHERE m <= 30),
{_match('(d, b)', 'a')}, mt AS (SELECT scene_id, a, b FROM st WHERE kind = 'acc')"""


@query(f"""WITH RECURSIVE {ELLIPSOID} SELECT detector, count(*) AS n_rows FROM (SELECT CASE WHEN mt.b IS NULL THEN 'A' ELSE 'AB' END AS detector FROM a LEFT JOIN mt ON mt.scene_id = a.scene_id AND mt.a = a.a
UNION ALL SELECT 'B' FROM b WHERE (scene_id, b.b) NOT IN (SELECT (scene_id, mt.b) FROM mt)) GROUP BY 1""")
def geodesic_fusion(t: Tables):
    """The fusion tally with geodesic distances."""
    m = cut(_in_turn(t), "matches")
    return de.fusion_tally(de.fuse(_side(t, "A", "a"), _side(t, "B", "b"), m, SCENE))


@query(f"WITH {MARKS} SELECT id, round(m / 1000, 3) AS range_km, round(azimuth_deg, 2) AS bearing_deg FROM ({geodesy.inverse('mk', '-125.28', '48.81', 'lon', 'lat')})")
def ranges_and_bearings(t: Tables):
    d = de.with_range(t.marks(), -125.28, 48.81)
    return d.select("id", F.round("range_km", 3).alias("range_km"), F.round("bearing_deg", 2).alias("bearing_deg"))


@query(f"""WITH {MARKS} SELECT id, 2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians(lat) - radians(48.81)) / 2), 2) + cos(radians(48.81)) * cos(radians(lat)) * power(sin(radians(lon + 125.28) / 2), 2)))) AS km,
1 / (1 + exp(-2 * nir_snr / 10)) * 2 - 1 AS squash, sqrt(length_m / pi()) AS radius FROM mk""", floats=["km", "squash", "radius"])
def haversine_ranges(t: Tables):
    return t.marks().select("id", geo.haversine_km(F.lit(-125.28), F.lit(48.81), F.col("lon"), F.col("lat")).alias("km"),
                            maths.squash_snr(F.col("nir_snr")).alias("squash"), maths.implied_radius_km(F.col("length_m")).alias("radius"))


HULL = f"""{MARKS}, {A}, {B}, nr AS (SELECT a.scene_id, a.a, b.b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d, b.fill, b.nir_snr, b.length_m, 0.5 * greatest(a.length_m, a.width_m) + 30 AS radius
FROM a JOIN b ON a.scene_id = b.scene_id AND b.x BETWEEN a.x - 60 AND a.x + 60 WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 0.5 * greatest(a.length_m, a.width_m) + 30)"""


def _wakes(t: Tables):
    return _side(t, "A", "a").withColumn("w_m", F.col("length_m")).withColumn("h_m", F.col("width_m")).select("scene_id", "a", "ax", "ay", "w_m", "h_m")


def _hulls(t: Tables):
    return _side(t, "B", "b").select("scene_id", "b", "bx", "by", "fill", "nir_snr", "length_m")


def _pick_sql(key: str) -> str:
    return f"""WITH {HULL}, g AS (SELECT scene_id, a, count(*) AS n, max(({key}, -b)) AS k, arg_max(length_m, ({key}, -b)) AS hl, arg_max(d, ({key}, -b)) AS hd FROM nr GROUP BY 1, 2)
SELECT a.scene_id, a.a, 0.5 * greatest(a.length_m, a.width_m) + 30 AS radius, coalesce(n, 0) AS n_candidates, -k[2] AS hull, hl AS hull_length_m, hd AS hull_offset_m, CASE WHEN n > 0 THEN 'AB' ELSE 'A' END AS detector FROM a LEFT JOIN g ON g.scene_id = a.scene_id AND g.a = a.a"""


_HULL_F = ["radius", "hull_length_m", "hull_offset_m"]
_HULL_COLS = ["scene_id", "a", "radius", "n_candidates", "hull", "hull_length_m", "hull_offset_m", "detector"]


@query(_pick_sql("fill"), floats=_HULL_F)
def hulls_by_fill(t: Tables):
    return de.pick_hulls(_wakes(t), _hulls(t), SCENE, "fill").select(*_HULL_COLS)


@query(_pick_sql("nir_snr"), floats=_HULL_F)
def hulls_by_snr(t: Tables):
    return de.pick_hulls(_wakes(t), _hulls(t), SCENE, "snr").select(*_HULL_COLS)


@query(_pick_sql("-length_m"), floats=_HULL_F)
def hulls_by_size(t: Tables):
    return de.pick_hulls(_wakes(t), _hulls(t), SCENE, "small").select(*_HULL_COLS)


@query(f"""WITH {HULL} SELECT * FROM (SELECT scene_id, a, b, d, row_number() OVER (PARTITION BY scene_id, a ORDER BY d, b) AS place, count(*) OVER (PARTITION BY scene_id, a) AS n_candidates FROM nr) WHERE n_candidates >= 2""", floats=["d"])
def ambiguous_hulls(t: Tables):
    return de.ranked_hulls(_wakes(t), _hulls(t), SCENE, only_ambiguous=True).select("scene_id", "a", "b", "d", "place", "n_candidates")


@query(f"""WITH {MARKS}, {A}, {B} SELECT s.scene_id, sum(CASE WHEN s.side = 'A' THEN hit END) / count(*) FILTER (WHERE s.side = 'A') AS share_a, sum(CASE WHEN s.side = 'B' THEN hit END) / count(*) FILTER (WHERE s.side = 'B') AS share_b
FROM (SELECT scene_id, 'A' AS side, CAST(EXISTS (SELECT 1 FROM b WHERE b.scene_id = a.scene_id AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 25) AS INTEGER) AS hit FROM a
UNION ALL SELECT scene_id, 'B', CAST(EXISTS (SELECT 1 FROM a WHERE b.scene_id = a.scene_id AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 25) AS INTEGER) FROM b) s GROUP BY 1""", floats=["share_a", "share_b"])
def detector_agreement(t: Tables):
    return de.agreement(_side(t, "A", "a"), _side(t, "B", "b"), SCENE, 25.0)


@query(f"""WITH RECURSIVE {BOXES}, cf AS (SELECT a.box AS winner, b.box AS loser FROM bx a JOIN bx b ON a.scene_id = b.scene_id AND (a.score, a.box) > (b.score, b.box)
WHERE greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
- greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) + 1e-9) >= 0.2),
st(kind, winner, loser) AS (SELECT 'open', winner, loser FROM cf UNION ALL (WITH o AS (SELECT winner, loser FROM st WHERE kind = 'open'), lost AS (SELECT DISTINCT loser FROM o WHERE winner NOT IN (SELECT loser FROM o))
SELECT 'lost', NULL, loser FROM lost UNION ALL SELECT 'open', winner, loser FROM o WHERE loser NOT IN (SELECT loser FROM lost) AND winner NOT IN (SELECT loser FROM lost)))
SELECT scene_id, box, score FROM bx WHERE box NOT IN (SELECT loser FROM st WHERE kind = 'lost')""", floats=["score"])
def suppressed_boxes(t: Tables):
    return de.suppress_overlaps(t.boxes(), SCENE, iou=0.2).select("scene_id", "box", "score")


# ---- filters -----------------------------------------------------------------------------------

FLAGS = f"""{MARKS}, f AS (SELECT *, id % 17 <> 0 AS in_valid, id % 5 <> 0 AS in_clear, id % 3 <> 0 AS in_water, length_m / width_m AS aspect_ratio, (id % 101) / 100 AS nir_pct, id % 60 * 1.0 AS shore_m FROM mk)"""


def _flags(t: Tables):
    i = F.col("id")
    return t.marks().withColumns({
        "in_valid": i % 17 != 0, "in_clear": i % 5 != 0, "in_water": i % 3 != 0, "aspect_ratio": F.col("length_m") / F.col("width_m"),
        "nir_pct": (i % 101) / 100, "shore_m": (i % 60).cast("double")})


@query(f"""WITH {FLAGS} SELECT id, score, length_m FROM f WHERE score >= 0.95 AND in_valid AND in_water AND length_m BETWEEN 10 AND 40 AND aspect_ratio <= 3 AND nir_pct >= 0.5 AND shore_m >= 15""", floats=["score", "length_m"])
def selected_boxes(t: Tables):
    got = de.select_boxes(_flags(t), conf=0.95, mask="water", min_len=10, max_len=40, max_aspect=3, nir_pct=0.5, shore_m=15.0)
    return got.select("id", "score", "length_m")


@query(f"""WITH {FLAGS} SELECT reject_reason, count(*) AS n_rows FROM (SELECT CASE WHEN NOT in_valid THEN 'outside_valid' WHEN NOT in_water THEN 'outside_water' WHEN length_m < 6 THEN 'sub_pixel_length'
WHEN length_m > 45 THEN 'implausible_length' ELSE 'kept' END AS reject_reason FROM f) GROUP BY 1""")
def box_reject_tally(t: Tables):
    return tally(de.box_reasons(_flags(t), 6, 45), "reject_reason")


@query(f"""WITH {MARKS} SELECT reject_reason, count(*) AS n_rows FROM (SELECT CASE WHEN id % 9 < 2 THEN 'too_few_px' WHEN length_m < 6 THEN 'sub_pixel_length' WHEN length_m > 45 THEN 'implausible_length'
WHEN length_m / greatest(width_m, 1e-6) > 3.5 THEN 'too_elongated' WHEN fill < 3 THEN 'too_sparse' ELSE 'kept' END AS reject_reason FROM mk) GROUP BY 1""")
def blob_reject_tally(t: Tables):
    return tally(de.blob_reasons(t.marks().withColumn("n_px", F.col("id") % 9), 2, 6, 45, 3.5, 3), "reject_reason")


@query(f"""WITH {MARKS} SELECT size_class, count(*) AS n_rows FROM (SELECT CASE WHEN length_m < 12 THEN '0-12m' WHEN length_m < 24 THEN '12-24m' ELSE '>24m' END AS size_class FROM mk) GROUP BY 1""")
def size_class_tally(t: Tables):
    return de.select_size_classes(t.marks(), ("0-12m",))[1]


@query(f"""WITH {BOXES} SELECT box, round((x2 - x1) * 3, 1) AS bbox_w_m, round((y2 - y1) * 3, 1) AS bbox_h_m, round(greatest(x2 - x1, y2 - y1) * 3, 1) AS length_class_m,
round(greatest(x2 - x1, y2 - y1) * 3 / greatest(least(x2 - x1, y2 - y1) * 3, 1e-6), 2) AS aspect_ratio, CAST(greatest(x2 - x1, y2 - y1) / least(x2 - x1, y2 - y1) >= 2.5 AS INTEGER) AS wake_flag,
round(score, 4) AS confidence, 'A' AS detector FROM bx""", floats=["bbox_w_m", "bbox_h_m", "length_class_m", "aspect_ratio", "confidence"], digits=4)
def box_detections(t: Tables):
    return de.to_detection(t.boxes(), 3.0, "A").select("box", "bbox_w_m", "bbox_h_m", "length_class_m", "aspect_ratio", "wake_flag", "confidence", "detector")


@query(f"""WITH {MARKS}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, id) AS rank FROM mk WHERE side = 'A') SELECT id, rank, scene_id || ':' || lpad(CAST(rank - 1 AS VARCHAR), 4, '0') AS detection_id FROM r""")
def ranked_detection_ids(t: Tables):
    return de.scene_ids(t.marks().where("side = 'A'"), "scene_id", [F.desc("score"), F.col("id")]).select("id", "rank", "detection_id")


@query(f"""WITH {MARKS} SELECT coalesce(s.s_name, CAST(m.scene_id AS VARCHAR)) AS scene_id, m.id AS detection_id, length_m AS length_class_m, length_m / 3 AS length_px, CASE WHEN length_m < 12 THEN '0-12m' WHEN length_m < 24 THEN '12-24m' ELSE '>24m' END AS size_class,
m.score AS confidence FROM mk m LEFT JOIN supplier s ON s.s_suppkey = m.scene_id AND s.s_nationkey < 12 WHERE side = 'A'""", floats=["length_class_m", "length_px", "confidence"])
def public_detections(t: Tables):
    names = t.raw("supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("scene_id"), F.col("s_name").alias("mapped_id"))
    m = t.marks().where("side = 'A'").select("scene_id", F.col("id").alias("detection_id"), F.col("length_m").alias("length_class_m"), F.col("score").alias("confidence"), "nir_snr")
    return de.public_view(de.without_evidence(m), names, 3.0)


# ---- persistence and scene classes ---------------------------------------------------------------

PERSIST = f"""{MARKS}, c AS (SELECT *, CAST(round_even(lat / 0.00045, 0) AS BIGINT) AS cell_lat, CAST(round_even(lon / 0.00068, 0) AS BIGINT) AS cell_lon FROM mk),
y AS (SELECT cell_lat, cell_lon, count(DISTINCT year) AS n_years FROM c GROUP BY 1, 2), pe AS (SELECT c.*, n_years, n_years = 1 AS transient FROM c JOIN y ON y.cell_lat = c.cell_lat AND y.cell_lon = c.cell_lon)"""


@query(f"WITH {PERSIST} SELECT id, cell_lat, cell_lon, n_years AS n_years_at_cell, transient FROM pe")
def persistence_cells(t: Tables):
    return de.persistence(t.marks()).select("id", "cell_lat", "cell_lon", "n_years_at_cell", "transient")


@query(f"WITH {PERSIST} SELECT id, year FROM pe WHERE n_years < 5")
def without_persistent_cells(t: Tables):
    return de.drop_persistent(t.marks(), 5).select("id", "year")


@query(f"WITH {PERSIST} SELECT id, nir_snr FROM pe WHERE n_years <= 3 AND nir_snr >= 20", floats=["nir_snr"])
def review_queue(t: Tables):
    d = de.persistence(t.marks()).withColumn("transient", F.col("n_years_at_cell") <= 3)
    return de.review_queue(d).select("id", "nir_snr")


@query(f"WITH {PERSIST} SELECT scene_id, count(*) AS n_candidates, count(*) FILTER (WHERE transient) AS n_non_transient FROM pe GROUP BY 1")
def candidate_counts(t: Tables):
    return de.candidate_counts(de.persistence(t.marks()))


@query(f"""WITH {MARKS}, r AS (SELECT o_orderkey % 1000000007 AS scene_id, l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 10000 AS range_km, CAST(l_quantity > 25 AS INTEGER) AS wake_flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'),
g AS (SELECT scene_id, count(*) AS n, max(power(range_km, -1.5)) / sum(power(range_km, -1.5)) AS dom, arg_min(range_km, (range_km, id)) AS rk, arg_min(wake_flag, (range_km, id)) AS wf FROM r GROUP BY 1)
SELECT o_orderkey AS scene_id, coalesce(n, 0) AS n_detections, dom AS dominance, CASE WHEN n IS NULL THEN 'EMPTY' WHEN dom >= 0.8 THEN 'SINGLE-DOMINANT' ELSE 'CROWDED' END AS class, rk AS r_dominant_km, wf AS wake_flag_dominant
FROM orders LEFT JOIN g ON g.scene_id = o_orderkey""", floats=["dominance", "r_dominant_km"])
def scene_classes(t: Tables):
    d = t.raw("lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_extendedprice") / 10_000).alias("range_km"), (F.col("l_quantity") > 25).cast("int").alias("wake_flag"))
    return de.classify_scenes(t.raw("orders").select(F.col("o_orderkey").alias("scene_id")), d)


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'both' END AS side, count(*) AS n_scenes FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def paired_scenes(t: Tables):
    li = t.raw("lineitem")
    both, only = de.paired_scenes(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_orderkey")
    return both.withColumn("side", F.lit("both")).unionByName(only).groupBy("side").agg(F.count("*").alias("n_scenes"))


# ---- configuration sweeps --------------------------------------------------------------------------

CONF, MIN_LEN, MAX_LEN, MASK = (0.9, 0.95, 0.98), (0, 10, 30), (20, 30, 50), ("none", "water")
_GRID = [(i, c, a, z, m) for i, (c, a, z, m) in enumerate((c, a, z, m) for c in CONF for a in MIN_LEN for z in MAX_LEN for m in MASK) if a < z]
SWEEP = f"""{FLAGS}, gr(config, conf, min_len, max_len, mask) AS (VALUES {', '.join(f"({i}, {c}, {a}, {z}, '{m}')" for i, c, a, z, m in _GRID)}), sc AS (SELECT DISTINCT scene_id AS scene FROM mk),
k AS (SELECT config, scene_id AS scene, count(*) AS n FROM f JOIN gr ON score >= conf AND in_valid AND (mask = 'none' OR in_water) AND length_m BETWEEN min_len AND max_len AND aspect_ratio <= 4 GROUP BY 1, 2),
tr AS (SELECT scene_id AS scene, count(*) FILTER (WHERE length_m >= 30 AND side = 'A') AS truth FROM mk GROUP BY 1),
mx AS (SELECT gr.config, sc.scene, coalesce(n, 0) AS pred FROM gr JOIN sc ON true LEFT JOIN k ON k.config = gr.config AND k.scene = sc.scene), cs AS (SELECT mx.*, truth FROM mx JOIN tr ON tr.scene = mx.scene)"""


def _matrix(t: Tables):
    """Counts per configuration and scene; all settings run in one pass over the boxes."""
    boxes = _flags(t)
    grid = de.parameter_grid(lambda c: c["min_len"] >= c["max_len"], conf=CONF, min_len=MIN_LEN, max_len=MAX_LEN, mask=MASK)
    keep = lambda c: de.passes(boxes.columns, max_aspect=4, **{k: v for k, v in c.items() if k != "config"})
    return cut(de.sweep_counts(boxes, "scene_id", grid, keep), "matrix")


def _truth(t: Tables):
    return t.marks().groupBy(F.col("scene_id").alias("scene")).agg(F.count_if((F.col("length_m") >= 30) & (F.col("side") == "A")).alias("truth"))


@query(f"WITH {SWEEP} SELECT config, scene, pred FROM mx")
def sweep_counts(t: Tables):
    return _matrix(t)


SCORES = f"""{SWEEP}, so AS (SELECT config, count(*) AS n_scenes, CAST(sum(pred) AS BIGINT) AS pred_total, CAST(sum(truth) AS BIGINT) AS truth_total, 1 - abs(sum(pred) - sum(truth)) / greatest(sum(truth), 1) AS batch_acc,
avg(greatest(0, least(1, 1 - abs(pred - truth) / greatest(truth, 1)))) AS scene_acc, avg(abs(pred - truth)) AS mae, greatest(0, 1 - sum(abs(pred - truth)) / greatest(sum(truth), 1)) AS err_acc,
avg(CAST(pred = truth AS INTEGER)) AS exact, CASE WHEN stddev_pop(pred) > 0 AND stddev_pop(truth) > 0 THEN corr(pred, truth) END AS r FROM cs GROUP BY 1)"""
_SC_F = ["batch_acc", "scene_acc", "mae", "err_acc", "exact", "r"]


@query(f"WITH {SCORES} SELECT * FROM so", floats=_SC_F)
def sweep_scores(t: Tables):
    return es.score_counts(_matrix(t).join(_truth(t), "scene"))


@query(f"WITH {SCORES} SELECT config, round(err_acc, 9) AS err_acc, round(mae, 9) AS mae FROM so ORDER BY round(err_acc, 9) DESC NULLS LAST, round(mae, 9), config LIMIT 5", floats=["err_acc", "mae"])
def sweep_ranked(t: Tables):
    s = es.score_counts(_matrix(t).join(_truth(t), "scene"))
    s = s.select("config", F.round("err_acc", 9).alias("err_acc"), F.round("mae", 9).alias("mae"))
    return es.rank_configs(s, "err_acc", 5)


@query(f"WITH {SCORES} SELECT arg_max(config, (round(err_acc, 9), -config)) AS config, max(round(err_acc, 9)) AS err_acc FROM so", floats=["err_acc"])
def sweep_best(t: Tables):
    s = es.score_counts(_matrix(t).join(_truth(t), "scene"))
    return es.best_config(s.withColumn("err_acc", F.round("err_acc", 9)))


TRIALS = f"""{SWEEP}, tl AS (SELECT trial, tr.scene, truth, row_number() OVER (PARTITION BY trial ORDER BY md5('3|' || trial || '|' || tr.scene), tr.scene) - 1 AS place FROM tr, (SELECT unnest(range(12)) AS trial))"""
NULLS = f"""{TRIALS}, fp AS (SELECT scene, row_number() OVER (ORDER BY scene) - 1 AS place FROM tr), mv AS (SELECT trial, fp.scene, truth FROM tl JOIN fp ON fp.place = tl.place),
nl AS (SELECT trial, max(e) AS err_acc FROM (SELECT trial, config, greatest(0, 1 - sum(abs(pred - truth)) / greatest(sum(truth), 1e-9)) AS e FROM mx JOIN mv ON mv.scene = mx.scene GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {NULLS} SELECT trial, err_acc FROM nl", floats=["err_acc"])
def label_shuffle_null(t: Tables):
    return es.label_shuffle_null(_matrix(t), cut(_truth(t), "truth"), 12, 3)


@query(f"""WITH {NULLS}, re AS (SELECT max(e) AS v FROM (SELECT config, greatest(0, 1 - sum(abs(pred - truth)) / greatest(sum(truth), 1e-9)) AS e FROM cs GROUP BY 1))
SELECT avg(err_acc) AS null_mean, quantile_cont(err_acc, 0.95) AS null_p95, max(err_acc) AS null_max, avg(CAST((SELECT v FROM re) > err_acc AS INTEGER)) AS share_beaten, (SELECT v FROM re) AS real FROM nl""",
       floats=["null_mean", "null_p95", "null_max", "share_beaten", "real"])
def label_shuffle_summary(t: Tables):
    m, truth = _matrix(t), cut(_truth(t), "truth")
    real = es.err_accuracy(m.join(truth, "scene"), ["config"])
    return es.null_summary(es.label_shuffle_null(m, truth, 12, 3), real)


SPLITS = f"""{TRIALS}, hv AS (SELECT trial, scene, truth, CASE WHEN place < (SELECT count(*) FROM tr) // 2 THEN 'train' ELSE 'test' END AS half FROM tl),
ac AS (SELECT trial, half, config, greatest(0, 1 - sum(abs(pred - truth)) / greatest(sum(truth), 1e-9)) AS e FROM mx JOIN hv ON hv.scene = mx.scene GROUP BY 1, 2, 3),
pk AS (SELECT trial, arg_max(config, (e, -config)) AS config, max(e) AS train_acc FROM ac WHERE half = 'train' GROUP BY 1), sh AS (SELECT pk.trial, pk.config, train_acc, e AS test_acc, train_acc - e AS gap FROM pk JOIN ac ON ac.trial = pk.trial AND ac.config = pk.config AND half = 'test')"""


@query(f"WITH {SPLITS} SELECT * FROM sh", floats=["train_acc", "test_acc", "gap"])
def split_half_trials(t: Tables):
    return es.split_half(_matrix(t), cut(_truth(t), "truth"), 12, 3).select("trial", "config", "train_acc", "test_acc", "gap")


@query(f"WITH {SPLITS} SELECT avg(train_acc) AS train_mean, avg(test_acc) AS test_mean, stddev_pop(test_acc) AS test_sd, quantile_cont(test_acc, 0.05) AS test_p05, avg(gap) AS gap_mean FROM sh",
       floats=["train_mean", "test_mean", "test_sd", "test_p05", "gap_mean"])
def split_half_summary(t: Tables):
    return es.split_summary(es.split_half(_matrix(t), cut(_truth(t), "truth"), 12, 3))


# ---- two assets, persistence and fused counts ----------------------------------------------------------

CONF_A, CONF_B, PERSIST = (0.9, 0.95), (0.9, 0.97), (0, 5)
_GRID2 = [(i, a, b, lo, m) for i, (a, b, lo, m) in enumerate((a, b, lo, m) for a in CONF_A for b in CONF_B for lo in (0, 20) for m in MASK)]
ASSETS = f"""{FLAGS}, gr(config, conf, conf2, min_len, mask) AS (VALUES {', '.join(f"({i}, {a}, {b}, {lo}, '{m}')" for i, a, b, lo, m in _GRID2)}),
ps(persist) AS (VALUES {', '.join(f'({p})' for p in PERSIST)}), sb AS (SELECT *, CAST(round_even(lat / 0.00045, 0) AS BIGINT) AS clat, CAST(round_even(lon / 0.00068, 0) AS BIGINT) AS clon FROM f WHERE side IN ('A', 'B')),
k0 AS (SELECT config, persist, sb.* FROM sb JOIN gr ON score >= CASE side WHEN 'A' THEN conf ELSE conf2 END AND in_valid AND (mask = 'none' OR in_water) AND length_m >= min_len AND aspect_ratio <= 4 JOIN ps ON true),
ye AS (SELECT config, persist, side, clat, clon, count(DISTINCT year) AS n_years FROM k0 GROUP BY ALL),
k AS (SELECT k0.* FROM k0 JOIN ye USING (config, persist, side, clat, clon) WHERE persist = 0 OR n_years < persist),
sn AS (SELECT scene_id, bool_or(side = 'A') AS has_a, bool_or(side = 'B') AS has_b FROM sb GROUP BY 1),
ct AS (SELECT config, persist, scene_id, count(*) FILTER (WHERE side = 'A') AS n_a, count(*) FILTER (WHERE side = 'B') AS n_b FROM k GROUP BY 1, 2, 3),
pairs AS (SELECT (a.scene_id * 100 + a.config) * 10 + a.persist AS scene_id, a.id AS a, b.id AS b, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM k a JOIN k b
  ON a.side = 'A' AND b.side = 'B' AND a.scene_id = b.scene_id AND a.config = b.config AND a.persist = b.persist AND b.x BETWEEN a.x - 30 AND a.x + 30 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 30),
{_match('(d, a, b)', '(d, a, b)')}, mt AS (SELECT scene_id, count(*) AS n_both FROM st WHERE kind = 'acc' GROUP BY 1),
al AS (SELECT config, conf2, persist, sn.scene_id AS scene, has_a, has_b, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_both, 0) AS n_both FROM gr JOIN ps ON true JOIN sn ON true
  LEFT JOIN ct USING (config, persist, scene_id) LEFT JOIN mt ON mt.scene_id = (sn.scene_id * 100 + config) * 10 + persist),
am AS (SELECT config, persist, 'A' AS asset, scene, n_a AS pred FROM al WHERE has_a AND conf2 = {CONF_B[0]} UNION ALL SELECT config, persist, 'B', scene, n_b FROM al WHERE has_b AND conf2 = {CONF_B[0]}
  UNION ALL SELECT config, persist, 'both', scene, n_both FROM al WHERE has_a AND has_b UNION ALL SELECT config, persist, 'any', scene, n_a + n_b - n_both FROM al WHERE has_a AND has_b),
tr AS (SELECT scene_id AS scene, count(*) FILTER (WHERE length_m >= 30 AND side = 'A') AS truth FROM mk GROUP BY 1)"""


def _asset_matrix(t: Tables):
    boxes = _flags(t)
    grid = de.parameter_grid(conf=CONF_A, conf2=CONF_B, min_len=(0, 20), mask=MASK)
    keep = lambda c, side: de.conditions(boxes.columns, conf=c["conf"] if side == "A" else c["conf2"], mask=c["mask"], min_len=c["min_len"], max_aspect=4)
    return sweeps.sweep_assets(boxes, "scene_id", grid, keep, 30.0, PERSIST, lambda c: c["conf2"] == CONF_B[0])


@query(f"WITH RECURSIVE {ASSETS} SELECT config, persist, asset, scene, pred FROM am")
def asset_sweep_counts(t: Tables):
    """Counts of every setting over both assets, their pairs and their union, with and without persistence."""
    return _asset_matrix(t)


@query(f"""WITH RECURSIVE {ASSETS}, jo AS (SELECT am.*, truth FROM am JOIN tr USING (scene))
SELECT asset, arg_max(config, (e, -config, -persist)) AS config, arg_max(persist, (e, -config, -persist)) AS persist, max(e) AS err_acc FROM
(SELECT config, persist, asset, round(greatest(0, 1 - sum(abs(pred - truth)) / greatest(sum(truth), 1)), 9) AS e FROM jo GROUP BY 1, 2, 3) GROUP BY 1""", floats=["err_acc"])
def asset_sweep_best(t: Tables):
    """The best setting of each asset."""
    s = es.score_counts(_asset_matrix(t).join(_truth(t), "scene"), ["config", "persist", "asset"]).withColumn("e", F.round("err_acc", 9))
    top = s.groupBy("asset").agg(F.max(F.struct("e", -F.col("config"), -F.col("persist"), "config", "persist")).alias("t"))
    return top.select("asset", "t.config", "t.persist", F.col("t.e").alias("err_acc"))
