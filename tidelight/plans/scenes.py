"""Queries over scene tables: gates, review state, selection, accounting, nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions import geo, maths, text
from tidelight.functions.times import minutes_from, parse_utc, utc
from tidelight.operators import gating as ga
from tidelight.operators import reports
from tidelight.plans.base import Tables, query
from tidelight.sources.tables import search_results

# Orders stand in for scenes: clarity, cloud and sun angles are simple functions of their columns.
SCENES = """sc AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS acquired, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) AS year, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey % 1000) / 999 END AS aoi_clear,
(o_custkey % 101) / 1.0 AS clear_percent, (o_orderkey % 37) / 100 AS cloud_cover, 20.0 + o_orderkey % 50 AS sun_elevation, CAST(o_custkey % 11 - 5 AS DOUBLE) AS view_angle, (o_orderkey % 360) / 1.0 AS sat_azimuth, 150.0 AS sun_azimuth, o_orderkey % 7 AS n_detections,
o_orderstatus = 'F' AS visible, o_orderstatus = 'P' AS unsure, o_orderkey % 4 <> 0 AS reviewed, CAST(o_orderkey % 17 AS INTEGER) AS seen FROM orders)"""
GLINT = """gl AS (SELECT sc.*, degrees(acos(greatest(-1.0, least(1.0, cos(radians(abs(view_angle))) * cos(radians(90.0 - sun_elevation)) - sin(radians(abs(view_angle))) * sin(radians(90.0 - sun_elevation)) * cos(radians(sat_azimuth - sun_azimuth)))))) AS glint_angle FROM sc)"""


def _scenes(t: Tables):
    o = t.raw("orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = o.select(
        k.alias("id"), utc(F.col("o_orderdate")).alias("acquired"), F.to_date("o_orderdate").alias("date"), F.year("o_orderdate").alias("year"),
        F.when(k % 50 != 0, (k % 1000) / 999).alias("aoi_clear"), (c % 101).cast("double").alias("clear_percent"), ((k % 37) / 100).alias("cloud_cover"),
        (20.0 + k % 50).alias("sun_elevation"), (c % 11 - 5).cast("double").alias("view_angle"), (k % 360).cast("double").alias("sat_azimuth"), F.lit(150.0).alias("sun_azimuth"),
        (k % 7).alias("n_detections"), (F.col("o_orderstatus") == "F").alias("visible"), (F.col("o_orderstatus") == "P").alias("unsure"), (k % 4 != 0).alias("reviewed"),
        F.sequence(F.lit(0), (k % 17).cast("int")).alias("panels"))
    return s.withColumn("glint_angle", geo.glint_angle(F.col("sun_elevation"), F.col("view_angle"), F.col("sat_azimuth"), F.col("sun_azimuth")))


@query(f"WITH {SCENES}, {GLINT} SELECT id, glint_angle, aoi_clear * 100 + least(glint_angle, 60.0) * 0.5 - abs(view_angle) + least(n_detections, 5) * 3.0 AS score FROM gl", floats=["glint_angle", "score"])
def glint_and_score(t: Tables):
    s = _scenes(t)
    return s.select("id", "glint_angle", maths.scene_score(F.col("aoi_clear"), F.col("glint_angle"), F.col("view_angle"), F.col("n_detections")).alias("score"))


@query(f"WITH {SCENES}, {GLINT} SELECT id, aoi_clear FROM gl WHERE aoi_clear >= 0.95 AND round(glint_angle, 6) > 30", floats=["aoi_clear"])
def clear_unglinted_scenes(t: Tables):
    s = _scenes(t).withColumn("glint_angle", F.round("glint_angle", 6))
    return ga.glint_above(ga.clear_enough(s), 30).select("id", "aoi_clear")


@query(f"WITH {SCENES} SELECT corr(aoi_clear, clear_percent) AS r, count(*) FILTER (WHERE aoi_clear >= 0.95 AND cloud_cover > 0.10) AS recovered, count(*) FILTER (WHERE NOT coalesce(aoi_clear >= 0.95, false) AND cloud_cover <= 0.10) AS rejected FROM sc", floats=["r"])
def gate_agreement(t: Tables):
    return ga.gate_agreement(_scenes(t))


@query(f"WITH {SCENES} SELECT year, count(*) AS scenes, count(DISTINCT date) AS days FROM sc GROUP BY 1")
def scenes_per_year(t: Tables):
    return ga.yearly(_scenes(t), "acquired")


@query(f"""WITH {SCENES}, r AS (SELECT CASE WHEN visible THEN 'visible' WHEN unsure THEN 'unsure' WHEN reviewed THEN 'negative' ELSE 'unreviewed' END AS review, seen + 1 AS panels_seen FROM sc)
SELECT review, count(*) AS n_scenes, CAST(sum(panels_seen) AS BIGINT) AS panels_seen, count(*) FILTER (WHERE review = 'negative' AND panels_seen < 16) AS n_shallow FROM r GROUP BY 1""")
def review_tally(t: Tables):
    return ga.review_tally(ga.review_state(_scenes(t)))


@query(f"WITH {SCENES} SELECT id, date, aoi_clear FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY aoi_clear DESC, id) AS rn FROM sc WHERE aoi_clear IS NOT NULL) WHERE rn = 1", floats=["aoi_clear"])
def best_scene_per_day(t: Tables):
    return ga.best_per_day(_scenes(t).where("aoi_clear IS NOT NULL").select("id", "date", "aoi_clear"), "date", "aoi_clear")


@query(f"WITH {SCENES} SELECT id, aoi_clear FROM sc WHERE aoi_clear IS NOT NULL ORDER BY aoi_clear DESC, id LIMIT 26", floats=["aoi_clear"])
def clearest_scenes(t: Tables):
    return ga.clearest(_scenes(t).where("aoi_clear IS NOT NULL").select("id", "aoi_clear"))


STRAT = """px AS (SELECT n_detections > 0 AS target, year, count(*) AS n FROM sc GROUP BY 1, 2), pl AS (SELECT *, CAST(round_even(40 * n / sum(n) OVER (PARTITION BY target), 0) AS INTEGER) AS slots FROM px),
rk AS (SELECT id, n_detections > 0 AS target, year, row_number() OVER (PARTITION BY n_detections > 0, year ORDER BY id * 7919 % 10007 DESC, id) AS place FROM sc)"""


@query(f"WITH {SCENES}, {STRAT} SELECT rk.id, rk.target, rk.year, place FROM rk JOIN pl ON pl.target = rk.target AND pl.year = rk.year WHERE place <= slots")
def stratified_batch(t: Tables):
    """Slots per year for targets and controls, best scores inside each year."""
    s = _scenes(t).select("id", "year", (F.col("n_detections") > 0).alias("target"), (F.col("id") * 7919 % 10007).alias("score"))
    return ga.stratified_top(s, 40, "year", "score", by=["target"]).select("id", "target", "year", "place")


@query(f"WITH {SCENES}, dr AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity = 50 AND l_orderkey IN (SELECT id FROM sc)) SELECT year, count(*) AS n_scenes FROM sc WHERE id NOT IN (SELECT id FROM dr) GROUP BY 1")
def scenes_after_drops(t: Tables):
    s = _scenes(t)
    drops = t.raw("lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id")).intersect(s.select("id"))
    return ga.drop_ids(s, drops).groupBy("year").agg(F.count("*").alias("n_scenes"))


@query(f"""WITH {SCENES} SELECT visible, count(*) FILTER (WHERE n_detections > 3) AS audible, count(*) FILTER (WHERE n_detections <= 3) AS silent FROM sc GROUP BY 1""")
def visible_by_audible(t: Tables):
    s = _scenes(t).withColumn("heard", F.when(F.col("n_detections") > 3, "audible").otherwise("silent"))
    return s.groupBy("visible").pivot("heard", ["audible", "silent"]).agg(F.count("heard"))


AOI = ((-125.35, 48.77), (-125.21, 48.77), (-125.21, 48.86), (-125.35, 48.86))


def _footprints(t: Tables):
    """Quadrangles around the area of interest, shifted by the supplier's and part's numbers."""
    p = t.raw("part").select("p_partkey", "p_size").repartition("p_partkey")  # a small file is one task, its clipping is work for many
    p = p.select("p_partkey", ((F.col("p_size") - 25) / 500).alias("dx"), ((F.col("p_partkey") % 21 - 10) / 300).alias("dy"))
    corner = lambda x, y: F.array(F.lit(x) + F.col("dx"), F.lit(y) + F.col("dy"))
    return p.withColumn("ring", F.array(corner(-125.40, 48.74), corner(-125.16, 48.74), corner(-125.16, 48.89), corner(-125.40, 48.89), corner(-125.40, 48.74)))


_E2 = fixed.WGS84[1] * (2 - fixed.WGS84[1])


def _flat_sql(points: str) -> str:
    """List of (x, y) of a list of (lon, lat): equal-area coordinates around the middle of the area of interest."""
    e = _E2**0.5
    q = lambda s: f"({1 - _E2!r} * ({s} / (1 - {_E2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    lon0, lat0 = (sum(p[k] for p in AOI) / len(AOI) for k in (0, 1))
    b0, b = f"asin({q(f'sin(radians({lat0!r}))')} / {q('1.0')})", f"asin({q('sin(radians(p[2]))')} / {q('1.0')})"
    dl = f"radians(p[1] - ({lon0!r}))"
    k = f"{fixed.WGS84[0]!r} * sqrt({q('1.0')} / 2) * sqrt(2 / (1 + sin({b0}) * sin({b}) + cos({b0}) * cos({b}) * cos({dl})))"
    return f"list_transform({points}, lambda p: [{k} * cos({b}) * sin({dl}), {k} * (cos({b0}) * sin({b}) - sin({b0}) * cos({b}) * cos({dl}))])"


def _clip_sql(source: str, out: str, i: int) -> str:
    """``source`` (p_partkey, g, w) with the ring g cut by the i-th edge of the window w."""
    a, b = f"w[{i}]", f"w[{i % len(AOI) + 1}]"
    side = lambda p: f"(({b}[1] - {a}[1]) * ({p}[2] - {a}[2]) - ({b}[2] - {a}[2]) * ({p}[1] - {a}[1]))"
    p, q = "g[k]", "g[k % len(g) + 1]"
    s, t = side(p), side(q)
    part = f"CASE WHEN {s} >= 0 THEN [{p}] ELSE [] END || CASE WHEN {s} * {t} < 0 THEN [[{p}[1] + ({q}[1] - {p}[1]) * {s} / ({s} - {t}), {p}[2] + ({q}[2] - {p}[2]) * {s} / ({s} - {t})]] ELSE [] END"
    return f"{out} AS (SELECT p_partkey, w, flatten(list_transform(range(1, len(g) + 1), lambda k: {part})) AS g FROM {source})"


def _area_sql(g: str) -> str:
    return f"coalesce(abs(list_sum(list_transform(range(1, len({g}) + 1), lambda k: {g}[k][1] * {g}[k % len({g}) + 1][2] - {g}[k % len({g}) + 1][1] * {g}[k][2]))) / 2, 0)"


COVER = f"""f AS (SELECT p_partkey, (p_size - 25) / 500 AS dx, (p_partkey % 21 - 10) / 300 AS dy FROM part),
c0 AS (SELECT p_partkey, {_flat_sql(str([list(p) for p in AOI]))} AS w, {_flat_sql('[' + ', '.join(f'[{x} + dx, {y} + dy]' for x, y in ((-125.40, 48.74), (-125.16, 48.74), (-125.16, 48.89), (-125.40, 48.89), (-125.40, 48.74))) + ']')} AS g FROM f),
{', '.join(_clip_sql(f'c{i - 1}', f'c{i}', i) for i in range(1, len(AOI) + 1))},
cv AS (SELECT p_partkey, {_area_sql('w')} AS total, {_area_sql('g')} AS got FROM c{len(AOI)})"""


@query(f"WITH {COVER} SELECT p_partkey, total - got <= 1e-9 * total AS aoi_covered FROM cv")
def aoi_containment(t: Tables):
    return ga.aoi_coverage(_footprints(t), AOI).select("p_partkey", "aoi_covered")


@query(f"WITH {COVER} SELECT p_partkey, round(got / total, 6) AS aoi_coverage, round(greatest(0, total - got), 0) AS aoi_missing_m2 FROM cv WHERE total - got <= 5000000")
def aoi_coverage(t: Tables):
    c = ga.aoi_coverage(_footprints(t), AOI)
    return ga.contained(c, 5_000_000.0).select("p_partkey", F.round("aoi_coverage", 6).alias("aoi_coverage"), F.round("aoi_missing_m2", 0).alias("aoi_missing_m2"))


@query("""SELECT c_custkey, CAST(trunc((c_acctbal / 100 + 180.0) / 360.0 * 1024) AS BIGINT) AS tile_x, CAST(trunc((1.0 - asinh(tan(radians(48 + c_custkey % 100 / 100))) / pi()) / 2.0 * 1024) AS BIGINT) AS tile_y FROM customer""")
def map_tiles(t: Tables):
    x, y = geo.map_tile(F.col("c_acctbal") / 100, 48 + F.col("c_custkey") % 100 / 100, 10)
    return t.raw("customer").select("c_custkey", x.alias("tile_x"), y.alias("tile_y"))


_TX = "CAST(trunc(({lon} + 180.0) / 360.0 * 4096) AS BIGINT)"
_TY = "CAST(trunc((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * 4096) AS BIGINT)"


@query(f"""WITH b AS (SELECT s_suppkey, -125.0 + s_suppkey % 10 / 10 AS west, 48.0 + s_suppkey % 7 / 10 AS south FROM supplier), x AS (SELECT *, unnest(generate_series({_TX.format(lon='west')}, {_TX.format(lon='(west + 0.3)')})) AS tile_x FROM b)
SELECT s_suppkey, tile_x, unnest(generate_series({_TY.format(lat='(south + 0.2)')}, {_TY.format(lat='south')})) AS tile_y FROM x""")
def tile_grids(t: Tables):
    k = F.col("s_suppkey")
    b = t.raw("supplier").select(k, (F.lit(-125.0) + k % 10 / 10).alias("west"), (F.lit(48.0) + k % 7 / 10).alias("south"))
    b = b.withColumn("east", F.col("west") + 0.3).withColumn("north", F.col("south") + 0.2)
    return geo.tile_grid(b, 12, ("s_suppkey",))


@query("""SELECT d.source, count(*) FILTER (WHERE l.doc_id IS NOT NULL OR d.n_chars > 3000) AS requested, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS present, count(*) FILTER (WHERE l.doc_id IS NULL AND d.n_chars > 3000) AS absent,
count(*) FILTER (WHERE l.doc_id IS NULL AND d.n_chars <= 3000 AND d.lang <> 'en') AS errors, count(*) FILTER (WHERE l.doc_id IS NULL AND d.n_chars <= 3000 AND d.lang = 'en') AS empty_windows, CAST(0 AS BIGINT) AS unknown FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def retrieval_accounting(t: Tables):
    """Requested = present + absent per source; documents stand in for files, labels for arrivals."""
    d = t.raw("documents").select("doc_id", "lang", "source", "n_chars").join(t.raw("labels").select("doc_id", F.lit(True).alias("got")), "doc_id", "left")
    status = F.when(F.col("got"), "present").when(F.col("n_chars") > 3000, "absent").when(F.col("lang") != "en", "error").otherwise("empty")
    return reports.accounting(d.withColumn("status", status), ["source"])


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1""", floats=["total"], digits=4)
def event_properties(t: Tables):
    e = t.raw("events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy((F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))


@query("""SELECT 's' || event_id AS id, ts AS acquired, CAST(ts AS DATE) AS date, year(ts) AS year, value / 100 AS cloud_cover, CAST(NULL AS DOUBLE) AS clear_percent, CASE WHEN user_id % 2 = 0 THEN 'http://t/' || event_id END AS tiles_link FROM events""", floats=["cloud_cover", "clear_percent"])
def flattened_search(t: Tables):
    """Nested search documents written from the events and flattened again."""
    e = t.raw("events")
    iso = F.date_format(utc(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    nested = e.select(
        F.concat(F.lit("s"), F.col("event_id")).alias("id"),
        F.struct(iso.alias("acquired"), (F.col("value") / 100).alias("cloud_cover"), F.lit(None).cast("double").alias("clear_percent"), F.col("event_type").alias("instrument"),
                 *[F.lit(0.0).alias(c) for c in ("sun_elevation", "sun_azimuth", "view_angle", "satellite_azimuth")]).alias("properties"),
        F.struct(F.lit("x").alias("thumbnail"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("http://t/"), F.col("event_id"))).alias("tiles")).alias("_links"), F.lit(None).alias("geometry"))
    return search_results(nested).select("id", "acquired", "date", "year", "cloud_cover", "clear_percent", "tiles_link")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 1 THEN date_trunc('second', ts) - INTERVAL 7 HOUR + INTERVAL 14 HOUR ELSE date_trunc('second', ts) END AS parsed, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 6e7, 3) AS minutes FROM events""", floats=["minutes"], digits=3)
def parsed_instants(t: Tables):
    """Text in several forms: plain, with offset, with Z, blank."""
    e = t.raw("events")
    ts = utc(F.col("ts"))
    plain = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id") % 5
    txt = (F.when(k == 0, plain).when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-07:00"))).when(k == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
           .when(k == 3, F.concat(F.lit("  "), plain)).otherwise(" "))
    return e.select("event_id", parse_utc(txt).alias("parsed"), minutes_from(ts, F.lit("2024-01-15").cast("timestamp")).alias("minutes"))


@query("""SELECT c_custkey, concat_ws(' ; ', CASE WHEN c_acctbal < 0 THEN 'overdrawn' END, CASE WHEN c_nationkey = 3 THEN 'north' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' END) AS note, lower(trim(CASE c_custkey % 3 WHEN 0 THEN ' Yes ' WHEN 1 THEN '1' ELSE 'no' END)) IN ('1', 'true', 'yes') AS flag FROM customer""")
def joined_notes(t: Tables):
    n = text.notes(F.when(F.col("c_acctbal") < 0, "overdrawn"), F.when(F.col("c_nationkey") == 3, "north"), F.when(F.col("c_mktsegment") == "BUILDING", "b"))
    raw = F.when(F.col("c_custkey") % 3 == 0, " Yes ").when(F.col("c_custkey") % 3 == 1, "1").otherwise("no")
    return t.raw("customer").select("c_custkey", n.alias("note"), text.truthy(raw).alias("flag"))


@query("""SELECT user_id, CAST(to_json(map_from_entries(list_sort(list((event_type, n))))) AS VARCHAR) AS bands FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def band_maps(t: Tables):
    """One map per window from its few bands, as JSON."""
    n = t.raw("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(text.pairs_to_map(F.col("event_type"), F.col("n")).alias("m")).select("user_id", F.to_json("m").alias("bands"))


@query("""WITH w AS (SELECT o_orderkey AS id, (o_orderkey % 1001) / 1000 AS frac FROM orders) SELECT id, frac FROM w WHERE frac >= 0.999 ORDER BY frac DESC, id LIMIT 1""", floats=["frac"])
def best_covered_scene(t: Tables):
    w = t.raw("orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 1001) / 1000).alias("frac"))
    return w.where("frac >= 0.999").orderBy(F.desc("frac"), "id").limit(1)
