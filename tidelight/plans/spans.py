"""Queries over intervals, coverage and the uptime calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight.functions import times
from tidelight.operators import intervals as iv
from tidelight.operators.guards import unmatched
from tidelight.operators.reports import label_scenes
from tidelight.plans.base import SPANS, WINDOWS, Tables, query

MERGED = """m1 AS (SELECT user_id, start_utc, max(end_utc) AS end_utc, count(*) AS n FROM sp GROUP BY 1, 2),
m2 AS (SELECT *, max(end_utc) OVER (PARTITION BY user_id ORDER BY start_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m1),
m3 AS (SELECT *, sum(CASE WHEN epoch_us(start_utc) - epoch_us(reach) {op} {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY start_utc) AS chain FROM m2),
solid AS (SELECT user_id, min(start_utc) AS start_utc, max(end_utc) AS end_utc, CAST(sum(n) AS BIGINT) AS n_merged FROM m3 GROUP BY user_id, chain)"""
TOUCH = MERGED.format(op="<=", gap=0)


@query(f"WITH {SPANS}, {MERGED.format(op='<', gap=3_600_000_000)} SELECT user_id, start_utc, end_utc, n_merged FROM solid")
def coverage_intervals(t: Tables):
    return iv.merge_intervals(t.spans(), ["user_id"], gap_s=3600, strict=True)


@query(f"""WITH {SPANS}, g1 AS (SELECT start_utc, max(end_utc) AS end_utc, count(*) AS n FROM (SELECT start_utc, start_utc + INTERVAL 300 SECOND AS end_utc FROM sp) GROUP BY 1),
g2 AS (SELECT *, max(end_utc) OVER (ORDER BY start_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g1),
g3 AS (SELECT *, sum(CASE WHEN epoch_us(start_utc) - epoch_us(reach) < 300000000 THEN 0 ELSE 1 END) OVER (ORDER BY start_utc) AS chain FROM g2)
SELECT min(start_utc) AS start_utc, max(end_utc) AS end_utc, CAST(sum(n) AS BIGINT) AS n_merged FROM g3 GROUP BY chain""")
def archive_coverage(t: Tables):
    """One time line for the whole archive: a single series of any length."""
    files = t.spans().withColumn("end_utc", F.col("start_utc") + F.expr("INTERVAL 300 SECONDS"))
    return iv.merge_intervals(files, gap_s=300, strict=True)


@query(f"""WITH {SPANS}, {WINDOWS} SELECT w.user_id, w.scene_id, s.event_id, s.start_utc, s.end_utc FROM wi w JOIN sp s
ON w.user_id = s.user_id AND s.end_utc > w.w_start AND s.start_utc < w.w_end""")
def window_files(t: Tables):
    return iv.overlap_pairs(t.windows(), t.spans().drop("event_type"), ["user_id"], 14_400).select(
        "user_id", "scene_id", "event_id", "start_utc", "end_utc")


@query(f"""WITH {SPANS}, {WINDOWS}, {TOUCH}, hit AS (SELECT w.user_id, w.scene_id,
sum(epoch_us(least(s.end_utc, w.w_end)) - epoch_us(greatest(s.start_utc, w.w_start))) / 1e6 AS c FROM wi w JOIN solid s
ON w.user_id = s.user_id AND s.end_utc > w.w_start AND s.start_utc < w.w_end GROUP BY 1, 2),
r AS (SELECT w.user_id, w.scene_id, coalesce(c, 0.0) AS covered_s, 14400.0 AS window_s FROM wi w LEFT JOIN hit h ON h.user_id = w.user_id AND h.scene_id = w.scene_id)
SELECT *, CASE WHEN covered_s >= window_s - 1 THEN 'full' WHEN covered_s > 0 THEN 'partial' ELSE 'none' END AS coverage FROM r""", floats=["covered_s", "window_s"])
def window_coverage(t: Tables):
    return iv.covered_seconds(t.windows(), t.spans(), ["scene_id"], ["user_id"], 14_400).select(
        "user_id", "scene_id", "covered_s", "window_s", "coverage")


@query(f"""WITH {SPANS}, {WINDOWS}, {TOUCH}, hit AS (SELECT w.scene_id, sum(epoch_us(least(s.end_utc, w.w_end)) - epoch_us(greatest(s.start_utc, w.w_start))) / 1e6 AS c
FROM wi w JOIN solid s ON w.user_id = s.user_id AND s.end_utc > w.w_start AND s.start_utc < w.w_end GROUP BY 1)
SELECT CASE WHEN coalesce(c, 0) >= 14399 THEN 'full' WHEN c > 0 THEN 'partial' ELSE 'none' END AS coverage, count(*) AS n_windows
FROM wi LEFT JOIN hit USING (scene_id) GROUP BY 1""")
def coverage_totals(t: Tables):
    return iv.coverage_summary(iv.covered_seconds(t.windows(), t.spans(), ["scene_id"], ["user_id"], 14_400))


_COUNT = """SELECT w.user_id, w.scene_id, count(s.event_id) AS n_overlaps{extra} FROM wi w LEFT JOIN sp s ON w.user_id = s.user_id AND {on} GROUP BY 1, 2"""


@query(f"WITH {SPANS}, {WINDOWS} {_COUNT.format(extra=', count(s.event_id) > 0 AS audible', on='s.start_utc <= w.w_end AND s.end_utc >= w.w_start')}")
def scene_detection_counts(t: Tables):
    n = iv.overlap_counts(t.windows(), t.spans(), ["scene_id"], ["user_id"], closed=True)
    return n.withColumn("audible", F.col("n_overlaps") > 0)


@query(f"WITH {SPANS}, {WINDOWS} {_COUNT.format(extra='', on='s.start_utc < w.w_end AND s.end_utc > w.w_start')}")
def window_file_counts(t: Tables):
    return iv.overlap_counts(t.windows(), t.spans(), ["scene_id"], ["user_id"])


@query(f"""WITH {SPANS}, {WINDOWS}, sh AS (SELECT user_id, scene_id, w_start - INTERVAL 5 HOUR AS w_start, w_end - INTERVAL 5 HOUR AS w_end FROM wi)
SELECT w.user_id, w.scene_id, nullif(count(s.event_id), 0) AS n_shifted FROM sh w LEFT JOIN sp s
ON w.user_id = s.user_id AND s.start_utc < w.w_end AND s.end_utc > w.w_start GROUP BY 1, 2""")
def shifted_window_null(t: Tables):
    """The same windows moved in time; a moved window without coverage is NULL, not 0."""
    step = F.expr("INTERVAL 5 HOURS")
    moved = t.windows().withColumn("w_start", F.col("w_start") - step).withColumn("w_end", F.col("w_end") - step)
    n = iv.overlap_counts(moved, t.spans(), ["scene_id"], ["user_id"])
    return n.select("user_id", "scene_id", F.when(F.col("n_overlaps") > 0, F.col("n_overlaps")).alias("n_shifted"))


# ---- uptime calendar: bins of an hour over the span of the table -------------------------------

GRID = """gs AS (SELECT CAST(floor(epoch_us(min(start_utc)) / 3600e6) AS BIGINT) AS a, CAST(floor(epoch_us(max(end_utc)) / 3600e6) AS BIGINT) AS z FROM sp),
bins AS (SELECT make_timestamp(b * 3600000000) AS start_utc, make_timestamp((b + 1) * 3600000000) AS end_utc FROM (SELECT unnest(generate_series(a, z - 1)) AS b FROM gs))"""
SHORT = """sp AS (SELECT user_id, event_id, ts AS start_utc, ts + INTERVAL 40 SECOND AS end_utc FROM events WHERE event_type = 'error')"""
UPTIME = f"""{SHORT}, {GRID}, up AS (SELECT b.start_utc, b.end_utc, EXISTS (SELECT 1 FROM sp s WHERE s.start_utc < b.end_utc AND s.end_utc > b.start_utc) AS available FROM bins b)"""


def _short(t: Tables):
    s = t.spans().where("event_type = 'error'")
    return s.withColumn("end_utc", F.col("start_utc") + F.expr("INTERVAL 40 SECONDS"))


def _uptime(t: Tables):
    files = _short(t)
    span = iv.grid_span(files, "start_utc", "end_utc", 3600)
    bins = times.season_bins(span, months=tuple(range(1, 13)), seconds=3600)
    return iv.available_bins(bins, files, seconds=3600)


@query(f"WITH {UPTIME} SELECT start_utc, end_utc, available FROM up")
def uptime_bins(t: Tables):
    return _uptime(t)


RUNS = """o1 AS (SELECT *, row_number() OVER (ORDER BY start_utc) - row_number() OVER (PARTITION BY available ORDER BY start_utc) AS g FROM up),
runs AS (SELECT available, min(start_utc) AS start_utc, max(end_utc) AS end_utc, count(*) AS n_bins, count(*) * 3600.0 AS seconds FROM o1 GROUP BY available, g)"""


@query(f"WITH {UPTIME}, {RUNS} SELECT start_utc, end_utc, n_bins, seconds FROM runs WHERE NOT available AND seconds >= 3600", floats=["seconds"])
def outage_gaps(t: Tables):
    bins = _uptime(t).withColumn("site", F.lit(1))
    return iv.flag_runs(bins, ["site"], ~F.col("available"), min_s=3600).drop("site")


@query(f"WITH {UPTIME}, {RUNS} SELECT start_utc, end_utc, n_bins, seconds FROM runs WHERE available", floats=["seconds"])
def uptime_runs(t: Tables):
    bins = _uptime(t).withColumn("site", F.lit(1))
    return iv.flag_runs(bins, ["site"], F.col("available")).drop("site")


@query(f"""WITH {UPTIME}, {RUNS}, mv AS (SELECT start_utc + INTERVAL 7 HOUR AS s, end_utc + INTERVAL 7 HOUR AS e FROM runs WHERE available)
SELECT b.start_utc, b.end_utc, EXISTS (SELECT 1 FROM mv WHERE s < b.end_utc AND e > b.start_utc) AS available FROM bins b""")
def shifted_uptime(t: Tables):
    """Null test of the calendar: coverage runs moved by seven hours."""
    bins = _uptime(t)
    runs = iv.flag_runs(bins.withColumn("site", F.lit(1)), ["site"], F.col("available"))
    step = F.expr("INTERVAL 7 HOURS")
    moved = runs.select((F.col("start_utc") + step).alias("start_utc"), (F.col("end_utc") + step).alias("end_utc"))
    return iv.available_bins(bins.drop("available"), moved, seconds=3600)


@query(f"""WITH {UPTIME} SELECT CAST(h AS INTEGER) AS hour, avg(CAST(available AS INTEGER)) AS availability, count(start_utc) AS n_bins
FROM range(24) t(h) LEFT JOIN up ON hour(start_utc) = h GROUP BY h""", floats=["availability"])
def availability_by_hour(t: Tables):
    return iv.mean_by_hour(_uptime(t), F.col("available"))


@query(f"""WITH {UPTIME} SELECT year(start_utc) AS year, dayofyear(start_utc) AS doy, avg(CAST(available AS INTEGER)) AS availability, count(*) AS n_bins
FROM up GROUP BY 1, 2""", floats=["availability"])
def availability_by_day(t: Tables):
    return iv.mean_by_day(_uptime(t), F.col("available"))


@query("""WITH sp AS (SELECT make_timestamp(CAST(floor(epoch_us(min(o_orderdate)) / 300e6) * 300000000 AS BIGINT)) AS a,
make_timestamp(CAST(floor(epoch_us(max(o_orderdate)) / 300e6) * 300000000 AS BIGINT)) AS z FROM orders),
g AS (SELECT unnest(generate_series(CAST(epoch_us(a) / 300000000 AS BIGINT), CAST(epoch_us(z) / 300000000 AS BIGINT) - 1)) AS b FROM sp)
SELECT year(make_timestamp(b * 300000000)) AS year, month(make_timestamp(b * 300000000)) AS month, count(*) AS n_bins FROM g
WHERE month(make_timestamp(b * 300000000)) BETWEEN 5 AND 9 GROUP BY 1, 2""")
def season_grid(t: Tables):
    """Five-minute season bins over the span of the orders, counted per month."""
    span = iv.grid_span(t.raw("orders"), "o_orderdate", "o_orderdate")
    bins = times.season_bins(span)
    return bins.groupBy(F.year("start_utc").alias("year"), F.month("start_utc").alias("month")).agg(F.count("*").alias("n_bins"))


@query("""WITH y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS z FROM orders),
d AS (SELECT unnest(generate_series(make_date(a, 1, 1), make_date(z, 12, 31), INTERVAL 1 DAY)) AS d FROM y)
SELECT year(d) AS year, CAST(d AS DATE) AS date, row_number() OVER (ORDER BY year(d) DESC, d) AS place FROM d WHERE month(d) BETWEEN 5 AND 9""")
def season_date_list(t: Tables):
    """Season dates, newest year first; the list is one row per day of the study."""
    from tidelight.operators.ordered import RN, number_rows

    span = t.raw("orders").agg(F.year(F.min("o_orderdate")).alias("start_year"), F.year(F.max("o_orderdate")).alias("end_year"))
    d = times.season_dates(span).withColumn("study", F.lit(1))
    return number_rows(d, ["study"], [F.desc("year"), F.col("date")]).rows.select("year", "date", (F.col(RN) + 1).alias("place"))


@query(f"""WITH {SPANS}, dep AS (SELECT user_id, event_id AS dep_id, ts AS s, ts + INTERVAL 60 HOUR AS e FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')
SELECT p.user_id, p.event_id, coalesce(CAST(arg_min(dep_id, (s, dep_id)) AS VARCHAR), '') AS deployment FROM p LEFT JOIN dep
ON dep.user_id = p.user_id AND p.ts >= dep.s AND p.ts < dep.e GROUP BY 1, 2""")
def deployment_of_bin(t: Tables):
    s = t.spans()
    dep = s.where("event_type = 'signup'").select(
        "user_id", "start_utc", (F.col("start_utc") + F.expr("INTERVAL 60 HOURS")).alias("end_utc"),
        F.col("event_id").alias("dep_id"), F.col("event_id").cast("string").alias("deployment"))
    points = s.where("event_type = 'click'").select("user_id", "event_id", F.col("start_utc").alias("at"))
    return iv.assign_unit(points, dep, ["event_id"], "at", "deployment", ["start_utc", "dep_id"], ["user_id"], 43_200).drop("at")


@query("""WITH f AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN '.fft.gz' ELSE '.fft' END AS ext, ts - INTERVAL (epoch(ts) % 3600) SECOND AS h FROM events),
n AS (SELECT event_id, strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S') AS st, event_id % 3 = 0 AS gz, user_id % 10 = 0 AS other, user_id % 2 AS container FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY container, CASE WHEN gz THEN 0 ELSE 1 END, event_id) AS rn FROM n WHERE NOT other)
SELECT reason, count(*) AS n_files FROM (SELECT CASE WHEN rn = 1 THEN 'kept' ELSE 'duplicate_start' END AS reason FROM g
UNION ALL SELECT 'other_device' FROM n WHERE other) GROUP BY 1""")
def file_index_report(t: Tables):
    """Names built from the events, parsed, split by device and deduplicated over two containers."""
    e = t.raw("events")
    stamp = F.date_format(F.date_trunc("hour", F.col("ts")), "yyyyMMdd'T'HHmmss")
    files = e.select(
        F.concat(F.when(F.col("user_id") % 10 == 0, "DEVB").otherwise("DEVA"), F.lit("_"), stamp, F.lit(".000Z-"), F.lpad(F.col("event_id").cast("string"), 12, "0"),
                 F.when(F.col("event_id") % 3 == 0, ".fft.gz").otherwise(".fft")).alias("name"), (F.col("user_id") % 2).alias("container"))
    kept, lost = iv.file_index(files, "DEVA", F.col("container"))
    return kept.select(F.lit("kept").alias("reason")).unionByName(lost.select("reason")).groupBy("reason").agg(F.count("*").alias("n_files"))


@query(f"""WITH {UPTIME}, {RUNS}, g AS (SELECT start_utc AS s, end_utc AS e FROM runs WHERE NOT available AND seconds >= 7200), p AS (SELECT event_id, ts FROM events WHERE event_type = 'view')
SELECT event_id, min(CASE WHEN s IS NOT NULL THEN greatest(0, epoch_us(s) - epoch_us(ts), epoch_us(ts) - epoch_us(e)) END) / 3.6e9 AS gap_hours FROM p LEFT JOIN g ON true GROUP BY 1""", floats=["gap_hours"])
def hours_to_nearest_outage(t: Tables):
    bins = _uptime(t).withColumn("site", F.lit(1))
    gaps = iv.flag_runs(bins, ["site"], ~F.col("available"), min_s=7200)
    points = t.spans().where("event_type = 'view'").select("event_id", F.col("start_utc").alias("at"))
    return iv.nearest_gap_hours(points, gaps, ["event_id"], "at")


@query(f"""WITH {UPTIME}, {RUNS}, g AS (SELECT start_utc AS s, end_utc AS e FROM runs WHERE NOT available), w AS (SELECT event_id AS scene_id, ts - INTERVAL 15 MINUTE AS a, ts + INTERVAL 15 MINUTE AS z
FROM events WHERE event_type = 'purchase') SELECT scene_id, NOT EXISTS (SELECT 1 FROM g WHERE s < z AND e > a) AS gap_free FROM w""")
def windows_without_outage(t: Tables):
    bins = _uptime(t).withColumn("site", F.lit(1))
    gaps = iv.flag_runs(bins, ["site"], ~F.col("available")).drop("site")
    w = t.raw("events").where("event_type = 'purchase'")
    a, z = times.around(F.col("ts"), 900)
    n = iv.overlap_counts(w.select(F.col("event_id").alias("scene_id"), a.alias("w_start"), z.alias("w_end")), gaps, ["scene_id"])
    return n.select("scene_id", (F.col("n_overlaps") == 0).alias("gap_free"))


@query("""WITH m AS (SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH)) AS u FROM lineitem)
SELECT CAST(u AS TIMESTAMP) AS unit_start, count(l_shipdate) AS n_items FROM m LEFT JOIN lineitem ON date_trunc('month', l_shipdate) = u AND l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08 GROUP BY 1""")
def files_per_month(t: Tables):
    """Every calendar month with its number of files, months without any included."""
    li = t.raw("lineitem")
    span = li.agg(times.utc(F.min("l_shipdate")).alias("start_utc"), times.utc(F.max("l_shipdate")).alias("end_utc"))
    rare = li.where("l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08").select(times.utc(F.col("l_shipdate")).alias("start_utc"))
    return iv.empty_units(rare, "month", span)


@query("""WITH s AS (SELECT c_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING min(o_orderdate) < max(o_orderdate)),
h AS (SELECT c_custkey, a, z, unnest(generate_series(date_trunc('year', a), z, INTERVAL 1 YEAR)) AS h FROM s)
SELECT c_custkey, greatest(CAST(h AS TIMESTAMP), a) AS chunk_start_utc, least(CAST(h AS TIMESTAMP) + INTERVAL 1 YEAR, z) AS chunk_end_utc FROM h
WHERE greatest(CAST(h AS TIMESTAMP), a) < least(CAST(h AS TIMESTAMP) + INTERVAL 1 YEAR, z)""")
def year_chunks(t: Tables):
    c = t.raw("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t.raw("orders").withColumnRenamed("o_custkey", "c_custkey").join(c, "c_custkey")
    s = o.groupBy("c_custkey").agg(times.utc(F.min("o_orderdate")).alias("start_utc"), times.utc(F.max("o_orderdate")).alias("end_utc"))
    return times.calendar_chunks(s.where("start_utc < end_utc"), "year", ("c_custkey",))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT d, timezone('UTC', timezone('America/Vancouver', d + TIME '09:15:00')) AS s,
timezone('UTC', timezone('America/Vancouver', d + TIME '11:45:00')) AS e FROM d) SELECT d AS date, s AS start_utc, e AS end_utc, CAST(hour(s) AS INTEGER) NOT IN (16, 17, 18) AS off_strip FROM x""")
def local_overpass_windows(t: Tables):
    d = t.raw("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    w = d.withColumn("w", times.local_window(F.col("date"))).select("date", "w.start_utc", "w.end_utc")
    return w.withColumn("off_strip", times.off_strip(F.col("start_utc")))


@query("""WITH s AS (SELECT c_custkey, substr(c_name, 1, 17) AS prefix FROM customer), k AS (SELECT DISTINCT substr(s_name, 10, 8) AS p FROM supplier)
SELECT 'left' AS side, count(*) AS n_keys FROM (SELECT DISTINCT substr(prefix, 10, 8) AS p FROM s) a WHERE p NOT IN (SELECT p FROM k)
UNION ALL SELECT 'right', count(*) FROM k WHERE p NOT IN (SELECT substr(prefix, 10, 8) FROM s)""")
def unmatched_keys(t: Tables):
    """Keys found on one side only, both ways (zero counts included)."""
    a = t.raw("customer").select(F.substring("c_name", 10, 8).alias("p"))
    b = t.raw("supplier").select(F.substring("s_name", 10, 8).alias("p"))
    n = unmatched(a, b, ["p"]).groupBy("side").agg(F.count("*").alias("n"))
    sides = t.spark.range(1).select(F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    return sides.join(n, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n_keys"))


@query("""WITH s AS (SELECT c_name AS scene_id, substr(trim(c_name), 1, 13) AS prefix FROM customer), c AS (SELECT prefix, count(*) AS n FROM s GROUP BY 1)
SELECT s.scene_id, s.prefix, length(s.prefix) AS vessel_count, c.n AS label_shared_by FROM s JOIN c USING (prefix)""")
def shared_labels(t: Tables):
    """Labels keyed by a 13-character prefix, joined to all scenes that share it."""
    s = t.raw("customer").select(F.col("c_name").alias("scene_id"))
    counts = s.select(F.substring(F.trim("scene_id"), 1, 13).alias("timestamp")).distinct().withColumn("vessel_count", F.length("timestamp"))
    return label_scenes(s, counts)
