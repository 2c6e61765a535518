"""Queries over frames: bands, baselines, per-bin statistics, population tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelight.functions.maths import array_median
from tidelight.operators import gating, reports, spectra as sp
from tidelight.operators.ordered import number_rows
from tidelight.plans.base import CELLS, FRAMES, Tables, query

N = 64
# Bands that fit the 64 bins of the stand-in (bins 4-16, 1-4, 24-36, 48-62).
BANDS = {"small_craft": (1_000.0, 4_000.0), "ship_proxy": (250.0, 1_000.0), "rain": (6_000.0, 9_000.0), "control": (12_000.0, 15_500.0)}
BAND_BINS = "b(band, a, z) AS (VALUES ('small_craft', 4, 16), ('ship_proxy', 1, 4), ('rain', 24, 36), ('control', 48, 62))"
LEVELS = f"""{FRAMES}, {BAND_BINS}, lv AS (SELECT win, frame, band, CAST(list_aggregate(levels[a + 1:z + 1], 'median') AS DOUBLE) AS level,
z - a + 1 AS n_bins, len(list_filter(levels[a + 1:z + 1], lambda x: x <= 0)) AS n_floor FROM fr, b)"""
EXCESS = f"""{LEVELS}, bs AS (SELECT win, band, quantile_cont(level, 0.1) AS baseline FROM lv GROUP BY 1, 2),
ex AS (SELECT lv.win, lv.frame, lv.band, level, baseline, level - baseline AS excess FROM lv JOIN bs ON bs.win = lv.win AND bs.band = lv.band)"""


@query(f"WITH {LEVELS} SELECT win, frame, band, level, n_bins, CAST(n_floor AS INTEGER) AS n_floor FROM lv", floats=["level"])
def band_levels(t: Tables):
    return sp.band_levels(t.frames(), BANDS, ["win", "frame"], N)


@query(f"WITH {EXCESS} SELECT win, frame, band, level, baseline, excess FROM ex", floats=["level", "baseline", "excess"])
def band_excess(t: Tables):
    lv = sp.band_levels(t.frames(), BANDS, ["win", "frame"], N).drop("n_bins", "n_floor")
    return sp.with_excess(lv, ["win", "band"])


@query(f"""WITH {EXCESS} SELECT win, band, min(baseline) AS baseline, max(excess) AS peak_excess, arg_max(frame, (excess, -frame)) AS at_peak FROM ex GROUP BY 1, 2""",
       floats=["baseline", "peak_excess"])
def band_peaks(t: Tables):
    lv = sp.band_levels(t.frames(), BANDS, ["win", "frame"], N)
    return sp.excess_peaks(sp.with_excess(lv, ["win", "band"]), ["win", "band"], F.col("frame"))


@query(f"WITH {LEVELS} SELECT win, band, CAST(sum(n_floor) AS BIGINT) AS n_floor, CAST(sum(n_bins) AS BIGINT) AS n_cells, sum(n_floor) / sum(n_bins) AS fraction, max(level) AS max_level FROM lv GROUP BY 1, 2",
       floats=["fraction", "max_level"])
def window_band_censoring(t: Tables):
    lv = sp.band_levels(t.frames(), BANDS, ["win"], N)
    return lv.groupBy("win", "band").agg(F.sum("n_floor").alias("n_floor"), F.sum("n_bins").alias("n_cells"),
                                         (F.sum("n_floor") / F.sum("n_bins")).alias("fraction"), F.max("level").alias("max_level"))


@query(f"WITH {CELLS} SELECT win, bin, quantile_cont(level, 0.1) AS ambient FROM ce GROUP BY 1, 2", floats=["ambient"])
def per_bin_ambient(t: Tables):
    return sp.per_bin_percentiles(t.frames(), ["win"], [0.1]).select("win", "bin", F.col("values")[0].alias("ambient"))


@query(f"""WITH {CELLS}, am AS (SELECT win, bin, quantile_cont(level, 0.1) AS a FROM ce GROUP BY 1, 2)
SELECT ce.win, frame, ce.bin, level - a AS surplus FROM ce JOIN am ON am.win = ce.win AND am.bin = ce.bin""", floats=["surplus"])
def ambient_subtracted_cells(t: Tables):
    return sp.ambient_subtracted(t.frames(), ["win"]).select("win", "frame", F.posexplode("surplus").alias("bin", "surplus"))


@query(f"""WITH {CELLS}, m AS (SELECT win, bin, median(level) AS md, quantile_cont(level, 0.1) AS am FROM ce GROUP BY 1, 2),
d AS (SELECT ce.win, ce.bin, median(abs(level - md)) AS mad FROM ce JOIN m ON m.win = ce.win AND m.bin = ce.bin GROUP BY 1, 2)
SELECT ce.win, frame, ce.bin, CASE WHEN mad > 0 THEN (level - am) / (1.4826 * mad) END AS score FROM ce JOIN m ON m.win = ce.win AND m.bin = ce.bin
JOIN d ON d.win = ce.win AND d.bin = ce.bin""", floats=["score"])
def robust_cell_scores(t: Tables):
    return sp.robust_scores(t.frames(), ["win"]).select("win", "frame", F.posexplode("scores").alias("bin", "score"))


@query(f"""WITH {CELLS} SELECT win, bin, quantile_cont(level, 0.05) AS p5, quantile_cont(level, 0.25) AS p25, median(level) AS p50, quantile_cont(level, 0.75) AS p75,
quantile_cont(level, 0.95) AS p95 FROM ce GROUP BY 1, 2""", floats=["p5", "p25", "p50", "p75", "p95"])
def percentile_spectra(t: Tables):
    ps = (5, 25, 50, 75, 95)
    q = sp.per_bin_percentiles(t.frames(), ["win"], [p / 100 for p in ps])
    by_name = F.map_from_arrays(F.array(*[F.lit(p) for p in ps]), F.col("values"))
    return q.withColumn("spectra", by_name).select("win", "bin", *[F.col("spectra")[p].alias(f"p{p}") for p in ps])


@query(f"""WITH {CELLS}, am AS (SELECT win, bin, quantile_cont(level, 0.1) AS ambient FROM ce GROUP BY 1, 2), {BAND_BINS}
SELECT win, band, median(ambient) AS baseline, CAST(0 AS BIGINT) AS n_null FROM am JOIN b ON bin BETWEEN a AND z GROUP BY 1, 2""", floats=["baseline"])
def band_baselines(t: Tables):
    am = sp.per_bin_percentiles(t.frames(), ["win"], [0.1]).select("win", "bin", F.col("values")[0].alias("ambient"))
    return sp.band_baseline(am, ["win"], BANDS, N)


@query(f"""WITH {CELLS}, am AS (SELECT win, bin, quantile_cont(power(10.0, level / 10.0), 0.1) AS p FROM ce WHERE bin BETWEEN 4 AND 16 GROUP BY 1, 2),
e AS (SELECT ce.win, frame, ce.bin, greatest(power(10.0, level / 10.0) - p, 0) AS w FROM ce JOIN am ON am.win = ce.win AND am.bin = ce.bin)
SELECT win, frame, sum(w * bin * 250.0) / nullif(sum(w), 0) AS centroid_hz FROM e GROUP BY 1, 2""", floats=["centroid_hz"])
def spectral_centroids(t: Tables):
    return sp.spectral_centroid(t.frames(), ["win"], BANDS["small_craft"], N).select("win", "frame", "centroid_hz")


@query(f"""WITH {CELLS} SELECT win, count(*) AS n_cells, count(*) FILTER (WHERE level <= 0) AS n_at_floor, count(*) FILTER (WHERE level >= 86) AS n_at_ceiling,
count(*) FILTER (WHERE level <= 0) / count(*) AS fraction_at_floor, count(*) FILTER (WHERE level >= 86) / count(*) AS fraction_at_ceiling FROM ce GROUP BY 1""",
       floats=["fraction_at_floor", "fraction_at_ceiling"])
def censoring_report(t: Tables):
    return sp.censoring(t.frames(), ["win"])


def _region(name: str, a: int, z: int) -> str:
    w = f"bin BETWEEN {a} AND {z}"
    return (f"count(*) FILTER (WHERE {w} AND level <> 0) AS {name}_nonzero, count(*) FILTER (WHERE {w}) AS {name}_total, "
            f"max(level) FILTER (WHERE {w}) AS {name}_max")


@query(f"WITH {CELLS} SELECT win, {_region('dc', 0, 0)}, {_region('tail', 52, 56)}, {_region('hard', 57, 63)} FROM ce GROUP BY 1")
def structural_zero_report(t: Tables):
    return sp.structural_zeros(t.frames(), ["win"], 0, (52, 56), (57, 63))


@query(f"WITH {CELLS} SELECT win, bin, avg(level) AS mean_level FROM ce WHERE bin BETWEEN 48 AND 56 GROUP BY 1, 2", floats=["mean_level"])
def rolloff_profile(t: Tables):
    return sp.rolloff_profile(t.frames(), ["win"], (48, 56))


@query(f"""WITH {CELLS}, p AS (SELECT win, bin, avg(power(10.0, level / 10.0)) AS pw FROM ce GROUP BY 1, 2),
m AS (SELECT win, median(pw) FILTER (WHERE bin >= 20 AND bin < 27) AS lo, median(pw) FILTER (WHERE bin >= 40 AND bin < 47) AS hi FROM p GROUP BY 1),
e AS (SELECT p.win, bin, greatest(pw - (lo + (hi - lo) * (bin - 23) / 20.0), 0) AS w FROM p JOIN m ON m.win = p.win WHERE bin >= 27 AND bin < 40)
SELECT win, sum(w * bin) / nullif(sum(w), 0) AS centroid_bin FROM e GROUP BY 1""", floats=["centroid_bin"])
def hump_centroids(t: Tables):
    return sp.hump_centroid(t.frames(), ["win"], (20, 27), (40, 47), (27, 40), fail=False)


@query(f"""WITH {CELLS}, v AS (SELECT win, bin, (count(*) * sum(level * level) - sum(level) * sum(level)) / (count(*) * count(*)) AS var FROM ce WHERE bin >= 20 AND bin < 50 GROUP BY 1, 2)
SELECT win, arg_max(bin, (var, -bin)) AS bin, sqrt(max(var)) AS std_level FROM v GROUP BY 1""", floats=["std_level"])
def temporal_std_peak(t: Tables):
    return sp.most_varied_bin(t.frames(), ["win"], (20, 50))


@query(f"""WITH {CELLS}, top AS (SELECT win, max((level, -frame, -bin)) AS t FROM ce GROUP BY 1), g AS (SELECT win, t[1] AS level, -t[2] AS frame, -t[3] AS bin FROM top)
SELECT win, level, frame, bin, concat_ws(',', CASE WHEN abs(bin - 20) > 15 THEN 'frequency' END, CASE WHEN abs(frame - 200) > 150 THEN 'time' END, CASE WHEN abs(level - 90) > 4 THEN 'level' END) AS misses FROM g""")
def tone_misses(t: Tables):
    wins = t.frames().select("win").distinct()
    claims = wins.select("win", F.lit(20).alias("claimed_bin"), F.lit(200).alias("claimed_frame"), F.lit(90).alias("claimed_level"))
    return sp.tone_check(t.frames(), ["win"], "frame", claims, 15, 150, 4).select("win", "level", "frame", "bin", "misses")


HIST = f"""{CELLS}, hi AS (SELECT win, bin, least(greatest(level, 0), 79) AS level, count(*) AS n, count(*) FILTER (WHERE level >= 80) AS n_over FROM ce GROUP BY 1, 2, 3)"""


@query(f"WITH {HIST} SELECT win, bin, level, n, n_over FROM hi")
def level_histogram(t: Tables):
    return sp.histogram(t.frames(), ["win"], 80)


@query(f"""WITH {HIST}, g AS (SELECT win, bin, level, CAST(sum(n) AS BIGINT) AS n FROM hi GROUP BY GROUPING SETS ((win, bin, level), (bin, level)))
SELECT win, bin, level, n, n / sum(n) OVER (PARTITION BY win, bin) AS density FROM g""", floats=["density"])
def pooled_histogram(t: Tables):
    return sp.pooled_histogram(sp.histogram(t.frames(), ["win"], 80), "win")


@query(f"""WITH {CELLS} SELECT win, bin, quantile_disc(greatest(level, 0), 0.05) AS p5, quantile_disc(greatest(level, 0), 0.25) AS p25, quantile_disc(greatest(level, 0), 0.5) AS p50,
quantile_disc(greatest(level, 0), 0.75) AS p75, quantile_disc(greatest(level, 0), 0.95) AS p95 FROM ce GROUP BY 1, 2""")
def histogram_percentiles(t: Tables):
    return sp.histogram_percentiles(sp.histogram(t.frames(), ["win"]), ["win"], [0.05, 0.25, 0.5, 0.75, 0.95])


@query(f"""WITH {HIST} SELECT a.win, a.bin, least(a.p, 79) AS ambient FROM (SELECT win, bin, quantile_disc(greatest(level, 0), 0.1) AS p FROM ce WHERE bin < 60 GROUP BY 1, 2) a
UNION ALL SELECT DISTINCT win, CAST(b AS INTEGER), NULL FROM ce, range(60, 64) r(b)""")
def seasonal_ambient(t: Tables):
    """Ambient per season on the full axis; bins without counts stay NULL."""
    hist = sp.histogram(t.frames(), ["win"], 80).where("bin < 60")
    return sp.ambient_on_axis(sp.seasonal_ambient(hist, "win"), "win", N)


@query(f"WITH {CELLS} SELECT win, bin, median(level) AS level FROM ce GROUP BY 1, 2", floats=["level"])
def median_spectra(t: Tables):
    return sp.median_spectra(t.frames(), ["win"])


STATS = f"""{LEVELS}, c2 AS (SELECT win, frame, CAST(generate_subscripts(levels, 1) - 1 AS INTEGER) AS bin, unnest(levels) AS level FROM fr),
pf AS (SELECT win, band, quantile_cont(level, 0.1) AS band_p10, max(level) AS band_max FROM lv GROUP BY 1, 2),
pc AS (SELECT win, band, median(level) AS band_median FROM c2 JOIN b ON bin BETWEEN a AND z GROUP BY 1, 2)"""


@query(f"WITH {STATS} SELECT pf.win, pf.band, band_median, band_p10, band_max FROM pf JOIN pc ON pf.win = pc.win AND pf.band = pc.band", floats=["band_median", "band_p10", "band_max"])
def window_band_stats(t: Tables):
    return sp.window_band_stats(t.frames(), ["win"], BANDS, N)


@query(f"""WITH {STATS}, w AS (SELECT win % 3 AS season, band, median(band_median) AS m, count(*) AS n FROM pc GROUP BY 1, 2) SELECT season, band, m AS median_level, n AS n_windows FROM w""", floats=["median_level"])
def season_band_medians(t: Tables):
    stats = sp.window_band_stats(t.frames(), ["win"], BANDS, N).withColumn("season", F.col("win") % 3)
    return sp.season_medians(stats, "season", "band_median")


@query(f"""WITH {STATS}, w AS (SELECT win % 3 AS season, band, median(band_median) AS m FROM pc GROUP BY 1, 2) SELECT band, max(m) - min(m) AS spread FROM w GROUP BY 1""", floats=["spread"])
def season_band_spread(t: Tables):
    stats = sp.window_band_stats(t.frames(), ["win"], BANDS, N).withColumn("season", F.col("win") % 3)
    return sp.season_spread(sp.season_medians(stats, "season", "band_median"))


QUALITY = f"""{CELLS}, q AS (SELECT win, frame % 5 AS part, max(level) AS max_level, avg(CAST(level <= 0 AS INTEGER)) AS floor_all,
count(*) FILTER (WHERE bin BETWEEN 1 AND 50 AND level <= 0) / count(*) FILTER (WHERE bin BETWEEN 1 AND 50) AS floor_inband,
count(*) FILTER (WHERE bin >= 57 AND level <= 0) / count(*) FILTER (WHERE bin >= 57) AS floor_dead, max(level) FILTER (WHERE bin = 0) AS bin0_max,
count(*) FILTER (WHERE bin = 0 AND level <> 0) / count(*) FILTER (WHERE bin = 0) AS dc_nonzero FROM ce GROUP BY 1, 2)"""


def _quality(t: Tables):
    f = t.frames().withColumn("part", F.col("frame") % 5)
    return sp.window_quality(f, ["win", "part"], 50, 57)


@query(f"WITH {QUALITY} SELECT * FROM q", floats=["floor_all", "floor_inband", "floor_dead", "dc_nonzero"])
def window_quality(t: Tables):
    return _quality(t)


@query(f"WITH {QUALITY} SELECT win, avg(CAST(bin0_max > 75 OR dc_nonzero > 1 AS INTEGER)) AS violation_rate, count(*) AS n_windows FROM q GROUP BY 1", floats=["violation_rate"])
def quality_violations(t: Tables):
    return sp.violation_rate(_quality(t), ["win"], 75, 1.0)


HUMP = f"""{CELLS}, hx AS (SELECT win, frame % 5 AS part, avg(level) FILTER (WHERE bin BETWEEN 27 AND 39) - 0.5 * (avg(level) FILTER (WHERE bin BETWEEN 20 AND 26)
+ avg(level) FILTER (WHERE bin BETWEEN 40 AND 46)) AS hump_excess FROM ce GROUP BY 1, 2)"""


def _hump(t: Tables):
    return sp.hump_excess(t.frames().withColumn("part", F.col("frame") % 5), ["win", "part"], (27, 39), (20, 26), (40, 46))


@query(f"WITH {HUMP} SELECT * FROM hx", floats=["hump_excess"])
def hump_excess(t: Tables):
    return _hump(t)


@query(f"WITH {HUMP} SELECT win, median(hump_excess) AS median_excess, avg(CAST(hump_excess < 0.5 AS INTEGER)) AS share_absent, count(*) AS n_windows FROM hx GROUP BY 1", floats=["median_excess", "share_absent"])
def hump_by_season(t: Tables):
    return sp.hump_by_season(_hump(t), "win", 0.5)


AMB3 = f"""{CELLS}, am AS (SELECT win % 3 AS season, bin, quantile_disc(greatest(level, 0), 0.1) AS ambient FROM ce GROUP BY 1, 2),
own AS (SELECT win, win % 3 AS season, bin, quantile_cont(level, 0.1) AS own, median(level) AS med FROM ce GROUP BY 1, 3)"""


def _season_ambient(t: Tables):
    f = t.frames().withColumn("season", F.col("win") % 3)
    return sp.seasonal_ambient(sp.histogram(f, ["season"]), "season")


@query(f"""WITH {AMB3}, d AS (SELECT win, own.bin, own - ambient AS d FROM own JOIN am ON am.season = own.season AND am.bin = own.bin)
SELECT win, median(d) FILTER (WHERE bin BETWEEN 4 AND 16) AS shift_band, median(d) AS shift_all FROM d GROUP BY 1""", floats=["shift_band", "shift_all"])
def floor_shift(t: Tables):
    own = sp.per_bin_percentiles(t.frames(), ["win"], [0.1]).select("win", (F.col("win") % 3).alias("season"), "bin", F.col("values")[0].alias("own"))
    return sp.floor_shift(own, _season_ambient(t), ["win"], "season", (4, 16))


@query(f"WITH {AMB3} SELECT win, own.season, own.bin, med - ambient AS white FROM own JOIN am ON am.season = own.season AND am.bin = own.bin", floats=["white"])
def whitened_spectra(t: Tables):
    med = sp.median_spectra(t.frames(), ["win"]).withColumn("season", F.col("win") % 3)
    return sp.whitened_by_season(med, _season_ambient(t), "season").select("win", "season", "bin", "white")


@query(f"""WITH {CELLS}, a AS (SELECT DISTINCT win % 3 AS season FROM ce WHERE win % 3 <> 2) SELECT w.win, w.season,
CASE WHEN a.season IS NULL THEN 'no ambient for this season' END AS note FROM (SELECT DISTINCT win, win % 3 AS season FROM ce) w LEFT JOIN a ON a.season = w.season""")
def window_ambient_notes(t: Tables):
    """Windows take the ambient of their own season; a season without one gets a note, never a neighbour's."""
    f = t.frames().withColumn("season", F.col("win") % 3)
    prof = sp.profiles(_season_ambient(t).where("season <> 2"), ["season"], F.col("ambient"), "ambient")
    return sp.attach_season_ambient(f.select("win", "season").distinct(), prof, "season").select("win", "season", "note")


@query(f"""WITH {AMB3}, p AS (SELECT win, bin < 32 AS low_half, own AS x, med AS y FROM own WHERE bin > 0)
SELECT win, low_half, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, count(*) AS n FROM p GROUP BY 1, 2""", floats=["slope", "intercept", "r"])
def level_regression(t: Tables):
    q = sp.per_bin_percentiles(t.frames(), ["win"], [0.1, 0.5]).where("bin > 0")
    pairs = q.select("win", (F.col("bin") < 32).alias("low_half"), F.col("values")[0].alias("x"), F.col("values")[1].alias("y"))
    return sp.level_regression(pairs, ["win", "low_half"], "y", "x")


@query(f"""WITH {CELLS}, m AS (SELECT win, bin, median(level) AS md FROM ce GROUP BY 1, 2), b(band, a, z) AS (VALUES (0, 4, 15), (1, 16, 39), (2, 40, 60))
SELECT ce.win, frame, band, avg(level - md) AS level FROM ce JOIN m ON m.win = ce.win AND m.bin = ce.bin JOIN b ON ce.bin BETWEEN a AND z GROUP BY 1, 2, 3""", floats=["level"])
def whitened_band_levels(t: Tables):
    return sp.whitened_levels(t.frames(), ["win"], ["win", "frame"], [(1_000.0, 4_000.0), (4_000.0, 10_000.0), (10_000.0, 15_250.0)], N)


@query(f"""WITH {EXCESS}, p AS (SELECT win, band, min(baseline) AS b, max(excess) AS x FROM ex GROUP BY 1, 2),
w AS (SELECT win, max(x) FILTER (WHERE band = 'small_craft') AS craft_peak, max(x) FILTER (WHERE band = 'rain') AS rain_peak, max(x) FILTER (WHERE band = 'control') AS control_peak,
max(b) FILTER (WHERE band = 'control') AS control_baseline FROM p GROUP BY 1)
SELECT win, craft_peak, rain_peak, control_peak, control_baseline, rain_peak - craft_peak AS rain_minus_craft,
CASE WHEN rain_peak - craft_peak < -1 THEN 'vessel-like' WHEN rain_peak - craft_peak > 1 THEN 'rain-like' ELSE 'ambiguous' END AS shape_reading,
abs(control_baseline - 47) AS control_drift, CASE WHEN abs(control_baseline - 47) > 1 THEN 'suspect' ELSE 'stable' END AS control_reading,
CASE WHEN control_peak >= craft_peak / 2 THEN 'broadband' ELSE 'quiet' END AS control_peak_reading FROM w""",
       floats=["craft_peak", "rain_peak", "control_peak", "control_baseline", "rain_minus_craft", "control_drift"])
def window_diagnostics(t: Tables):
    lv = sp.band_levels(t.frames(), BANDS, ["win", "frame"], N)
    peaks = sp.excess_peaks(sp.with_excess(lv, ["win", "band"]), ["win", "band"], F.col("frame"))
    return reports.diagnostics(peaks, ["win"], deadband=1.0, expected=47.0, tolerance=1.0)


@query(f"""WITH {CELLS}, m AS (SELECT win, bin, median(level) FILTER (WHERE frame % 4 = 0) AS event_level, median(level) FILTER (WHERE frame % 4 <> 0) AS quiet_level FROM ce GROUP BY 1, 2)
SELECT win, bin, event_level, quiet_level, event_level - quiet_level AS difference FROM m""", floats=["event_level", "quiet_level", "difference"])
def event_spectra(t: Tables):
    return reports.event_spectrum(t.frames(), ["win"], F.col("frame") % 4 == 0)


@query(f"""WITH {FRAMES}, r AS (SELECT win, frame, row_number() OVER (PARTITION BY win ORDER BY frame) - 1 AS rn, count(*) OVER (PARTITION BY win) AS n FROM fr)
SELECT DISTINCT r.win, r.frame FROM r JOIN range(10) t(i) ON r.rn = floor(i * (n - 1) / 9.0)""")
def evenly_spaced_frames(t: Tables):
    return gating.evenly_spaced(t.frames().select("win", "frame"), ["win"], ["frame"], 10).select("win", "frame")


@query(f"""WITH {CELLS}, mx AS (SELECT win, frame, max(level) AS l FROM ce WHERE bin BETWEEN 24 AND 36 GROUP BY 1, 2), k(lag) AS (VALUES (1), (2), (3), (4)),
p AS (SELECT win, frame, l, row_number() OVER (PARTITION BY win ORDER BY frame) AS rn FROM mx)
SELECT a.win, lag, corr(a.l, b.l) AS r FROM p a, k, p b WHERE b.win = a.win AND b.rn = a.rn - lag GROUP BY 1, 2""", floats=["r"])
def hump_autocorrelation(t: Tables):
    top = t.frames().select("win", "frame", F.array_max(F.slice("levels", 25, 13)).alias("l"))
    return reports.autocorrelation(number_rows(top, ["win"], ["frame"]), "l", (1, 2, 3, 4))


@query(f"""WITH c AS (SELECT c_custkey, 250.0 * (c_custkey % 9) AS lo, 4000.0 + 100.0 * (c_custkey % 7) AS hi, c_acctbal FROM customer), s AS (SELECT s_suppkey, s_nationkey, 100.0 * s_suppkey % 900 AS lo, 3500.0 + s_suppkey % 11 * 100 AS hi FROM supplier),
j AS (SELECT c_custkey, greatest(c.lo, s.lo) AS a, least(c.hi, s.hi, 8000.0, 4200.0) AS z FROM c JOIN s ON c_custkey = s_suppkey)
SELECT c_custkey, CASE WHEN z - a >= 2500 THEN a END AS lo_hz, CASE WHEN z - a >= 2500 THEN z END AS hi_hz, CASE WHEN z - a < 2500 THEN 'too_narrow' END AS reason FROM j""", floats=["lo_hz", "hi_hz"])
def common_supports(t: Tables):
    c = t.raw("customer").select("c_custkey", (250.0 * (F.col("c_custkey") % 9)).alias("lo1"), (4000.0 + 100.0 * (F.col("c_custkey") % 7)).alias("hi1"))
    s = t.raw("supplier").select(F.col("s_suppkey").alias("c_custkey"), (100.0 * F.col("s_suppkey") % 900).alias("lo2"), (3500.0 + F.col("s_suppkey") % 11 * 100).alias("hi2"))
    j = c.join(s, "c_custkey")
    got = sp.common_support_columns([F.col("lo1"), F.col("lo2")], [F.col("hi1"), F.col("hi2")], [F.lit(16_000.0), F.lit(8_400.0)], 2_500.0)
    return j.withColumn("s", got).select("c_custkey", "s.lo_hz", "s.hi_hz", "s.reason")


@query("""SELECT verdict, count(*) AS n_pairs FROM (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 'undeclared_state' WHEN o_orderkey % 5 = 0 THEN 'band_mismatch'
WHEN o_orderpriority LIKE '1%' AND NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0) THEN 'not_calibrated' ELSE 'comparable' END AS verdict FROM orders) GROUP BY 1""")
def comparability_verdicts(t: Tables):
    o = t.raw("orders")
    undeclared = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0)
    cal = lambda c: F.when(c, "calibrated").otherwise("relative")
    lo = F.when(F.col("o_orderkey") % 5 == 0, 300.0).otherwise(250.0)
    v = sp.comparability(lo, F.lit(4000.0), F.lit(250.0), F.lit(4000.0), F.when(~undeclared, cal(F.col("o_orderstatus") == "F")),
                         cal(F.col("o_orderkey") % 2 == 0), F.when(F.col("o_orderpriority").startswith("1"), "absolute_level").otherwise("shape"),
                         F.lit(250.0), F.lit(4000.0))
    return o.groupBy(v.alias("verdict")).agg(F.count("*").alias("n_pairs"))


@query(f"""WITH {FRAMES}, {BAND_BINS}, r AS (SELECT frame, band, CASE band WHEN 'small_craft' THEN 2500 WHEN 'ship_proxy' THEN 625 WHEN 'rain' THEN 7500 ELSE 13750 END AS centre FROM fr, b)
SELECT band, centre > 2200 AS resolved, count(*) AS n_frames FROM r GROUP BY 1, 2""")
def decidecade_labels(t: Tables):
    b = sp.with_bands(t.frames().select("frame"), BANDS)
    return b.groupBy("band", sp.decidecade_resolved((F.col("lo_hz") + F.col("hi_hz")) / 2).alias("resolved")).agg(F.count("*").alias("n_frames"))


@query(f"""WITH {FRAMES} SELECT win, frame, CAST(list_aggregate(list_transform(levels, lambda x: x), 'median') AS DOUBLE) AS level FROM fr""", floats=["level"])
def broadband_levels(t: Tables):
    return t.frames().select("win", "frame", array_median(F.col("levels")).alias("level"))
