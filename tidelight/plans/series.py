"""Queries over level series: events, merging, smoothing, passages, nulls, estimators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.operators import estimators as es
from tidelight.operators import events as ev
from tidelight.operators import reports, spectra as sp
from tidelight.operators.intervals import overlap_counts
from tidelight.operators.ordered import number_rows
from tidelight.plans.base import SERIES, Tables, query
from tidelight.plans.spectral import BANDS, LEVELS, N
from tidelight.session import cut

KEY, ORDER, AT = ["user_id"], ["at", "event_id"], "t"
FRAME_S, SHORTEST, THRESHOLD = 36_000.0, 2, 10.0
SMOOTH, SPACING = 5, 6

NUMBERED = f"""{SERIES}, bl AS (SELECT user_id, quantile_cont(level, 0.1) AS baseline FROM se GROUP BY 1),
nu AS (SELECT se.*, baseline, level - baseline AS excess, row_number() OVER (PARTITION BY se.user_id ORDER BY ts, event_id) - 1 AS rn FROM se JOIN bl ON bl.user_id = se.user_id)"""


def _events_sql(src: str, keys: str, out: str, hot: str = "excess >= 10", shortest: int = 2, frame: float = 36000.0) -> str:
    return f"""h_{out} AS (SELECT *, rn - row_number() OVER (PARTITION BY {keys} ORDER BY rn) AS g FROM {src} WHERE {hot}),
{out} AS (SELECT {keys}, min(t) AS t_start, arg_max(t, (excess, -rn)) AS t_peak, count(*) AS n_frames, max(excess) AS peak_excess, count(*) * {frame} AS duration_s
FROM h_{out} GROUP BY {keys}, g HAVING count(*) >= {shortest})"""


def _merge_sql(src: str, keys: str, out: str, gap: str) -> str:
    return f"""q1_{out} AS (SELECT *, t_start + duration_s AS t_end, max(t_start + duration_s) OVER (PARTITION BY {keys} ORDER BY t_start, t_peak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
q2_{out} AS (SELECT *, sum(CASE WHEN t_start - reach <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY t_start, t_peak) AS chain FROM q1_{out}),
{out} AS (SELECT {keys}, min(t_start) AS t_start, arg_max(t_peak, (peak_excess, -t_start)) AS t_peak, max(peak_excess) AS peak_excess, count(*) AS n_fragments,
max(t_end) - min(t_start) AS duration_s FROM q2_{out} GROUP BY {keys}, chain)"""


EVENTS = f"{NUMBERED}, {_events_sql('nu', 'user_id', 'ev')}"
_F = ["t_start", "t_peak", "peak_excess", "duration_s"]


def _ordered_events(t: Tables, levels=None):
    return ev.ordered_events(t.series() if levels is None else levels, KEY, ORDER, AT, threshold=THRESHOLD, frame_s=FRAME_S, shortest=SHORTEST)


def _events(t: Tables, levels=None):
    return _ordered_events(t, levels).rows.drop("_rn", "_block")


@query(f"WITH {EVENTS} SELECT * FROM ev", floats=_F)
def events_found(t: Tables):
    return _events(t)


@query(f"WITH {EVENTS}, {_merge_sql('ev', 'user_id', 'me', '43200')} SELECT * FROM me", floats=_F)
def events_merged(t: Tables):
    return ev.merge_events(_ordered_events(t), KEY, 43_200.0)


GAPS = fixed.MERGE_GAP_SWEEP


@query(f"""WITH {EVENTS}, x AS (SELECT ev.*, CAST(g AS DOUBLE) AS gap_s FROM ev, (SELECT unnest({[g * 720 for g in GAPS]}) AS g)),
{_merge_sql('x', 'user_id, gap_s', 'me', 'gap_s')} SELECT gap_s, count(*) AS n_merged, CAST(sum(n_fragments) AS BIGINT) AS n_fragments FROM me GROUP BY 1""", floats=["gap_s"])
def merge_gap_sweep(t: Tables):
    m = ev.merge_sweep(_ordered_events(t), KEY, [g * 720 for g in GAPS])
    return m.groupBy("gap_s").agg(F.count("*").alias("n_merged"), F.sum("n_fragments").alias("n_fragments"))


SHUFFLED = f"""{SERIES}, s1 AS (SELECT user_id, ts, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM se),
s2 AS (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || event_id), event_id) - 1 AS rn FROM se),
sh AS (SELECT s1.*, level FROM s1 JOIN s2 ON s1.user_id = s2.user_id AND s1.rn = s2.rn), sb AS (SELECT user_id, quantile_cont(level, 0.1) AS baseline FROM sh GROUP BY 1),
sx AS (SELECT sh.*, level - baseline AS excess FROM sh JOIN sb ON sb.user_id = sh.user_id)"""


@query(f"WITH {SHUFFLED} SELECT user_id, event_id, t, level FROM sx", floats=["t"])
def shuffled_levels(t: Tables):
    return ev.shuffled(t.series().drop("event_type"), KEY, ORDER, "event_id", seed=7).select("user_id", "event_id", "t", "level")


@query(f"WITH {SHUFFLED}, {_events_sql('sx', 'user_id', 'ev', shortest=4)} SELECT user_id, count(*) AS n_events FROM ev GROUP BY 1")
def shuffle_null_events(t: Tables):
    sh = ev.shuffled(t.series(), KEY, ORDER, "event_id", seed=7)
    got = ev.find_events(sh, KEY, ORDER, AT, threshold=THRESHOLD, frame_s=FRAME_S, shortest=4)
    return got.groupBy("user_id").agg(F.count("*").alias("n_events"))


@query(f"""WITH {NUMBERED}, ends AS (SELECT user_id, max(rn) AS last FROM nu GROUP BY 1)
SELECT a.user_id, a.event_id, median(b.level) AS median FROM nu a JOIN ends USING (user_id) CROSS JOIN range(-3, 4) o(k)
JOIN nu b ON b.user_id = a.user_id AND b.rn = greatest(0, least(last, a.rn + k)) GROUP BY 1, 2""", floats=["median"])
def rolling_medians(t: Tables):
    """Centred rolling median; beyond an edge the end value repeats."""
    return ev.rolling_median(number_rows(t.series(), KEY, ORDER), "level", 7).select("user_id", "event_id", "median")


SMOOTHED = f"""{NUMBERED}, sm AS (SELECT *, sum(level) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS smooth,
count(*) OVER (PARTITION BY user_id) AS n FROM nu)"""


@query(f"WITH {SMOOTHED} SELECT user_id, event_id, smooth FROM sm", floats=["smooth"])
def smoothed_levels(t: Tables):
    return ev.smooth_mean(number_rows(t.series(), KEY, ORDER), "level", SMOOTH).select("user_id", "event_id", "smooth")


@query(f"""WITH {NUMBERED}, ends AS (SELECT user_id, max(rn) AS last FROM nu GROUP BY 1), c AS (SELECT nu.*, greatest(4, least(last - 4, rn)) AS centre FROM nu JOIN ends USING (user_id)),
fit AS (SELECT c.user_id, c.event_id, c.rn - c.centre AS u, sum((b.rn - c.centre) * b.level) / 60.0 AS c1, (9 * sum(power(b.rn - c.centre, 2) * b.level) - 60 * sum(b.level)) / 2772.0 AS c2
  FROM c JOIN nu b ON b.user_id = c.user_id AND b.rn BETWEEN c.centre - 4 AND c.centre + 4 GROUP BY ALL)
SELECT user_id, event_id, (c1 + 2 * c2 * u) / 0.25 * 60 AS slope_per_min FROM fit""", floats=["slope_per_min"])
def local_slopes(t: Tables):
    """Slope of a local quadratic fit; near the ends the last full window is fitted."""
    return ev.local_slope(number_rows(t.series(), KEY, ORDER), "level", 9, 0.25).select("user_id", "event_id", "slope_per_min")


TURNS = f"""{SMOOTHED}, w1 AS (SELECT *, sum(CASE WHEN smooth = pv THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS step FROM
(SELECT *, lag(smooth) OVER (PARTITION BY user_id ORDER BY rn) AS pv FROM sm WHERE n > 5)),
w2 AS (SELECT user_id, step, min(rn) AS f, max(rn) AS l, min(smooth) AS height FROM w1 GROUP BY 1, 2),
w3 AS (SELECT *, lag(height) OVER (PARTITION BY user_id ORDER BY step) AS a, lead(height) OVER (PARTITION BY user_id ORDER BY step) AS z FROM w2),
tops AS (SELECT user_id, (f + l) // 2 AS mid, height FROM w3 WHERE height > a AND height > z)"""


def _spaced_sql(floor: str, distance: int) -> str:
    return f"""cand AS (SELECT tops.*, tops.user_id * 1000000000 + mid AS id FROM tops JOIN bl ON bl.user_id = tops.user_id WHERE height >= {floor}),
cf AS (SELECT CASE WHEN (x.height, x.mid) > (y.height, y.mid) THEN x.id ELSE y.id END AS winner, CASE WHEN (x.height, x.mid) > (y.height, y.mid) THEN y.id ELSE x.id END AS loser
FROM cand x JOIN cand y ON x.user_id = y.user_id AND y.mid > x.mid AND y.mid - x.mid < {distance})"""


MIS = """st(kind, winner, loser) AS (SELECT 'open', winner, loser FROM cf UNION ALL
(WITH o AS (SELECT winner, loser FROM st WHERE kind = 'open'), lost AS (SELECT DISTINCT loser FROM o WHERE winner NOT IN (SELECT loser FROM o))
SELECT 'lost', NULL, loser FROM lost UNION ALL
SELECT 'open', winner, loser FROM o WHERE loser NOT IN (SELECT loser FROM lost) AND winner NOT IN (SELECT loser FROM lost)))"""

PROM = """pr AS (SELECT c.user_id, c.mid, c.height, c.height - greatest(
(SELECT min(smooth) FROM sm s WHERE s.user_id = c.user_id AND s.rn <= c.mid AND s.rn > c.lh), (SELECT min(smooth) FROM sm s WHERE s.user_id = c.user_id AND s.rn >= c.mid AND s.rn < c.rh)) AS prominence
FROM (SELECT k.*, coalesce((SELECT max(rn) FROM sm s WHERE s.user_id = k.user_id AND s.rn < k.mid AND s.smooth > k.height), -1) AS lh,
coalesce((SELECT min(rn) FROM sm s WHERE s.user_id = k.user_id AND s.rn > k.mid AND s.smooth > k.height), 1000000000) AS rh FROM cand k
WHERE k.id NOT IN (SELECT loser FROM st WHERE kind = 'lost')) c)"""


@query(f"""WITH RECURSIVE {TURNS}, {_spaced_sql('baseline + 5', SPACING)}, {MIS}, {PROM}
SELECT pr.user_id, mid, sm.t AS t_peak, height, prominence FROM pr JOIN sm ON sm.user_id = pr.user_id AND sm.rn = mid WHERE prominence >= 3""", floats=["t_peak", "height", "prominence"])
def passages_found(t: Tables):
    return ev.passages(t.series(), KEY, ORDER, AT, frames=SMOOTH, distance=SPACING, threshold=5.0, min_prominence=3.0)


@query(f"""WITH RECURSIVE {TURNS}, {_spaced_sql('0', SPACING)}, {MIS}, {PROM} SELECT user_id, mid, prominence FROM pr""", floats=["prominence"])
def peak_prominences(t: Tables):
    """Prominence of every separated local maximum, without a height test."""
    return ev.passages(t.series(), KEY, ORDER, AT, frames=SMOOTH, distance=SPACING, threshold=-1e9, min_prominence=0.0).select("user_id", "mid", "prominence")


def _registry():
    return es.registry(KEY, ORDER, AT, frame_s=FRAME_S, shortest=SHORTEST, frames=SMOOTH, distance=SPACING, threshold=5.0,
                       gaps=(43_200.0, 172_800.0), separation=172_800.0)


ALL_USERS = "us AS (SELECT DISTINCT user_id FROM se)"
HOT = "hot AS (SELECT *, smooth >= baseline + 5 AS h FROM sm)"
EDGES = "el AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, h, lag(h) OVER (PARTITION BY user_id ORDER BY rn) AS p FROM hot) WHERE h AND NOT coalesce(p, false) GROUP BY 1)"


@query(f"""WITH {NUMBERED}, {ALL_USERS}, {_events_sql('nu', 'user_id', 'ev', hot='excess >= 5')}, {_merge_sql('ev', 'user_id', 'm1', '43200')}, {_merge_sql('ev', 'user_id', 'm2', '172800')},
k AS (SELECT 'raw_events' AS method, user_id FROM ev UNION ALL SELECT 'merged_10s', user_id FROM m1 UNION ALL SELECT 'merged_120s', user_id FROM m2)
SELECT us.user_id, m.method, count(k.user_id) AS n_est FROM us JOIN (VALUES ('raw_events'), ('merged_10s'), ('merged_120s')) m(method) ON true LEFT JOIN k ON k.user_id = us.user_id AND k.method = m.method GROUP BY 1, 2""")
def estimators_by_threshold(t: Tables):
    r = _registry()
    lv = cut(t.series(), "levels")
    return es.run_all(lv, {n: r[n] for n in ("raw_events", "merged_10s", "merged_120s")})


@query(f"""WITH RECURSIVE {SMOOTHED}, {ALL_USERS}, {HOT},
g AS (SELECT *, CASE WHEN rn = 0 THEN lead(smooth) OVER w - smooth WHEN rn = n - 1 THEN smooth - lag(smooth) OVER w ELSE (lead(smooth) OVER w - lag(smooth) OVER w) / 2 END AS slope FROM hot WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
cr AS (SELECT user_id, t, rn, user_id * 1000000000 + rn AS id FROM (SELECT *, lead(slope) OVER (PARTITION BY user_id ORDER BY rn) AS nx FROM g) WHERE slope > 0 AND nx <= 0 AND h),
cf AS (SELECT x.id AS winner, y.id AS loser FROM cr x JOIN cr y ON x.user_id = y.user_id AND y.t > x.t AND y.t - x.t < 172800), {MIS},
k AS (SELECT user_id, count(*) AS n FROM cr WHERE id NOT IN (SELECT loser FROM st WHERE kind = 'lost') GROUP BY 1)
SELECT us.user_id, 'slope_zero_cross' AS method, coalesce(n, 0) AS n_est FROM us LEFT JOIN k ON k.user_id = us.user_id""")
def estimator_slope(t: Tables):
    return _registry()["slope_zero_cross"](cut(t.series(), "levels"))


@query(f"""WITH {SMOOTHED}, {ALL_USERS}, {HOT}, {EDGES} SELECT us.user_id, 'elevated_periods' AS method, coalesce(n, 0) AS n_est FROM us LEFT JOIN el ON el.user_id = us.user_id
UNION ALL SELECT us.user_id, 'any_elevation', least(coalesce(n, 0), 1) FROM us LEFT JOIN el ON el.user_id = us.user_id""")
def estimators_elevated(t: Tables):
    r = _registry()
    return es.run_all(cut(t.series(), "levels"), {n: r[n] for n in ("elevated_periods", "any_elevation")})


@query(f"""WITH RECURSIVE {TURNS}, {ALL_USERS}, {_spaced_sql('baseline + 5', SPACING)}, {MIS}, {PROM},
k AS (SELECT user_id, 'peak_prominence' AS method FROM pr WHERE prominence >= 2.5 UNION ALL SELECT user_id, 'peak_prominence_strict' FROM pr WHERE prominence >= 5)
SELECT us.user_id, m.method, count(k.user_id) AS n_est FROM us JOIN (VALUES ('peak_prominence'), ('peak_prominence_strict')) m(method) ON true LEFT JOIN k ON k.user_id = us.user_id AND k.method = m.method GROUP BY 1, 2""")
def estimators_by_prominence(t: Tables):
    r = _registry()
    return es.run_all(cut(t.series(), "levels"), {n: r[n] for n in ("peak_prominence", "peak_prominence_strict")})


# Manual counts stand-in: purchases per user; window level: mean level.
SCORED = f"""{NUMBERED}, {ALL_USERS}, {_events_sql('nu', 'user_id', 'ev', hot='excess >= 5')}, {_merge_sql('ev', 'user_id', 'm1', '43200')},
ct AS (SELECT us.user_id, 'raw_events' AS method, (SELECT count(*) FROM ev WHERE ev.user_id = us.user_id) AS n_est FROM us UNION ALL
SELECT us.user_id, 'merged_10s', (SELECT count(*) FROM m1 WHERE m1.user_id = us.user_id) FROM us),
tr AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS truth, avg(level) AS z FROM se GROUP BY 1), j AS (SELECT ct.*, truth, z FROM ct JOIN tr ON tr.user_id = ct.user_id),
sc AS (SELECT method, count(*) AS n_windows, CAST(sum(n_est) AS BIGINT) AS total_est, CAST(sum(truth) AS BIGINT) AS total_truth, avg(abs(n_est - truth)) AS mae, avg(CAST(abs(n_est - truth) <= 1 AS INTEGER)) AS within_1,
corr(n_est, truth) AS r, corr(n_est, z) AS rz, corr(truth, z) AS tz, sum(n_est) / sum(truth) AS ratio FROM j GROUP BY 1)"""


def _scores(t: Tables):
    r = _registry()
    lv = cut(t.series(), "levels")
    n = es.run_all(lv, {k: r[k] for k in ("raw_events", "merged_10s")})
    truth = lv.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("truth"), F.avg("level").alias("window_level"))
    return es.score_estimators(n.join(truth, "user_id"))


@query(f"WITH {SCORED} SELECT method, n_windows, total_est, total_truth, mae, within_1, r, ratio, (r - rz * tz) / sqrt((1 - rz * rz) * (1 - tz * tz)) AS partial_r FROM sc",
       floats=["mae", "within_1", "r", "ratio", "partial_r"])
def estimator_scores(t: Tables):
    return _scores(t)


@query(f"WITH {SCORED} SELECT method, ratio FROM sc WHERE abs(ratio - 1) <= 0.9", floats=["ratio"])
def estimators_near_total(t: Tables):
    return es.within_total(_scores(t), 0.9).select("method", "ratio")


# ---- bands of a user's series as concurrent bands ----------------------------------------------

BANDS_OF = ("click", "error", "purchase", "signup", "view")
# One whitened series per user and band, under the number user * 10 + band.
WHITE = f"""se AS (SELECT user_id * 10 + list_position({[*BANDS_OF]}, event_type) - 1 AS user_id, event_id, ts, epoch_us(ts) / 1e6 AS t,
CAST(floor(value / 4) AS INTEGER) - median(CAST(floor(value / 4) AS INTEGER)) OVER (PARTITION BY user_id, event_type) AS level FROM events)"""
BAND_PEAKS = f"""{TURNS.replace(SERIES, WHITE).replace('WHERE n > 5', '')}, {_spaced_sql('-1e9', SPACING)}, {MIS}, {PROM},
pk AS (SELECT pr.user_id // 10 AS user_id, pr.user_id % 10 AS band, sm.t FROM pr JOIN sm ON sm.user_id = pr.user_id AND sm.rn = mid WHERE prominence >= 3)"""
MIS2 = MIS.replace("st(kind", "s2(kind").replace("FROM st", "FROM s2").replace("FROM cf", "FROM c2")


@query(f"""WITH RECURSIVE {BAND_PEAKS}, nf AS (SELECT pk.user_id, pk.band, pk.t, sm.user_id % 10 AS lane, arg_min(sm.smooth, (abs(sm.t - pk.t), sm.t)) AS v FROM pk JOIN sm ON sm.user_id // 10 = pk.user_id GROUP BY ALL),
it AS (SELECT user_id, band, t, user_id || '|' || band || '|' || t AS id, list(v ORDER BY lane) AS p FROM nf GROUP BY ALL),
nm AS (SELECT *, sqrt(list_inner_product(p, p)) AS nm FROM it),
c2 AS (SELECT x.id AS winner, y.id AS loser FROM nm x JOIN nm y ON x.user_id = y.user_id AND (x.t, x.band) < (y.t, y.band) AND y.t - x.t <= 86400
  AND CASE WHEN x.nm * y.nm = 0 THEN 0 ELSE list_inner_product(x.p, y.p) / (x.nm * y.nm) END >= 0.95), {MIS2},
k AS (SELECT user_id, count(*) AS n FROM it WHERE id NOT IN (SELECT loser FROM s2 WHERE kind = 'lost') GROUP BY 1)
SELECT us.user_id, coalesce(n, 0) AS n_clusters FROM (SELECT DISTINCT user_id FROM events) us LEFT JOIN k USING (user_id)""")
def band_cluster_counts(t: Tables):
    """Whitened, smoothed bands of every user: prominent peaks clustered by time and profile over the bands."""
    s = t.series()
    med = s.groupBy("user_id", "event_type").agg(F.percentile("level", 0.5).alias("m"))
    white = s.join(med, ["user_id", "event_type"]).withColumn("white", F.col("level") - F.col("m"))
    return es.concurrent_clusters(white, ["user_id"], "event_type", BANDS_OF, ORDER, AT, "white", SMOOTH, SPACING, 3.0, seconds=86_400.0)


@query(f"""WITH RECURSIVE {TURNS}, {_spaced_sql('baseline + 5', SPACING)}, {MIS}, {PROM}, base AS (SELECT user_id, mid FROM pr WHERE prominence >= 3),
v AS (SELECT b.user_id, b.mid, event_type, count(*) AS n, max(level) AS top, median(level) AS med, arg_max(t, (level, -rn)) AS t FROM base b JOIN nu ON nu.user_id = b.user_id AND abs(rn - mid) <= 8 GROUP BY 1, 2, 3),
u AS (SELECT user_id, mid, CASE WHEN n >= 3 AND top - med >= 3 THEN t END AS t FROM v), o AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id, mid ORDER BY t) AS d FROM u WHERE t IS NOT NULL),
c AS (SELECT b.user_id, b.mid, 1 + (SELECT count(*) FROM o WHERE o.user_id = b.user_id AND o.mid = b.mid AND d > 43200) AS n FROM (SELECT DISTINCT user_id, mid FROM u) b),
k AS (SELECT user_id, CAST(greatest(count(*), sum(n)) AS BIGINT) AS n FROM c GROUP BY 1)
SELECT us.user_id, coalesce(n, 0) AS n_split FROM (SELECT DISTINCT user_id FROM events) us LEFT JOIN k USING (user_id)""")
def band_split_counts(t: Tables):
    """Passages of every user, counted more than once where the bands around one peak at different times."""
    o = number_rows(t.series(), KEY, ORDER).rows.select("user_id", F.col("event_type").alias("band"), F.col("_rn").alias("place"), "t", F.col("level").alias("smooth"))
    base = ev.passages(t.series(), KEY, ORDER, AT, frames=SMOOTH, distance=SPACING, threshold=5.0, min_prominence=3.0).select("user_id", "mid")
    return es.split_count(base, cut(o, "bands"), ["user_id"], "place", "t", 8, 3.0, 43_200.0)


# ---- membership, per-window tables ---------------------------------------------------------------

@query(f"""WITH {EVENTS} SELECT nu.user_id, nu.event_id, EXISTS (SELECT 1 FROM ev WHERE ev.user_id = nu.user_id AND nu.t >= ev.t_start AND nu.t < ev.t_start + ev.duration_s) AS in_event FROM nu""")
def frames_in_events(t: Tables):
    e = _events(t).select("user_id", F.timestamp_micros(F.round(F.col("t_start") * 1e6).cast("bigint")).alias("start_utc"),
                          F.timestamp_micros(F.round((F.col("t_start") + F.col("duration_s")) * 1e6).cast("bigint")).alias("end_utc"))
    f = t.series().select("user_id", "event_id", F.col("at").alias("w_start"), F.timestamp_micros(F.unix_micros("at") + 1).alias("w_end"))
    n = overlap_counts(f, e, ["event_id"], KEY)
    return n.select("user_id", "event_id", (F.col("n_overlaps") > 0).alias("in_event"))


PER_BAND = f"""{SERIES}, bl AS (SELECT user_id, event_type, quantile_cont(level, 0.1) AS baseline FROM se GROUP BY 1, 2),
nu AS (SELECT se.*, baseline, level - baseline AS excess, row_number() OVER (PARTITION BY se.user_id, se.event_type ORDER BY ts, event_id) - 1 AS rn FROM se JOIN bl ON bl.user_id = se.user_id AND bl.event_type = se.event_type),
{_events_sql('nu', 'user_id, event_type', 'ev')}, {_merge_sql('ev', 'user_id, event_type', 'me', '86400')},
lg AS (SELECT u.user_id AS scene_id, b.band, CASE WHEN s.n > 0 THEN (SELECT count(*) FROM ev WHERE ev.user_id = u.user_id AND ev.event_type = b.band) END AS n_events,
CASE WHEN s.n > 0 THEN (SELECT count(*) FROM me WHERE me.user_id = u.user_id AND me.event_type = b.band) END AS n_merged
FROM (SELECT DISTINCT user_id FROM se) u JOIN (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error')) b(band) ON true LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM se WHERE NOT (event_type = 'error' AND user_id % 5 = 0) GROUP BY 1, 2) s
ON s.user_id = u.user_id AND s.event_type = b.band)"""
BAND_NAMES = ("click", "view", "purchase", "signup", "error")


def _long(t: Tables):
    """Scenes x bands: NULL where the band was not recorded, 0 where nothing was found."""
    s = cut(t.series(), "levels")
    k = ["user_id", "event_type"]
    e = ev.ordered_events(s, k, ORDER, AT, threshold=THRESHOLD, frame_s=FRAME_S, shortest=SHORTEST)
    e = replace(e, rows=cut(e.rows, "events"))
    n = e.rows.groupBy(*k).agg(F.count("*").alias("n_events"))
    m = ev.merge_events(e, k, 86_400.0).groupBy(*k).agg(F.count("*").alias("n_merged"))
    grid = s.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*[F.lit(b) for b in BAND_NAMES])))
    seen = s.where("NOT (event_type = 'error' AND user_id % 5 = 0)").groupBy(*k).agg(F.count("*").alias("n"))
    rows = grid.join(seen, k, "left")
    rows = reports.with_outcomes(rows, n, k, ["n_events"], F.col("n") > 0)
    rows = reports.with_outcomes(rows, m, k, ["n_merged"], F.col("n") > 0)
    return rows.select(F.col("user_id").alias("scene_id"), F.col("event_type").alias("band"), "n_events", "n_merged")


@query(f"WITH {PER_BAND} SELECT * FROM lg")
def scene_band_events(t: Tables):
    return _long(t)


@query(f"""WITH {PER_BAND} SELECT scene_id, {', '.join(f"max(n_events) FILTER (WHERE band = '{b}') AS n_{b}" for b in BAND_NAMES)},
max(n_events) FILTER (WHERE band = 'click') + max(n_events) FILTER (WHERE band = 'error') AS total_detection_events FROM lg GROUP BY 1""")
def scene_wide_table(t: Tables):
    return reports.wide_table(_long(t), BAND_NAMES, ("click", "error"))


@query(f"""WITH {PER_BAND} SELECT band, CAST(sum(n_events) AS BIGINT) AS n_events, count(n_events) AS n_events_windows, CAST(sum(n_merged) AS BIGINT) AS n_merged, count(n_merged) AS n_merged_windows FROM lg GROUP BY 1""")
def band_event_totals(t: Tables):
    return reports.band_totals(_long(t), ["n_events", "n_merged"])


_K3 = "user_id, event_type, kind"
TABLE = f"""{SERIES}, sr AS (SELECT * FROM se WHERE NOT (event_type = 'error' AND user_id % 5 = 0)), wi AS (SELECT user_id, floor(min(t)) + 500000 AS lo, floor(min(t)) + 1500000 AS hi FROM se GROUP BY 1),
ne AS (SELECT sr.*, lo, hi FROM sr JOIN wi USING (user_id)), re AS (SELECT * FROM ne WHERE t BETWEEN lo AND hi),
s1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM re),
s2 AS (SELECT user_id, event_type, level AS drawn, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('7|' || event_id), event_id) AS rn FROM re),
al AS (SELECT user_id, event_type, 'real' AS kind, ts, event_id, t, level FROM re UNION ALL SELECT user_id, event_type, 'shuffled', ts, event_id, t, drawn FROM s1 JOIN s2 USING (user_id, event_type, rn)
  UNION ALL SELECT user_id, event_type, 'shifted', ts, event_id, t, level FROM ne WHERE t BETWEEN lo + 700000 AND hi + 700000),
bl AS (SELECT {_K3}, quantile_cont(level, 0.1) AS baseline, count(*) AS frames FROM al GROUP BY ALL),
nu AS (SELECT al.*, level - baseline AS excess, row_number() OVER (PARTITION BY {_K3} ORDER BY ts, event_id) - 1 AS rn FROM al JOIN bl USING ({_K3})),
{_events_sql('nu', _K3, 'ev')}, {_merge_sql('ev', _K3, 'me', '86400')},
cn AS (SELECT {_K3}, count(*) AS n, max(peak_excess) AS top, sum(duration_s) AS long FROM ev GROUP BY ALL), cm AS (SELECT {_K3}, count(*) AS m FROM me GROUP BY ALL),
oe AS (SELECT bl.*, coalesce(n, 0) AS n, coalesce(m, 0) AS m, top, coalesce(long, 0) AS long FROM bl LEFT JOIN cn USING ({_K3}) LEFT JOIN cm USING ({_K3})),
pv AS (SELECT user_id, event_type, {', '.join(f"max({c}) FILTER (WHERE kind = '{k}') AS {n}" for k, c, n in (('real', 'frames', 'n_frames'), ('real', 'n', 'n_events'), ('real', 'm', 'n_events_merged'), ('shuffled', 'n', 'n_events_shuffled'), ('shuffled', 'm', 'n_events_shuffled_merged'), ('shifted', 'n', 'xn'), ('shifted', 'm', 'xm'), ('real', 'baseline', 'baseline'), ('real', 'top', 'peak_excess'), ('real', 'long', 'duration_s')))} FROM oe GROUP BY 1, 2),
ou AS (SELECT user_id, event_type, count(*) FILTER (WHERE NOT t BETWEEN lo AND hi) AS n_outside FROM ne GROUP BY 1, 2)
SELECT u.user_id AS scene_id, b.band, coalesce(n_frames, 0) AS n_frames, n_events, n_events_merged, n_events_shuffled, n_events_shuffled_merged, CASE WHEN n_frames > 0 THEN xn END AS n_events_shifted,
CASE WHEN n_frames > 0 THEN xm END AS n_events_shifted_merged, baseline, peak_excess, duration_s, coalesce(n_outside, 0) AS n_outside,
concat_ws(' ; ', CASE WHEN n_frames IS NULL THEN 'not recorded' END, CASE WHEN n_frames > 0 AND xn IS NULL THEN 'shift not evaluated' END, CASE WHEN n_frames > 0 AND n_outside > 0 THEN 'clipped' END) AS note
FROM wi u JOIN (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error')) b(band) ON true LEFT JOIN pv ON pv.user_id = u.user_id AND pv.event_type = b.band LEFT JOIN ou ON ou.user_id = u.user_id AND ou.event_type = b.band"""


@query(f"WITH {TABLE}", floats=["baseline", "peak_excess", "duration_s"])
def events_table(t: Tables):
    """Scenes x bands with the counts in the window, with shuffled levels and at a shifted time."""
    s = cut(t.series().withColumnsRenamed({"user_id": "scene_id", "event_type": "band"}), "levels")
    w = s.groupBy("scene_id").agg((F.floor(F.min("t")) + 500_000).cast("double").alias("lo"), (F.floor(F.min("t")) + 1_500_000).cast("double").alias("hi"))
    rows = s.where("NOT (band = 'error' AND scene_id % 5 = 0)")
    return reports.events_table(w, rows, BAND_NAMES, 700_000.0, 86_400.0, "event_id", ORDER, seed=7, threshold=THRESHOLD, frame_s=FRAME_S, shortest=SHORTEST)


@query(f"""WITH {PER_BAND}, w AS (SELECT lg.scene_id, n_events > 2 AS f, lg.scene_id % 2 = 0 AS p, band FROM lg WHERE n_events IS NOT NULL)
SELECT band, count(*) FILTER (WHERE f AND p) AS fired_present, count(*) FILTER (WHERE f AND NOT p) AS fired_absent, count(*) FILTER (WHERE NOT f AND p) AS silent_present,
count(*) FILTER (WHERE NOT f AND NOT p) AS silent_absent FROM w GROUP BY 1""")
def fired_versus_present(t: Tables):
    rows = _long(t).where("n_events IS NOT NULL")
    return reports.contingency(rows, F.col("n_events") > 2, F.col("scene_id") % 2 == 0, ["band"])


@query(f"""WITH {EVENTS}, w AS (SELECT user_id AS scene_id, min(ts) AS acquired_utc, CASE WHEN user_id % 7 = 0 THEN 'none' ELSE 'full' END AS coverage FROM events GROUP BY 1, 3),
e AS (SELECT ev.*, baseline FROM ev JOIN bl ON bl.user_id = ev.user_id WHERE ev.user_id % 3 <> 0)
SELECT w.scene_id, acquired_utc, coverage, 'craft' AS band, make_timestamp(CAST(round(t_peak * 1e6) AS BIGINT)) AS event_peak_utc, (t_peak - epoch_us(acquired_utc) / 1e6) / 60 AS minutes_from_acquisition, duration_s, peak_excess, baseline, '' AS reviewer_notes
FROM e JOIN w ON w.scene_id = e.user_id UNION ALL SELECT scene_id, acquired_utc, coverage, 'both', NULL, NULL, NULL, NULL, NULL, CASE WHEN coverage = 'none' THEN 'NO ACOUSTIC DATA' ELSE 'DETECTOR SILENT' END FROM w
WHERE scene_id NOT IN (SELECT user_id FROM e)""", floats=["minutes_from_acquisition", "duration_s", "peak_excess", "baseline"], digits=3)
def review_table(t: Tables):
    s = cut(t.series(), "levels")
    w = s.groupBy(F.col("user_id").alias("scene_id")).agg(F.min("at").alias("acquired_utc")).withColumn(
        "coverage", F.when(F.col("scene_id") % 7 == 0, "none").otherwise("full"))
    base = sp.baselines(s, KEY)
    e = _events(t, s).where("user_id % 3 <> 0").join(base, "user_id").withColumnRenamed("user_id", "scene_id").withColumn("band", F.lit("craft"))
    return reports.review_rows(e.withColumn("t_peak", F.round("t_peak", 6)), w)


@query(f"""WITH {SERIES} SELECT user_id, count(*) FILTER (WHERE t >= 1704672000 AND t <= 1705276800) AS n_kept, count(*) FILTER (WHERE NOT (t >= 1704672000 AND t <= 1705276800)) AS n_dropped FROM se GROUP BY 1""")
def clipped_frames(t: Tables):
    """Rows inside a window with both ends included, and how many were dropped."""
    inside = F.col("t").between(1_704_672_000, 1_705_276_800)
    return t.series().groupBy("user_id").agg(F.count_if(inside).alias("n_kept"), F.count_if(~inside).alias("n_dropped"))


ELEVATED = f"""{LEVELS}, cl AS (SELECT *, frame * 0.25 AS t FROM lv WHERE frame * 0.25 BETWEEN 2.5 AND 100000), bs AS (SELECT win, band, quantile_cont(level, 0.1) AS baseline FROM cl GROUP BY 1, 2),
nu AS (SELECT cl.win, cl.band, t, level - baseline AS excess, row_number() OVER (PARTITION BY cl.win, cl.band ORDER BY frame) - 1 AS rn FROM cl JOIN bs ON bs.win = cl.win AND bs.band = cl.band),
{_events_sql('nu', 'win, band', 'ev', hot='excess >= 4', frame=0.25)}, {_merge_sql('ev', 'win, band', 'me', '10')}"""


@query(f"""WITH {ELEVATED} SELECT band, count(DISTINCT win) AS n_windows, CAST(sum(n_fragments) AS BIGINT) AS n_events, count(*) AS n_merged, max(peak_excess) AS peak_excess, sum(duration_s) AS duration_s FROM me GROUP BY 1""",
       floats=["peak_excess", "duration_s"])
def elevated_periods_per_band(t: Tables):
    """The end-to-end question: frames to band levels, clipped, baselined, runs, merged, totals per band."""
    lv = sp.band_levels(t.frames(), BANDS, ["win", "frame"], N).withColumn("t", F.col("frame") * 0.25)
    lv = cut(lv.where(F.col("t").between(2.5, 100_000)).select("win", "band", "frame", "t", "level"), "levels")
    k = ["win", "band"]
    e = ev.ordered_events(lv, k, ["frame"], "t", threshold=4.0, frame_s=0.25, shortest=2)
    m = ev.merge_events(e, k, 10.0)
    per = m.groupBy(*k).agg(F.sum("n_fragments").alias("n_events"), F.count("*").alias("n_merged"), F.max("peak_excess").alias("peak_excess"), F.sum("duration_s").alias("duration_s"))
    return per.groupBy("band").agg(F.count("*").alias("n_windows"), F.sum("n_events").alias("n_events"), F.sum("n_merged").alias("n_merged"),
                                   F.max("peak_excess").alias("peak_excess"), F.sum("duration_s").alias("duration_s"))


_STAMP = "printf('2023%02d%02d_%02d%02d', 1 + c_nationkey % 12, 1 + c_custkey % 28, 18 + c_custkey % 3, c_custkey % 20)"


@query(f"""WITH s AS (SELECT '  ' || {_STAMP} || '_' || c_custkey || '_1008 ' AS scene_id, c_custkey AS k FROM customer) SELECT substr(trim(scene_id), 1, 13) AS prefix, arg_min(scene_id, (k, scene_id)) AS scene_id, min(k) AS k FROM s GROUP BY 1""")
def first_scene_per_prefix(t: Tables):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    stamp = F.format_string("2023%02d%02d_%02d%02d", 1 + n % 12, 1 + k % 28, 18 + k % 3, k % 20)
    s = t.raw("customer").select(F.concat(F.lit("  "), stamp, F.lit("_"), k, F.lit("_1008 ")).alias("scene_id"), k.alias("k"))
    return es.first_per_prefix(s, "scene_id", "k")
