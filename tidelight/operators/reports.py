"""Per-window tables: counts per band, wide tables, contingency, diagnostics, accounting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions import text
from tidelight.operators import events as ev
from tidelight.operators.guards import require_matched
from tidelight.operators.spectra import baselines
from tidelight.session import cut


def label_scenes(scenes: DataFrame, counts: DataFrame, strict: bool = True) -> DataFrame:
    """Manual counts joined to every scene of their 13-character prefix, with the number of scenes sharing a label.

    ``strict`` refuses labels without a scene and scenes without a label.
    """
    s = scenes.withColumn("prefix", F.substring(F.trim("scene_id"), 1, 13))
    c = counts.select(F.col("timestamp").alias("prefix"), "vessel_count")
    if strict:
        require_matched(s, c, ["prefix"])
    shared = s.groupBy("prefix").agg(F.count(F.lit(1)).alias("label_shared_by"))
    return s.join(c, "prefix").join(shared, "prefix").select("scene_id", "prefix", "vessel_count", "label_shared_by")


def with_outcomes(rows: DataFrame, found: DataFrame, keys: Sequence[str], columns: Sequence[str], measured: Column) -> DataFrame:
    """Counts joined to scored rows: 0 where the detector ran and found nothing, NULL where it did not run."""
    out = rows.join(found, [*keys], "left")
    return out.withColumns({c: F.when(measured, F.coalesce(c, F.lit(0))) for c in columns})


def wide_table(long: DataFrame, bands: Sequence[str], detection: Sequence[str], value: str = "n_events") -> DataFrame:
    """One row per scene, one column per band; the total is NULL when any detection band is."""
    cells = [F.max(F.when(F.col("band") == b, F.col(value))).alias(f"n_{b}") for b in bands]
    out = long.groupBy("scene_id").agg(*cells)
    total = F.col(f"n_{detection[0]}")
    for b in detection[1:]:
        total = total + F.col(f"n_{b}")
    return out.withColumn("total_detection_events", total)


def band_totals(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum of each outcome over the windows where it was evaluated, and how many windows that was."""
    return long.groupBy("band").agg(*[e for c in columns for e in (F.sum(c).alias(c), F.count(c).alias(f"{c}_windows"))])


def contingency(rows: DataFrame, fired: Column, present: Column, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count_if(fired & present).alias("fired_present"), F.count_if(fired & ~present).alias("fired_absent"),
        F.count_if(~fired & present).alias("silent_present"), F.count_if(~fired & ~present).alias("silent_absent"))


def diagnostics(bands: DataFrame, keys: Sequence[str], craft: str = "small_craft", rain: str = "rain", control: str = "control",
                deadband: float = fixed.SHAPE_DEADBAND, expected: float = fixed.CONTROL_EXPECTED,
                tolerance: float = fixed.CONTROL_DRIFT) -> DataFrame:
    """Shape and instrument readings of each window from per-band (baseline, peak_excess)."""
    of = lambda b, c: F.max(F.when(F.col("band") == b, F.col(c)))
    w = bands.groupBy(*keys).agg(of(craft, "peak_excess").alias("craft_peak"), of(rain, "peak_excess").alias("rain_peak"),
                                 of(control, "peak_excess").alias("control_peak"), of(control, "baseline").alias("control_baseline"))
    d = F.col("rain_peak") - F.col("craft_peak")
    drift = F.abs(F.col("control_baseline") - expected)
    return w.withColumns({
        "rain_minus_craft": d,
        "shape_reading": F.when(d < -deadband, "vessel-like").when(d > deadband, "rain-like").when(d.isNotNull(), "ambiguous"),
        "control_drift": drift,
        "control_reading": F.when(drift > tolerance, "suspect").when(drift.isNotNull(), "stable"),
        "control_peak_reading": F.when(F.col("control_peak") >= F.col("craft_peak") / 2, "broadband").when(
            F.col("control_peak").isNotNull() & F.col("craft_peak").isNotNull(), "quiet")})


def review_rows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events plus one row for each silent window and one for each window without data.

    ``events`` has scene_id, band, t_peak (s), duration_s, peak_excess, baseline; ``windows`` has
    scene_id, acquired_utc and coverage.
    """
    at = F.timestamp_micros((F.col("t_peak") * 1e6).cast("bigint"))
    minutes = (F.col("t_peak") - F.unix_micros("acquired_utc") / F.lit(1e6)) / 60
    found = events.join(windows, "scene_id").select(
        "scene_id", "acquired_utc", "coverage", "band", at.alias("event_peak_utc"), F.round(minutes, 3).alias("minutes_from_acquisition"),
        F.round("duration_s", 2).alias("duration_s"), F.round("peak_excess", 2).alias("peak_excess"), F.round("baseline", 2).alias("baseline"),
        F.lit("").alias("reviewer_notes"))
    quiet = windows.join(events.select("scene_id").distinct(), "scene_id", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    rest = quiet.select(
        "scene_id", "acquired_utc", "coverage", F.lit("both").alias("band"), none("timestamp").alias("event_peak_utc"),
        none("double").alias("minutes_from_acquisition"), none("double").alias("duration_s"), none("double").alias("peak_excess"),
        none("double").alias("baseline"), F.when(F.col("coverage") == "none", "NO ACOUSTIC DATA").otherwise("DETECTOR SILENT").alias("reviewer_notes"))
    return found.unionByName(rest)


def event_spectrum(frames: DataFrame, keys: Sequence[str], in_event: Column) -> DataFrame:
    """Median level of each bin inside and outside events and their difference."""
    c = frames.select(*keys, in_event.alias("_e"), F.posexplode("levels").alias("bin", "level"))
    m = c.groupBy(*keys, "bin").agg(F.percentile(F.when(F.col("_e"), F.col("level")), 0.5).alias("event_level"),
                                    F.percentile(F.when(~F.col("_e"), F.col("level")), 0.5).alias("quiet_level"))
    return m.withColumn("difference", F.col("event_level") - F.col("quiet_level"))


def accounting(retrievals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requested, present, absent and failed counts. ``status`` is present, absent, error, empty or unknown."""
    s = F.col("status")
    return retrievals.groupBy(*by).agg(
        F.count_if(s.isin("present", "absent")).alias("requested"), F.count_if(s == "present").alias("present"),
        F.count_if(s == "absent").alias("absent"), F.count_if(s == "error").alias("errors"),
        F.count_if(s == "empty").alias("empty_windows"), F.count_if(s == "unknown").alias("unknown"))


def check_accounting(totals: DataFrame) -> DataFrame:
    from tidelight.operators.guards import refuse

    return refuse(totals, {"requested_differs": F.col("requested") != F.col("present") + F.col("absent")})


def autocorrelation(series, value: str, lags: Sequence[int]) -> DataFrame:
    """Correlation of each series with itself shifted by each lag (an ``Ordered`` series)."""
    from tidelight.functions.maths import safe_corr

    cols = {f"_l{k}": (lambda k: lambda w: F.lag(value, k).over(w))(k) for k in lags}
    wide = series.centred(max(lags), 0, **cols)
    per = wide.groupBy(*series.keys).agg(*[
        safe_corr(F.when(F.col(f"_l{k}").isNotNull(), F.col(value)).cast("double"), F.col(f"_l{k}").cast("double")).alias(f"r{k}") for k in lags])
    return per.select(*series.keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags])).alias("_x")).select(
        *series.keys, "_x.lag", "_x.r")


def window_summaries(bands: DataFrame, labels: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Nested summary per window: the label as a struct, band statistics as a map."""
    per = bands.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "band", F.struct("baseline", "peak_excess", "n_events"))))).alias("bands"))
    lab = labels.select(*keys, F.struct(*[c for c in labels.columns if c not in keys]).alias("label"))
    return per.join(lab, [*keys], "left")


def events_table(windows: DataFrame, levels: DataFrame, bands: Sequence[str], shift_s: float, gap_s: float, ident: str, order: Sequence[str],
                 at: str = "t", seed: int = 0, **how) -> DataFrame:
    """One row per scene and band: events, the same with shuffled levels and at a shifted time, and what to know about them.

    ``windows``: scene_id, lo, hi (seconds, both ends inside); ``levels``: scene_id, band, ``at``, ``ident``, level, whatever of a
    scene's recording reaches the window or the shifted one; ``how`` goes to ``find_events``. All three detections run in one pass
    and merge by the same rule. Counts are NULL where there was nothing to detect in, and 0 where nothing was found.
    """
    near = levels.join(windows, "scene_id")
    inside = lambda by: F.col(at).between(F.col("lo") + by, F.col("hi") + by)
    k = ["scene_id", "band"]
    real = near.where(inside(0)).drop("lo", "hi")
    kinds = {"real": real, "shuffled": ev.shuffled(real, k, order, ident, seed=seed), "shifted": near.where(inside(shift_s)).drop("lo", "hi")}
    names = [*k, *order, at, ident, "level"]
    every = None
    for kind, rows in kinds.items():
        rows = rows.select(*dict.fromkeys(names), F.lit(kind).alias("kind"))
        every = rows if every is None else every.unionByName(rows)
    every = cut(every, "levels")
    base = cut(baselines(every, [*k, "kind"]), "baseline")
    found = ev.ordered_events(every, [*k, "kind"], order, at, base, **how)
    found = replace(found, rows=cut(found.rows, "events"))
    merged = ev.merge_events(found, [*k, "kind"], gap_s).groupBy(*k, "kind").agg(F.count(F.lit(1)).alias("m"))
    per = found.rows.groupBy(*k, "kind").agg(F.count(F.lit(1)).alias("n"), F.max("peak_excess").alias("top"), F.sum("duration_s").alias("long"))
    size = every.groupBy(*k, "kind").agg(F.count(F.lit(1)).alias("frames"))
    one = size.join(base, [*k, "kind"]).join(per, [*k, "kind"], "left").join(merged, [*k, "kind"], "left")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    none = F.lit(0).cast("bigint")
    counts = {f"n_events{s}{m}": of(kind, F.coalesce(c, none)) for kind, s in (("real", ""), ("shuffled", "_shuffled"), ("shifted", "_shifted")) for c, m in (("n", ""), ("m", "_merged"))}
    one = one.groupBy(*k).agg(
        F.coalesce(of("real", F.col("frames")), none).alias("n_frames"), *[c.alias(n) for n, c in counts.items()], of("real", F.col("baseline")).alias("baseline"),
        of("real", F.col("top")).alias("peak_excess"), of("real", F.coalesce("long", F.lit(0.0))).alias("duration_s"))
    grid = windows.select("scene_id", F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    outside = near.groupBy(*k).agg(F.count_if(~inside(0)).alias("n_outside"))
    out = grid.join(one, k, "left").join(outside, k, "left")
    out = out.withColumn("n_frames", F.coalesce("n_frames", none)).withColumn("n_outside", F.coalesce("n_outside", none))
    measured = F.col("n_frames") > 0
    out = out.withColumns({n: F.when(measured, F.col(n)) for n in counts})
    note = text.notes(F.when(~measured, "not recorded"), F.when(measured & F.col("n_events_shifted").isNull(), "shift not evaluated"), F.when(measured & (F.col("n_outside") > 0), "clipped"))
    return out.withColumn("note", note)
