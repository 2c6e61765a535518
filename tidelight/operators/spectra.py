"""Frames of integer levels: bands, baselines, per-bin statistics and population tables.

A frame row holds ``levels`` (array of small integers, one per bin) plus its window columns.
Levels are quantised integers, so the value tables behind ``percentile`` stay as small as the
level range, however many rows a group has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions.maths import array_median, line_fit, safe_corr
from tidelight.operators.guards import DataError


# ---- bands -----------------------------------------------------------------------------------

def check_band(lo_hz: float, hi_hz: float, lowest: float = fixed.LOWEST_HZ, highest: float = fixed.HIGHEST_HZ) -> None:
    """Ascending and inside what the product represents; never clipped."""
    if not lo_hz < hi_hz:
        raise DataError(f"band edges must ascend: {lo_hz}, {hi_hz}")
    if lo_hz < lowest or hi_hz > highest:
        raise DataError(f"band {lo_hz}-{hi_hz} Hz leaves {lowest}-{highest} Hz")


def check_calibrated(lo_hz: float, hi_hz: float, width: float = fixed.BIN_WIDTH_HZ) -> None:
    lo, hi = (b * width for b in fixed.CALIBRATED_BINS)
    check_band(lo_hz, hi_hz, lo, hi)


def band_bins(lo_hz: float, hi_hz: float, n_bins: int = fixed.N_BINS, width: float = fixed.BIN_WIDTH_HZ,
              slack_hz: float = fixed.AXIS_SLACK_HZ, half_open: bool = False) -> tuple[int, int]:
    """First and last bin of a band. Default: both ends included, widened by the axis slack."""
    if hi_hz > n_bins * width:
        raise DataError(f"{hi_hz} Hz is above the Nyquist frequency {n_bins * width} Hz")
    eps = fixed.EDGE_EPS_HZ + slack_hz
    inside = [
        k for k in range(n_bins)
        if (lo_hz <= k * width < hi_hz if half_open else lo_hz - eps <= k * width <= hi_hz + eps)
    ]
    if not inside:
        raise DataError(f"no bins between {lo_hz} and {hi_hz} Hz")
    return inside[0], inside[-1]


def common_support(lo1, hi1, lo2, hi2, fs: float, min_width_hz: float) -> tuple[float, float]:
    """Intersection of two usable ranges below the lower Nyquist frequency."""
    lo, hi = max(lo1, lo2), min(hi1, hi2, fs / 2)
    if hi - lo < min_width_hz:
        raise DataError(f"common support {lo}-{hi} Hz is narrower than {min_width_hz} Hz")
    return lo, hi


def common_support_columns(lo: Sequence[Column], hi: Sequence[Column], fs: Sequence[Column], min_width_hz: float) -> Column:
    """The same rule for a table of corpus pairs; too narrow pairs carry NULL edges and a reason."""
    low, high = F.greatest(*lo), F.least(*hi, *[f / 2 for f in fs])
    wide = high - low >= min_width_hz
    return F.struct(F.when(wide, low).alias("lo_hz"), F.when(wide, high).alias("hi_hz"),
                    F.when(~wide, F.lit("too_narrow")).alias("reason"))


def comparability(lo1: Column, hi1: Column, lo2: Column, hi2: Column, state1: Column, state2: Column,
                  kind: Column, common_lo: Column, common_hi: Column) -> Column:
    """Verdict for comparing two feature sets: bands must equal the common band, absolute levels need calibration."""
    tol = 1e-6
    off = lambda a, b: F.abs(a - b) > tol
    return (
        F.when(state1.isNull() | state2.isNull(), F.lit("undeclared_state"))
        .when(off(lo1, common_lo) | off(hi1, common_hi) | off(lo2, common_lo) | off(hi2, common_hi), "band_mismatch")
        .when((kind == "absolute_level") & ~((state1 == "calibrated") & (state2 == "calibrated")), "not_calibrated")
        .otherwise("comparable")
    )


def decidecade_resolved(centre_hz: Column) -> Column:
    return centre_hz > fixed.DECIDECADE_MIN_CENTRE_HZ


def with_bands(df: DataFrame, bands: dict[str, tuple]) -> DataFrame:
    """One row per input row and band; the bands are constants, so nothing is joined."""
    rows = [F.struct(F.lit(n).alias("band"), F.lit(float(b[0])).alias("lo_hz"), F.lit(float(b[1])).alias("hi_hz"))
            for n, b in bands.items()]
    return df.withColumn("_b", F.explode(F.array(*rows))).select(*df.columns, "_b.*")


def band_levels(frames: DataFrame, bands: dict[str, tuple], keep: Sequence[str], n_bins: int = fixed.N_BINS,
                slack_hz: float = fixed.AXIS_SLACK_HZ) -> DataFrame:
    """Median level across the bins of each band, with floor counts; one row per frame and band."""
    rows = []
    for name, edges in bands.items():
        a, z = band_bins(edges[0], edges[1], n_bins, slack_hz=slack_hz)
        part = F.slice("levels", a + 1, z - a + 1)
        rows.append(F.struct(
            F.lit(name).alias("band"), array_median(part).alias("level"), F.lit(z - a + 1).alias("n_bins"),
            F.size(F.filter(part, lambda x: x <= fixed.LEVEL_FLOOR)).alias("n_floor")))
    return frames.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def baselines(levels: DataFrame, keys: Sequence[str], value: str = "level", p: float = fixed.AMBIENT_PERCENTILE) -> DataFrame:
    """Ambient baseline of each series."""
    if not 0 < p < 1:
        raise DataError("percentile must lie inside (0, 1)")
    return levels.groupBy(*keys).agg(F.percentile(value, p).alias("baseline"))


def with_excess(levels: DataFrame, keys: Sequence[str], base: DataFrame | None = None, value: str = "level") -> DataFrame:
    """Level above the series' own baseline, or above the one supplied."""
    b = baselines(levels, keys, value) if base is None else base
    return levels.join(b, [*keys]).withColumn("excess", F.col(value) - F.col("baseline"))


def excess_peaks(excess: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Largest excess of each series and when it was first reached."""
    return excess.groupBy(*keys).agg(
        F.min("baseline").alias("baseline"), F.max("excess").alias("peak_excess"),
        F.max_by(at, F.struct(F.col("excess"), -at)).alias("at_peak"))


# ---- per-bin statistics ----------------------------------------------------------------------

def cells(frames: DataFrame, keep: Sequence[str]) -> DataFrame:
    return frames.select(*keep, F.posexplode("levels").alias("bin", "level"))


def counted_cells(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each level occurs per bin: the small table every per-bin statistic reads."""
    return cells(frames, keys).groupBy(*keys, "bin", "level").agg(F.count(F.lit(1)).alias("n"))


def per_bin_percentiles(frames: DataFrame, keys: Sequence[str], percentiles: Sequence[float], value=None) -> DataFrame:
    """Array of percentiles of each bin over time (``value`` maps the level first)."""
    v = F.col("level") if value is None else value(F.col("level"))
    return counted_cells(frames, keys).groupBy(*keys, "bin").agg(
        F.percentile(v, F.array(*[F.lit(p) for p in percentiles]), F.col("n")).alias("values"))


def profiles(per_bin: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """One array per key with the value of every bin in order (as long as the axis)."""
    packed = F.sort_array(F.collect_list(F.struct("bin", value.alias("v"))))
    return per_bin.groupBy(*keys).agg(F.transform(packed, lambda s: s.v).alias(name))


def ambient_profiles(frames: DataFrame, keys: Sequence[str], p: float = fixed.AMBIENT_PERCENTILE, value=None,
                     name: str = "ambient") -> DataFrame:
    return profiles(per_bin_percentiles(frames, keys, [p], value), keys, F.col("values")[0], name)


def ambient_subtracted(frames: DataFrame, keys: Sequence[str], p: float = fixed.AMBIENT_PERCENTILE) -> DataFrame:
    """Replace ``levels`` by ``surplus`` = level minus the bin's ambient; may be negative.

    The ambient is joined as one array per window, so frames are never exploded.
    """
    out = frames.join(ambient_profiles(frames, keys, p), [*keys])
    return out.withColumn("surplus", F.zip_with("levels", "ambient", lambda x, a: x - a))


def robust_scores(frames: DataFrame, keys: Sequence[str], p: float = fixed.AMBIENT_PERCENTILE) -> DataFrame:
    """``scores`` = surplus / (1.4826 MAD) per bin; NULL where the bin never moves, with ``n_unusable``."""
    counts = counted_cells(frames, keys)
    mid = counts.groupBy(*keys, "bin").agg(F.percentile("level", F.lit(0.5), F.col("n")).alias("med"),
                                          F.percentile("level", F.lit(p), F.col("n")).alias("amb"))
    dev = counts.join(mid, [*keys, "bin"]).groupBy(*keys, "bin").agg(
        F.percentile(F.abs(F.col("level") - F.col("med")), F.lit(0.5), F.col("n")).alias("mad"), F.min("amb").alias("amb"))
    packed = F.sort_array(F.collect_list(F.struct("bin", "amb", "mad")))
    prof = dev.groupBy(*keys).agg(packed.alias("_p"), F.count_if(F.col("mad") == 0).alias("n_unusable"))
    score = lambda x, s: F.when(s.mad > 0, (x - s.amb) / (F.lit(fixed.MAD_TO_SIGMA) * s.mad))
    return frames.join(prof, [*keys]).withColumn("scores", F.zip_with("levels", "_p", score)).drop("_p")


def spectral_centroid(frames: DataFrame, keys: Sequence[str], band: tuple[float, float], n_bins: int = fixed.N_BINS,
                      p: float = fixed.AMBIENT_PERCENTILE) -> DataFrame:
    """Centre frequency of the power above each bin's ambient power; NULL when there is none."""
    a, z = band_bins(*band, n_bins)
    power = lambda x: F.pow(F.lit(10.0), x / 10.0)
    amb = ambient_profiles(frames, keys, p, power)
    out = frames.join(amb, [*keys])
    part = F.zip_with(F.slice("levels", a + 1, z - a + 1), F.slice("ambient", a + 1, z - a + 1),
                      lambda x, q: F.greatest(power(x) - q, F.lit(0.0)))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    weighted = F.transform(part, lambda v, i: v * (i + a) * fixed.BIN_WIDTH_HZ)
    return out.withColumn("centroid_hz", F.when(total(part) > 0, total(weighted) / total(part))).drop("ambient")


def whitened_levels(frames: DataFrame, keys: Sequence[str], keep: Sequence[str], bands: Sequence[tuple[float, float]],
                    n_bins: int = fixed.N_BINS) -> DataFrame:
    """Bins minus their own window median, averaged over each half-open band; one row per frame and band."""
    out = frames.join(ambient_profiles(frames, keys, 0.5, name="mid"), [*keys])
    rows = []
    for i, (lo, hi) in enumerate(bands):
        a, z = band_bins(lo, hi, n_bins, half_open=True)
        n = z - a + 1
        part = F.zip_with(F.slice("levels", a + 1, n), F.slice("mid", a + 1, n), lambda x, m: x - m)
        rows.append(F.struct(F.lit(i).alias("band"), (F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / n).alias("level")))
    return out.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


# ---- reports ---------------------------------------------------------------------------------

def _count(part: Column, test) -> Column:
    return F.sum(F.size(F.filter(part, test))).cast("bigint")


def censoring(frames: DataFrame, keys: Sequence[str], ceiling: int = fixed.LEVEL_CEILING) -> DataFrame:
    lv = F.col("levels")
    out = frames.groupBy(*keys).agg(
        F.sum(F.size(lv)).cast("bigint").alias("n_cells"), _count(lv, lambda x: x <= fixed.LEVEL_FLOOR).alias("n_at_floor"),
        _count(lv, lambda x: x >= ceiling).alias("n_at_ceiling"))
    return out.withColumn("fraction_at_floor", F.try_divide("n_at_floor", "n_cells")).withColumn(
        "fraction_at_ceiling", F.try_divide("n_at_ceiling", "n_cells"))


def structural_zeros(frames: DataFrame, keys: Sequence[str], dc: int = fixed.DC_BIN,
                     tail: tuple[int, int] = fixed.ROLLOFF_TAIL_BINS, hard: tuple[int, int] = fixed.HARD_ZERO_BINS) -> DataFrame:
    """Non-zero counts, totals and maxima of the three regions that should hold (almost) nothing."""
    def region(a: int, z: int, name: str) -> list[Column]:
        part = F.slice("levels", a + 1, z - a + 1)
        return [_count(part, lambda x: x != 0).alias(f"{name}_nonzero"), F.sum(F.size(part)).cast("bigint").alias(f"{name}_total"),
                F.max(F.array_max(part)).alias(f"{name}_max")]
    return frames.groupBy(*keys).agg(*region(dc, dc, "dc"), *region(*tail, "tail"), *region(*hard, "hard"))


def rolloff_profile(frames: DataFrame, keys: Sequence[str], bins: tuple[int, int]) -> DataFrame:
    return counted_cells(frames, keys).where(F.col("bin").between(*bins)).groupBy(*keys, "bin").agg(
        (F.sum(F.col("level") * F.col("n")) / F.sum("n")).alias("mean_level"))


def hump_centroid(frames: DataFrame, keys: Sequence[str], low: tuple[int, int] = fixed.HUMP_LOW_BINS,
                  high: tuple[int, int] = fixed.HUMP_HIGH_BINS, span: tuple[int, int] = fixed.HUMP_EXCESS_BINS,
                  fail: bool = True) -> DataFrame:
    """Centroid bin of mean power above a straight line between two quiet neighbourhoods (half-open bins)."""
    inside = lambda r: (F.col("bin") >= r[0]) & (F.col("bin") < r[1])
    pw = counted_cells(frames, keys).groupBy(*keys, "bin").agg(
        (F.sum(F.pow(F.lit(10.0), F.col("level") / 10.0) * F.col("n")) / F.sum("n")).alias("power"))
    packed = F.collect_list(F.when(inside(span), F.struct(F.col("bin").cast("double").alias("bin"), "power")))
    per = pw.groupBy(*keys).agg(F.median(F.when(inside(low), F.col("power"))).alias("lo"),
                                F.median(F.when(inside(high), F.col("power"))).alias("hi"), F.sort_array(packed).alias("_p"))
    x_lo, x_hi = (low[0] + low[1] - 1) / 2, (high[0] + high[1] - 1) / 2
    over = F.transform("_p", lambda s: F.struct(s.bin.alias("bin"), F.greatest(
        s.power - (F.col("lo") + (F.col("hi") - F.col("lo")) * (s.bin - x_lo) / (x_hi - x_lo)), F.lit(0.0)).alias("w")))
    total = F.aggregate(over, F.lit(0.0), lambda s, v: s + v.w)
    moment = F.aggregate(over, F.lit(0.0), lambda s, v: s + v.w * v.bin)
    none = F.raise_error(F.lit("no power above the background")).cast("double") if fail else F.lit(None).cast("double")
    return per.select(*keys, F.when(total > 0, moment / total).otherwise(none).alias("centroid_bin"))


def most_varied_bin(frames: DataFrame, keys: Sequence[str], bins: tuple[int, int] = fixed.HUMP_STD_BINS) -> DataFrame:
    """Bin with the largest spread over time (first one on ties) in a half-open bin range."""
    c = counted_cells(frames, keys).where((F.col("bin") >= bins[0]) & (F.col("bin") < bins[1]))
    s, q, n = F.sum(F.col("level") * F.col("n")), F.sum(F.col("level") * F.col("level") * F.col("n")), F.sum("n")
    # Integer sums: n * sum of squares - square of the sum orders bins exactly.
    var = c.groupBy(*keys, "bin").agg(((n * q - s * s) / (n * n)).alias("var"))
    return var.groupBy(*keys).agg(F.max_by("bin", F.struct("var", -F.col("bin"))).alias("bin"),
                                  F.sqrt(F.max("var")).alias("std_level"))


def tone_check(frames: DataFrame, keys: Sequence[str], frame: str, claims: DataFrame, tol_bin: int, tol_frame: int,
               tol_level: float) -> DataFrame:
    """Loudest cell of each window (first frame, then first bin on ties) against the claimed tone, listing every miss."""
    top = F.struct(F.array_max("levels").alias("level"), (-F.col(frame)).alias("nf"),
                   (1 - F.array_position("levels", F.array_max("levels"))).alias("nb"))
    got = frames.groupBy(*keys).agg(F.max(top).alias("_t")).select(
        *keys, F.col("_t.level").alias("level"), (-F.col("_t.nf")).alias("frame"), (-F.col("_t.nb")).alias("bin"))
    j = got.join(claims, [*keys])
    misses = F.array_compact(F.array(
        F.when(F.abs(F.col("bin") - F.col("claimed_bin")) > tol_bin, F.lit("frequency")),
        F.when(F.abs(F.col("frame") - F.col("claimed_frame")) > tol_frame, F.lit("time")),
        F.when(F.abs(F.col("level") - F.col("claimed_level")) > tol_level, F.lit("level"))))
    return j.withColumn("misses", F.array_join(misses, ","))


# ---- population ------------------------------------------------------------------------------

def histogram(frames: DataFrame, keys: Sequence[str], axis_max: int = fixed.LEVEL_AXIS_MAX) -> DataFrame:
    """Exact counts per (keys, bin, level) with levels held to the axis; ``n_over`` counts what lay beyond."""
    c = cells(frames, keys)
    held = F.least(F.greatest(F.col("level"), F.lit(0)), F.lit(axis_max - 1))
    return c.groupBy(*keys, "bin", held.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") >= axis_max).alias("n_over"))


def pooled_histogram(hist: DataFrame, season: str) -> DataFrame:
    """Per-season and pooled histogram (season NULL) with the density inside each bin.

    The pooled rows are sums of the season rows, so the cells are read once.
    """
    grouped = hist.groupingSets([[season, "bin", "level"], ["bin", "level"]], season, "bin", "level").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(season, "bin")
    return grouped.withColumn("density", F.col("n") / F.sum("n").over(w))


def histogram_percentiles(hist: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Smallest level whose running count reaches q x total, per key and bin (a bin has at most the axis' levels)."""
    by = [*keys, "bin"]
    w = Window.partitionBy(*by).orderBy("level")
    cum = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("cum") >= F.lit(q) * F.col("total"), F.col("level"))).alias(f"p{round(q * 100)}") for q in qs]
    return cum.where("total > 0").groupBy(*by).agg(*picks)


def median_spectra(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_bin_percentiles(frames, keys, [0.5]).select(*keys, "bin", F.col("values")[0].alias("level"))


def window_band_stats(frames: DataFrame, keys: Sequence[str], bands: dict[str, tuple], n_bins: int = fixed.N_BINS,
                      slack_hz: float = fixed.AXIS_SLACK_HZ) -> DataFrame:
    """Per window and band: median of all cells; 10th percentile and maximum of the per-frame medians."""
    per_frame = band_levels(frames, bands, keys, n_bins, slack_hz).groupBy(*keys, "band").agg(
        F.percentile("level", fixed.AMBIENT_PERCENTILE).alias("band_p10"), F.max("level").alias("band_max"))
    conds = [F.struct(F.lit(n).alias("band"), F.lit(band_bins(b[0], b[1], n_bins, slack_hz=slack_hz)[0]).alias("a"),
                      F.lit(band_bins(b[0], b[1], n_bins, slack_hz=slack_hz)[1]).alias("z")) for n, b in bands.items()]
    tagged = counted_cells(frames, keys).withColumn("_b", F.explode(F.filter(
        F.array(*conds), lambda s: (s.a <= F.col("bin")) & (F.col("bin") <= s.z))))
    pooled = tagged.groupBy(*keys, F.col("_b.band").alias("band")).agg(
        F.percentile("level", F.lit(0.5), F.col("n")).alias("band_median"))
    return pooled.join(per_frame, [*keys, "band"])


def window_quality(frames: DataFrame, keys: Sequence[str], ceiling_bin: int = fixed.RELATIVE_CEILING_BIN,
                   dead_from: int = fixed.HARD_ZERO_BINS[0]) -> DataFrame:
    at_floor = lambda x: x <= fixed.LEVEL_FLOOR
    lv, inband = F.col("levels"), F.slice("levels", 2, ceiling_bin)
    dead = F.slice("levels", F.lit(dead_from + 1), F.greatest(F.lit(0), F.size("levels") - dead_from))
    share = lambda part: F.try_divide(_count(part, at_floor), F.sum(F.size(part)))
    return frames.groupBy(*keys).agg(
        F.max(F.array_max(lv)).alias("max_level"), share(lv).alias("floor_all"), share(inband).alias("floor_inband"),
        share(dead).alias("floor_dead"), F.max(lv[0]).alias("bin0_max"), F.avg((lv[0] != 0).cast("int")).alias("dc_nonzero"))


def violation_rate(quality: DataFrame, keys: Sequence[str], max_level: float = fixed.DC_MAX_LEVEL,
                   max_fraction: float = fixed.DC_MAX_NONZERO_FRACTION) -> DataFrame:
    bad = (F.col("bin0_max") > max_level) | (F.col("dc_nonzero") > max_fraction)
    return quality.groupBy(*keys).agg(F.avg(bad.cast("int")).alias("violation_rate"), F.count(F.lit(1)).alias("n_windows"))


def hump_excess(frames: DataFrame, keys: Sequence[str], hump: tuple[int, int], low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Mean hump level above the mean of its two neighbourhoods (inclusive bins), per window."""
    c = counted_cells(frames, keys)
    mean = lambda r: (F.sum(F.when(F.col("bin").between(*r), F.col("level") * F.col("n")))
                      / F.sum(F.when(F.col("bin").between(*r), F.col("n"))))
    return c.groupBy(*keys).agg((mean(hump) - 0.5 * (mean(low) + mean(high))).alias("hump_excess"))


def hump_by_season(excess: DataFrame, season: str, absent: float = fixed.HUMP_ABSENT) -> DataFrame:
    from tidelight.operators.ordered import quantiles

    med = quantiles(excess, [season], "hump_excess", {"median_excess": 0.5})
    share = excess.groupBy(season).agg(F.avg((F.col("hump_excess") < absent).cast("int")).alias("share_absent"),
                                       F.count(F.lit(1)).alias("n_windows"))
    return med.join(share, season)


def season_medians(stats: DataFrame, season: str, value: str) -> DataFrame:
    return stats.groupBy(season, "band").agg(F.percentile(value, 0.5).alias("median_level"), F.count(F.lit(1)).alias("n_windows"))


def season_spread(medians: DataFrame) -> DataFrame:
    return medians.groupBy("band").agg((F.max("median_level") - F.min("median_level")).alias("spread"))


# ---- seasonal ambient ------------------------------------------------------------------------

def seasonal_ambient(hist: DataFrame, season: str, q: float = fixed.AMBIENT_PERCENTILE) -> DataFrame:
    return histogram_percentiles(hist, [season], [q]).withColumnRenamed(f"p{round(q * 100)}", "ambient")


def ambient_on_axis(ambient: DataFrame, season: str, n_bins: int = fixed.N_BINS) -> DataFrame:
    """Ambient of every season on the whole axis; NULL in bins the table does not cover."""
    axis = ambient.select(season).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return axis.join(ambient, [season, "bin"], "left")


def require_seasons(windows: DataFrame, ambient: DataFrame, season: str) -> DataFrame:
    """Fail when a window's season has no ambient; a neighbouring season is never used instead."""
    lost = windows.select(season).distinct().join(ambient.select(season).distinct(), season, "left_anti")
    names = [str(r[0]) for r in lost.limit(20).collect()]
    if names:
        raise DataError(f"no ambient for seasons {names}")
    return windows


def band_baseline(ambient: DataFrame, keys: Sequence[str], bands: dict[str, tuple], n_bins: int = fixed.N_BINS,
                  slack_hz: float = fixed.AXIS_SLACK_HZ, fail: bool = True) -> DataFrame:
    """Median ambient of each band's bins; a NULL bin inside a band is refused."""
    rows = [F.struct(F.lit(n).alias("band"), F.sequence(*[F.lit(x) for x in band_bins(b[0], b[1], n_bins, slack_hz=slack_hz)]).alias("bins"))
            for n, b in bands.items()]
    tagged = ambient.withColumn("_b", F.explode(F.filter(F.array(*rows), lambda s: F.array_contains(s.bins, F.col("bin")))))
    out = tagged.groupBy(*keys, F.col("_b.band").alias("band")).agg(
        F.percentile("ambient", 0.5).alias("baseline"), F.count_if(F.col("ambient").isNull()).alias("n_null"))
    good = F.when(F.col("n_null") == 0, F.col("baseline"))
    return out.withColumn("baseline", good.otherwise(F.raise_error(F.lit("NULL ambient inside a band")).cast("double")) if fail else good)


def attach_season_ambient(windows: DataFrame, profiles_: DataFrame, season: str) -> DataFrame:
    """Left join by the window's own season, with a note instead of a substitute when it is missing."""
    out = windows.join(profiles_, season, "left")
    return out.withColumn("note", F.when(F.col("ambient").isNull(), F.lit("no ambient for this season")))


def floor_shift(own: DataFrame, ambient: DataFrame, keys: Sequence[str], season: str, band: tuple[int, int]) -> DataFrame:
    """Median of own floor minus season floor, inside a bin range and over the whole axis."""
    d = own.join(ambient, [season, "bin"]).withColumn("d", F.col("own") - F.col("ambient"))
    return d.groupBy(*keys).agg(F.percentile(F.when(F.col("bin").between(*band), F.col("d")), 0.5).alias("shift_band"),
                                F.percentile("d", 0.5).alias("shift_all"))


def whitened_by_season(spectra: DataFrame, ambient: DataFrame, season: str) -> DataFrame:
    return spectra.join(ambient, [season, "bin"]).withColumn("white", F.col("level") - F.col("ambient"))


# ---- relations -------------------------------------------------------------------------------

def level_regression(pairs: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line and correlation of two level columns."""
    slope, intercept = line_fit(F.col(y).cast("double"), F.col(x).cast("double"))
    return pairs.groupBy(*keys).agg(slope.alias("slope"), intercept.alias("intercept"),
                                    safe_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
