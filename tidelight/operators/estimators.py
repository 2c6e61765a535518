"""Passage-count estimators, multi-band counts and how they are scored against manual counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelight import fixed
from tidelight.functions.maths import closeness, cosine, partial_r, safe_corr
from tidelight.operators.events import apart, merge_events, ordered_events, passages, prominent_peaks, smooth_mean, smooth_mean_or_median
from tidelight.operators.greedy import keep_greedily
from tidelight.operators.ordered import BLOCK, RN, Ordered, meet, nearest_rows, number_rows
from tidelight.operators.spectra import baselines
from tidelight.session import cut

Estimator = Callable[[DataFrame], DataFrame]


def _count(rows: DataFrame, keys: Sequence[str], series: DataFrame, name: str) -> DataFrame:
    """Rows per series, 0 for series without any."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return series.join(n, [*keys], "left").select(*keys, F.lit(name).alias("method"), F.coalesce("n", F.lit(0)).alias("n_est"))


def hot_smooth(levels: DataFrame, keys: Sequence[str], order: Sequence[str], frames: int, threshold: float) -> Ordered:
    """Smoothed series with ``hot`` = smoothed level at least ``threshold`` above the raw baseline."""
    o = number_rows(levels, keys, order)
    sm = smooth_mean_or_median(o, "level", frames).join(baselines(levels, keys), [*keys])
    return Ordered(sm.withColumn("hot", F.col("smooth") >= F.col("baseline") + threshold), o.keys, o.block_rows)


def slope_crossings(series: Ordered, at: str, separation: float) -> DataFrame:
    """Rows where the smoothed slope turns from rising to not rising inside a hot stretch, thinned in time.

    The slope is the centred difference, one-sided at the ends.
    """
    size = F.col("_len") - 1
    near = series.centred(1, 2, _a=lambda w: F.lag("smooth").over(w), _b=lambda w: F.lead("smooth").over(w),
                          _c=lambda w: F.lead("smooth", 2).over(w))
    here = F.when(F.col(RN) == 0, F.col("_b") - F.col("smooth")).otherwise((F.col("_b") - F.col("_a")) / 2)
    after = F.when(F.col(RN) == size - 1, F.col("_b") - F.col("smooth")).otherwise((F.col("_c") - F.col("smooth")) / 2)
    hits = near.where((F.col(RN) < size) & (here > 0) & (after <= 0) & F.col("hot"))
    return apart(hits.select(*series.keys, at), series.keys, at, separation, [F.col(at)])


def elevated_edges(series: Ordered) -> DataFrame:
    """First rows of the hot stretches of the smoothed series."""
    o = series.prefix(_was=("last", F.col("hot")))
    return o.rows.where(F.col("hot") & ~F.coalesce("_was", F.lit(False)))


def registry(keys: Sequence[str], order: Sequence[str], at: str, frame_s: float = fixed.FRAME_SECONDS, shortest: int = 80,
             frames: int = 181, distance: int = 720, threshold: float = fixed.EVENT_EXCESS, gaps: tuple[float, float] = (10.0, 120.0),
             separation: float = fixed.SEPARATION_SECONDS) -> dict[str, Estimator]:
    """Named estimators, each from a level table to (keys, method, n_est)."""
    k = [*keys]

    def series(lv):
        return lv.select(*k).distinct()

    def events(lv):
        return ordered_events(lv, k, order, at, threshold=threshold, frame_s=frame_s, shortest=shortest)

    def peaks(share):
        return lambda lv: passages(lv, k, order, at, frames=frames, distance=distance, threshold=threshold,
                                   min_prominence=threshold * share)

    def smooth(lv):
        return hot_smooth(lv, k, order, frames, threshold)

    def elevated(lv):
        return _count(elevated_edges(smooth(lv)), k, series(lv), "elevated_periods")

    def named(name, rows):
        return lambda lv: _count(rows(lv), k, series(lv), name)

    return {
        "raw_events": named("raw_events", lambda lv: events(lv).rows),
        "merged_10s": named("merged_10s", lambda lv: merge_events(events(lv), k, gaps[0])),
        "merged_120s": named("merged_120s", lambda lv: merge_events(events(lv), k, gaps[1])),
        "slope_zero_cross": named("slope_zero_cross", lambda lv: slope_crossings(smooth(lv), at, separation)),
        "peak_prominence": named("peak_prominence", peaks(0.5)),
        "peak_prominence_strict": named("peak_prominence_strict", peaks(1.0)),
        "elevated_periods": elevated,
        "any_elevation": lambda lv: elevated(lv).select(*k, F.lit("any_elevation").alias("method"), F.least("n_est", F.lit(1)).alias("n_est")),
    }


def user_estimator(name: str, keys: Sequence[str], count: Callable[[pd.DataFrame], int]) -> Estimator:
    """Wrap a user's ``pandas frame -> int`` as an estimator; it gets one bounded window at a time."""

    def run(levels: DataFrame) -> DataFrame:
        schema = T.StructType([levels.schema[k] for k in keys] + [T.StructField("method", T.StringType()), T.StructField("n_est", T.LongType())])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            head = pdf.iloc[[0]][[*keys]].copy()
            head["method"], head["n_est"] = name, int(count(pdf))
            return head

        return levels.groupBy(*keys).applyInPandas(one, schema)

    return run


def run_all(levels: DataFrame, methods: dict[str, Estimator]) -> DataFrame:
    out = None
    for f in methods.values():
        got = f(levels)
        out = got if out is None else out.unionByName(got)
    return out


def first_per_prefix(scenes: DataFrame, scene: str, at: str) -> DataFrame:
    """One scene per labelled instant: the earliest of each 13-character prefix."""
    p = scenes.withColumn("prefix", F.substring(F.trim(F.col(scene)), 1, 13))
    best = p.groupBy("prefix").agg(F.min(F.struct(at, scene)).alias("_m"))
    return best.select("prefix", f"_m.{scene}", f"_m.{at}")


def score_estimators(counts: DataFrame, truth: str = "truth", level: str = "window_level") -> DataFrame:
    """Totals, ratio, error, share within one, correlation, and correlation with the window level held fixed."""
    n, t, z = F.col("n_est").cast("double"), F.col(truth).cast("double"), F.col(level).cast("double")
    s = counts.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("n_est").alias("total_est"), F.sum(truth).alias("total_truth"),
        F.avg(F.abs(n - t)).alias("mae"), F.avg((F.abs(n - t) <= 1).cast("int")).alias("within_1"),
        safe_corr(n, t).alias("r"), safe_corr(n, z).alias("_rz"), safe_corr(t, z).alias("_tz"))
    return s.withColumn("ratio", F.try_divide("total_est", "total_truth")).withColumn(
        "partial_r", partial_r(F.col("r"), F.col("_rz"), F.col("_tz"))).drop("_rz", "_tz")


def within_total(scores: DataFrame, tolerance: float = fixed.COUNT_RATIO_TOLERANCE) -> DataFrame:
    return scores.where(F.abs(F.col("ratio") - 1) <= tolerance)


# ---- several bands ---------------------------------------------------------------------------

def cluster_count(peaks: DataFrame, keys: Sequence[str], seconds: float = fixed.CROSS_BAND_SECONDS,
                  same: float = fixed.PROFILE_COSINE) -> DataFrame:
    """Founders of peak clusters: in time order a peak joins a founder that is close in time and alike in profile.

    ``peaks`` has keys, band, t_peak, profile (array of doubles). A peak founds a cluster unless an
    earlier founder takes it, which is a greedy choice in time order.
    """
    p = cut(peaks.select(F.concat_ws("|", F.col("t_peak").cast("decimal(20,6)"), "band").alias("id"), *keys, "t_peak", "band", "profile",
                         F.floor(F.col("t_peak") / seconds).alias("b")), "peaks")
    a = p.select(*keys, F.col("id").alias("ia"), F.struct("t_peak", "band").alias("ra"), F.col("t_peak").alias("ta"),
                 F.col("profile").alias("pa"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    z = p.select(*keys, F.col("id").alias("iz"), F.struct("t_peak", "band").alias("rz"), F.col("t_peak").alias("tz"),
                 F.col("profile").alias("pz"), "b")
    near = a.join(z, [*keys, "b"]).where((F.col("ra") < F.col("rz")) & (F.col("tz") - F.col("ta") <= seconds)
                                         & (cosine(F.col("pa"), F.col("pz")) >= same))
    return keep_greedily(p.drop("b"), keys, "id", near.select(*keys, F.col("ia").alias("winner"), F.col("iz").alias("loser")))


def concurrent_clusters(bands: DataFrame, keys: Sequence[str], band: str, names: Sequence[str], order: Sequence[str], at: str, value: str, frames: int,
                        distance: int, min_prominence: float, seconds: float = fixed.CROSS_BAND_SECONDS, same: float = fixed.PROFILE_COSINE) -> DataFrame:
    """(keys, n_clusters): peaks of all bands, counted once where they coincide in time and have the same profile over the bands.

    ``bands`` are whitened level series, one per key and band. Each is smoothed and its prominent peaks are found; a peak's profile is the smoothed
    level of every band (``names``, in this order) at the frame nearest to it. Series without peaks count 0.
    """
    o = number_rows(bands, [*keys, band], order)
    rows = cut(smooth_mean(o, value, frames).select(*keys, band, RN, BLOCK, F.col(at).cast("double").alias(at), "smooth"), "bands")
    peaks = prominent_peaks(Ordered(rows, o.keys, o.block_rows), "smooth", at, None, min_prominence, distance)
    peaks = peaks.select(*keys, F.col(band).alias("band"), F.col("t_peak").alias(at))
    known = nearest_rows(peaks, rows, keys, at, band, names, "smooth", "profile").withColumn("profile", F.array_compact("profile"))
    founders = cluster_count(known.withColumnRenamed(at, "t_peak"), keys, seconds, same)
    counts = founders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"))
    out = meet(bands.select(*keys).distinct(), counts, keys, "left")
    return out.withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0).cast("bigint")))


def split_count(base: DataFrame, band_series: DataFrame, keys: Sequence[str], place: str, at: str, half: int, rise: float,
                gap_s: float = fixed.CROSS_BAND_SECONDS) -> DataFrame:
    """Passages, counted more than once where the bands peak at different times.

    Around each base peak (keys, mid) every band votes with the time of its maximum if it rises at
    least ``rise`` above its median there; votes further apart than ``gap_s`` are separate sources. A
    series without base peaks counts 0.
    """
    size = 2 * half + 1
    b = base.select(*keys, "mid", F.explode(F.array_distinct(F.array(
        F.floor((F.col("mid") - half) / size), F.floor((F.col("mid") + half) / size)))).alias("_b"))
    s = band_series.withColumn("_b", F.floor(F.col(place) / size))
    near = b.join(s, [*keys, "_b"]).where(F.abs(F.col(place) - F.col("mid")) <= half)
    votes = near.groupBy(*keys, "mid", "band").agg(
        F.count(F.lit(1)).alias("len"), F.max("smooth").alias("top"), F.percentile("smooth", 0.5).alias("med"),
        F.max_by(at, F.struct(F.col("smooth"), -F.col(place))).alias("t"))
    usable = (F.col("len") >= 3) & (F.col("top") - F.col("med") >= rise)
    times = F.sort_array(F.collect_list(F.when(usable, F.col("t"))))  # at most one entry per band
    per = votes.groupBy(*keys, "mid").agg(times.alias("ts"))
    jumps = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ts") - 1)),
                                        lambda i: F.get(F.col("ts"), i) - F.get(F.col("ts"), i - 1)), lambda d: d > gap_s))
    parts = per.select(*keys, (1 + jumps).alias("n"))
    counts = parts.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)), F.sum("n")).alias("n_split"))
    return meet(band_series.select(*keys).distinct(), counts, keys, "left").withColumn("n_split", F.coalesce("n_split", F.lit(0).cast("bigint")))


# ---- configuration sweeps --------------------------------------------------------------------

def score_counts(counts: DataFrame, keys: Sequence[str] = ("config",), pred: str = "pred", true: str = "truth") -> DataFrame:
    p, t = F.col(pred).cast("double"), F.col(true).cast("double")
    err, total = F.sum(F.abs(p - t)), F.greatest(F.sum(t), F.lit(1.0))
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_scenes"), F.sum(pred).alias("pred_total"), F.sum(true).alias("truth_total"),
        (1 - F.abs(F.sum(p) - F.sum(t)) / total).alias("batch_acc"), F.avg(closeness(p, t)).alias("scene_acc"),
        F.avg(F.abs(p - t)).alias("mae"), F.greatest(F.lit(0.0), 1 - err / total).alias("err_acc"),
        F.avg((p == t).cast("int")).alias("exact"), safe_corr(p, t).alias("r"))


def rank_configs(scores: DataFrame, metric: str, n: int) -> DataFrame:
    return scores.orderBy(F.col(metric).desc_nulls_last(), F.col("mae").asc(), F.col("config").asc()).limit(n)


def best_config(scores: DataFrame, by: Sequence[str] = (), metric: str = "err_acc") -> DataFrame:
    """Highest metric, the smallest config id on ties."""
    return scores.groupBy(*by).agg(F.max_by("config", F.struct(F.col(metric), -F.col("config"))).alias("config"),
                                   F.max(metric).alias(metric))


def err_accuracy(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = F.col("truth").cast("double")
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1 - F.sum(F.abs(F.col("pred") - t)) / F.greatest(F.sum(t), F.lit(1e-9))).alias("err_acc"))


PER_ROW = 64  # trials whose scores travel as one array


def _placed(truth: DataFrame, n_trials: int, seed: int) -> DataFrame:
    """trial, place, scene, truth: each scene's place 0..n-1 in every trial, by a reproducible lot; trial -1 has them in order."""
    t = truth.select("scene", "truth").withColumn("trial", F.explode(F.sequence(F.lit(-1), F.lit(n_trials - 1))))
    lot = F.when(F.col("trial") < 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.lit(seed), F.col("trial"), F.col("scene"))))
    return number_rows(t.withColumn("_lot", lot), ["trial"], ["_lot", "scene"]).rows.select("trial", F.col(RN).alias("place"), "scene", "truth")


def _by_trial(value: str) -> Column:
    """Array of a column over the trials, in their order."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("trial") >= 0, F.struct("trial", value)))), lambda x: x[value].cast("double"))


def _predictions(matrix: DataFrame) -> DataFrame:
    """scene, configs, preds: the counts of all settings as one array, in the order of the settings."""
    rows = matrix.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("config", "pred"))).alias("_p"))
    return rows.select("scene", F.col("_p.config").alias("configs"), F.transform("_p", lambda x: x["pred"].cast("double")).alias("preds"))


def _chunks(rows: DataFrame, array: str) -> DataFrame:
    """One row per ``PER_ROW`` trials, numbered ``_chunk``."""
    many = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / PER_ROW).cast("int"))
    return rows.withColumn("_chunk", F.explode(many)).withColumn(array, F.slice(array, F.col("_chunk") * PER_ROW + 1, PER_ROW))


def _totals(rows: DataFrame, **arrays: Column) -> DataFrame:
    """Sums of whole-numbered arrays over the rows of a chunk, element by element, added up inside the tasks first."""
    sums = rows.groupBy("_chunk").agg(F.min("configs").alias("configs"), F.max("configs").alias("_most"), *[Summarizer.sum(array_to_vector(c)).alias(n) for n, c in arrays.items()])
    whole = F.when(F.col("configs") == F.col("_most"), F.col("configs")).otherwise(F.raise_error(F.lit("scenes differ in their settings")).cast(rows.schema["configs"].dataType))
    return sums.select("_chunk", whole.alias("configs"), *[F.transform(vector_to_array(n), lambda x: F.round(x)).alias(n) for n in arrays])


def _share_right(err: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - err / F.greatest(total, F.lit(1e-9)))


def label_shuffle_null(matrix: DataFrame, truth: DataFrame, n_trials: int, seed: int = 0) -> DataFrame:
    """Best score of the whole grid on permuted truth, one row per trial.

    ``matrix`` has (config, scene, pred) of every setting and scene; ``truth`` has (scene, truth). A scene is one row with its counts and its
    permuted truths as arrays; trials times settings are elements of arrays that are summed, never rows.
    """
    moved = _placed(truth, n_trials, seed).groupBy("place").agg(F.max(F.when(F.col("trial") < 0, F.col("scene"))).alias("scene"), _by_trial("truth").alias("truths"))
    rows = _chunks(_predictions(matrix).join(moved, "scene"), "truths")
    errors = F.flatten(F.transform("truths", lambda t: F.transform("preds", lambda p: F.abs(p - t))))
    sums = _totals(rows, errors=errors, total=F.col("truths"))
    c = F.size("configs")
    best = lambda i: F.array_max(F.transform(F.slice("errors", i * c + 1, c), lambda e: _share_right(e, F.get("total", i))))
    trials = sums.select("_chunk", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("total") - 1), best)).alias("i", "err_acc"))
    return trials.select((F.col("_chunk") * PER_ROW + F.col("i")).alias("trial"), "err_acc")


def null_summary(null: DataFrame, real: DataFrame) -> DataFrame:
    """Mean, 95th percentile and maximum of the null, and the share of trials the real score beats."""
    null = null.withColumn("real", real.agg(F.max("err_acc")).scalar())
    return null.agg(F.avg("err_acc").alias("null_mean"), F.percentile("err_acc", 0.95).alias("null_p95"), F.max("err_acc").alias("null_max"),
                    F.avg((F.col("real") > F.col("err_acc")).cast("int")).alias("share_beaten"), F.max("real").alias("real"))


def split_half(matrix: DataFrame, truth: DataFrame, n_trials: int, seed: int = 0) -> DataFrame:
    """Choose the best configuration on a random half, score it on the other; one row per trial.

    As in ``label_shuffle_null`` trials and settings are elements of arrays; what is not in the first half is in the other.
    """
    lots = _placed(truth, n_trials, seed).groupBy("scene").agg(_by_trial("place").alias("places"), F.max("truth").cast("double").alias("truth"))
    lots = lots.withColumn("half", truth.agg(F.floor(F.count(F.lit(1)) / 2)).scalar())
    rows = _chunks(_predictions(matrix).join(lots, "scene"), "places")
    first = lambda x: F.transform("places", lambda p: F.when(p < F.col("half"), x).otherwise(0.0))
    misses = F.transform("preds", lambda p: F.abs(p - F.col("truth")))
    sums = _totals(rows, train=F.flatten(F.transform("places", lambda p: F.transform(misses, lambda e: F.when(p < F.col("half"), e).otherwise(0.0)))),
                   both=misses, train_truth=first(F.col("truth")), truth=F.array("truth"))
    i, c = F.col("i"), F.size("configs")
    per = sums.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("train_truth") - 1))).withColumn("one", F.slice("train", i * c + 1, c))
    t = F.get("train_truth", i)
    scores = F.transform("configs", lambda k, j: F.struct(_share_right(F.get("one", j), t).alias("train_acc"), (-k).alias("_k"), j.alias("j")))
    pick = per.withColumn("best", F.array_max(scores)).withColumn("j", F.col("best.j"))
    test = _share_right(F.get("both", F.col("j")) - F.get("one", F.col("j")), F.get("truth", F.lit(0)) - t)
    out = pick.select((F.col("_chunk") * PER_ROW + i).alias("trial"), (-F.col("best._k")).alias("config"), F.col("best.train_acc").alias("train_acc"), test.alias("test_acc"))
    return out.withColumn("gap", F.col("train_acc") - F.col("test_acc"))


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.agg(F.avg("train_acc").alias("train_mean"), F.avg("test_acc").alias("test_mean"), F.stddev_pop("test_acc").alias("test_sd"),
                      F.percentile("test_acc", 0.05).alias("test_p05"), F.avg("gap").alias("gap_mean"))
