"""Events, passages and their null tests on level series.

A series has key columns, a time order that is unique inside the key, and a level. Row order, not
clock time, decides which frames are neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelight import fixed
from tidelight.operators.intervals import chain_groups
from tidelight.operators.ordered import BLOCK, RN, Ordered, meet, number_rows
from tidelight.operators.spectra import baselines
from tidelight.session import cut, release

FAN = 128  # points of a block, and blocks of a block of blocks, in which higher ground is looked for
REACH = 256  # distances of a stretch in which peaks are spaced


def min_frames(seconds: float = fixed.EVENT_MIN_SECONDS, frame_s: float = fixed.FRAME_SECONDS) -> int:
    return max(1, round(seconds / frame_s))


def odd_frames(seconds: float, frame_s: float = fixed.FRAME_SECONDS) -> int:
    n = max(1, round(seconds / frame_s))
    return n if n % 2 else n + 1


# ---- runs ------------------------------------------------------------------------------------

def hot_runs(series: Ordered, hot: Column, at: str, value: str, frame_s: float, shortest: int) -> Ordered:
    """Runs of consecutive hot rows: start, first time of the largest value, duration, row count.

    A run keeps the number and block of its first row, so the runs of a series are in order without being numbered again.
    """
    o = series.with_columns(_hot=F.coalesce(hot, F.lit(False)))
    # inside a run the row number and the count of hot rows grow alike
    o = o.prefix(_before=("sum", F.col("_hot").cast("int"))).with_columns(run=F.col(RN) - F.col("_before"))
    runs = o.rows.where("_hot").groupBy(*series.keys, "run").agg(
        F.min(at).alias("t_start"), F.max_by(at, F.struct(F.col(value), -F.col(RN))).alias("t_peak"),
        F.count(F.lit(1)).alias("n_frames"), F.max(value).alias("peak_excess"), F.min(RN).alias(RN),
    ).where(F.col("n_frames") >= shortest).withColumn("duration_s", F.col("n_frames") * F.lit(float(frame_s))).drop("run")
    return replace(series, rows=runs.withColumn(BLOCK, F.floor(F.col(RN) / series.block_rows)))


def ordered_events(levels: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, base: DataFrame | None = None,
                   value: str = "level", threshold: float = fixed.EVENT_EXCESS, frame_s: float = fixed.FRAME_SECONDS,
                   shortest: int | None = None, **limits: int) -> Ordered:
    """``find_events`` with the order of the events inside their series, for ``merge_events``."""
    b = baselines(levels, keys, value) if base is None else base
    lv = meet(levels, b, keys).withColumn("excess", F.col(value) - F.col("baseline"))
    o = number_rows(lv, keys, order, **limits)
    return hot_runs(o, F.col("excess") >= threshold, at, "excess", frame_s, min_frames() if shortest is None else shortest)


def find_events(levels: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, base: DataFrame | None = None, **how) -> DataFrame:
    """Runs of frames at least ``threshold`` above the series baseline that last long enough."""
    return ordered_events(levels, keys, order, at, base, **how).rows.drop(RN, BLOCK)


def merge_events(events: DataFrame | Ordered, keys: Sequence[str], max_gap_s: float | Column = fixed.MERGE_GAP_SECONDS,
                 **limits: int) -> DataFrame:
    """Join events of a series whose gap to the running end is at most ``max_gap_s``; times in seconds.

    Events that come with their order are not numbered again.
    """
    gap = max_gap_s if isinstance(max_gap_s, Column) else F.lit(float(max_gap_s))
    o = events if isinstance(events, Ordered) else number_rows(events, keys, ["t_start", "t_peak"], **limits)
    end = F.col("t_start") + F.col("duration_s")
    o = chain_groups(o, F.col("t_start"), end, gap, strict=False)
    return o.rows.groupBy(*keys, "chain").agg(
        F.min("t_start").alias("t_start"), F.max(end).alias("_end"),
        F.max_by("t_peak", F.struct(F.col("peak_excess"), -F.col("t_start"))).alias("t_peak"),
        F.max("peak_excess").alias("peak_excess"), F.count(F.lit(1)).alias("n_fragments"),
    ).withColumn("duration_s", F.col("_end") - F.col("t_start")).drop("chain", "_end")


def merge_sweep(events: DataFrame | Ordered, keys: Sequence[str], gaps: Sequence[float] = fixed.MERGE_GAP_SWEEP) -> DataFrame:
    """Merged events at every gap: the gap becomes part of the series key."""
    gap = F.explode(F.array(*[F.lit(float(g)) for g in gaps]))
    by = [*keys, "gap_s"]
    spread = replace(events.with_columns(gap_s=gap), keys=tuple(by)) if isinstance(events, Ordered) else events.withColumn("gap_s", gap)
    return merge_events(spread, by, F.col("gap_s"))


def shuffled(levels: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, value: str = "level", seed: int = 0,
             **limits: int) -> DataFrame:
    """Permute the levels inside each series and keep the times.

    The permutation follows a hash of the row id, so a re-run task gives the same one.
    """
    times = number_rows(levels.drop(value), keys, order, **limits).rows
    lot = levels.select(*keys, F.col(ident).alias("_id"), F.col(value), F.md5(F.concat_ws("|", F.lit(seed), F.col(ident))).alias("_lot"))
    drawn = number_rows(lot, keys, ["_lot", "_id"], **limits).rows.select(*keys, RN, value)
    return meet(times, drawn, [*keys, RN]).drop(RN, BLOCK)


# ---- smoothing -------------------------------------------------------------------------------

def _mean_stages(series: Ordered, value: str, frames: int, name: str) -> list[dict]:
    """Window stages of a moving mean. Whole numbers are differences of running sums, at a cost that does not grow with ``frames``;
    sums of fractions would depend on where a block starts, so those are added up window by window."""
    h = frames // 2
    if not isinstance(series.rows.schema[value].dataType, T.IntegralType):
        return [{name: lambda w: F.sum(value).over(w.rowsBetween(-h, h)) / F.lit(float(frames))}]
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = lambda w: F.coalesce(F.lead("_run", h).over(w), F.sum(value).over(whole(w)))
    return [{"_run": lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))},
            {name: lambda w: (up(w) - F.coalesce(F.lag("_run", h + 1).over(w), F.lit(0))) / F.lit(float(frames))}]


def smooth_mean(series: Ordered, value: str, frames: int, name: str = "smooth") -> DataFrame:
    """Moving mean over an odd number of frames; missing neighbours count as 0, the divisor is fixed."""
    h = frames // 2
    return series.staged(h + 1, h, *_mean_stages(series, value, frames, name)).drop("_run")


def smooth_mean_or_median(series: Ordered, value: str, frames: int, name: str = "smooth") -> DataFrame:
    """As ``smooth_mean``, but a series no longer than the window becomes its constant median."""
    out = smooth_mean(series, value, frames, name)
    size = series.rows.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_len"), F.percentile(value, 0.5).alias("_mid"))
    return meet(out, size, series.keys).withColumn(
        name, F.when(F.col("_len") > frames, F.col(name)).otherwise(F.col("_mid"))).drop("_mid")


def sliding_order_statistic(levels: np.ndarray, width: int, rank: int) -> np.ndarray:
    """Value of ``rank`` (from 0) among each ``width`` neighbours in turn.

    The levels, coded by rank, are sorted by one bit after the other from the highest; a window stays a range through
    every sort, and the zeros in it tell which bit its order statistic has. Cost: bits of the code, not width, per row.
    """
    values, code = np.unique(levels, return_inverse=True)
    first = np.arange(len(levels) - width + 1)
    last, left, found = first + width, np.full(len(first), rank), np.zeros(len(first), np.int64)
    for bit in range(max(1, len(values) - 1).bit_length() - 1, -1, -1):
        one = code >> bit & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        inside = zeros[last] - zeros[first]
        low = left < inside
        found |= np.where(low, 0, 1 << bit)
        left = np.where(low, left, left - inside)
        first = np.where(low, zeros[first], zeros[-1] + first - zeros[first])
        last = np.where(low, zeros[last], zeros[-1] + last - zeros[last])
        code = np.concatenate([code[one == 0], code[one == 1]])
    return values[found]


def rolling_median(series: Ordered, value: str, frames: int, name: str = "median") -> DataFrame:
    """Centred median over an odd number of frames; beyond an edge the end value repeats.

    Costs as many steps a row as the distinct levels of a block have bits, whatever the width.
    """
    h, names = frames // 2, [*series.rows.columns, name]
    size = series.rows.groupBy(*series.keys).agg(F.max(RN).alias("_last"))
    o = Ordered(meet(series.rows, size, series.keys), series.keys, series.block_rows)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(RN).combine_chunks()
        levels, at = rows.column(value).to_numpy(), rows.column(RN).to_numpy()
        before = h if at[0] == 0 else 0
        after = h if at[-1] == rows.column("_last")[0].as_py() else 0
        home = np.flatnonzero(rows.column(BLOCK).to_numpy() == rows.column("_home").to_numpy())
        padded = np.concatenate([np.repeat(levels[:1], before), levels, np.repeat(levels[-1:], after)])
        middle = sliding_order_statistic(padded, 2 * h + 1, h)[home + before - h]
        out = rows.take(pa.array(home)).append_column(name, pa.array(middle.astype(float)))
        return out.select(names)

    padded, by = o.padded(h, h), [*series.keys, BLOCK]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in series.rows.schema], T.StructField(name, T.DoubleType())])
    out = padded.groupBy(*by).applyInArrow(run, schema)
    return out.withColumn(BLOCK, F.floor(F.col(RN) / series.block_rows))


def local_slope(series: Ordered, value: str, frames: int, frame_s: float, name: str = "slope_per_min") -> DataFrame:
    """Derivative per minute of a local quadratic fit over an odd number of frames.

    In the interior the derivative at the centre equals the least-squares line's slope. At the ends
    the last full window is fitted and its derivative taken at the row's own place. A series shorter
    than the window is refused.
    """
    h = frames // 2
    # Fit y = c0 + c1 u + c2 u^2 on u = -h..h: with S2 = sum u^2, S4 = sum u^4, N frames,
    # c1 = sum(u y)/S2 and c2 = (N sum(u^2 y) - S2 sum(y)) / (N S4 - S2^2).
    s2 = float(sum(u * u for u in range(-h, h + 1)))
    s4 = float(sum(u**4 for u in range(-h, h + 1)))
    size = series.rows.groupBy(*series.keys).agg(F.max(RN).alias("_last"))
    o = Ordered(meet(series.rows, size, series.keys), series.keys, series.block_rows)
    rn, y = F.col(RN), F.col(value).cast("double")
    r = (rn - F.col(BLOCK) * max(series.block_rows, h)).cast("double")  # numbers from the block's start stay small
    def over(c):
        return lambda w: F.sum(c).over(w.rowsBetween(-h, h))
    wide = o.centred(h, h, _y=over(y), _ry=over(r * y), _r=lambda w: r)
    wide = wide.withColumn("_c1", (F.col("_ry") - F.col("_r") * F.col("_y")) / s2)
    # The first and the last full window, with u counted from their centres.
    centres = F.array_compact(F.array_distinct(F.array(F.when(rn < frames, F.lit(h).cast("long")), F.when(rn > F.col("_last") - frames, F.col("_last") - h))))
    u = (rn - F.col("_centre")).cast("double")
    ends = o.rows.withColumn("_centre", F.explode(centres)).groupBy(*series.keys, "_centre").agg(
        (F.sum(u * y) / s2).alias("_e1"), ((frames * F.sum(u * u * y) - s2 * F.sum(y)) / (frames * s4 - s2 * s2)).alias("_e2"))
    out = meet(wide.withColumn("_centre", F.greatest(F.lit(h), F.least(rn, F.col("_last") - h))), ends, [*series.keys, "_centre"], "left")
    inner = (rn >= h) & (rn <= F.col("_last") - h)
    slope = F.when(inner, F.col("_c1")).otherwise(F.col("_e1") + 2 * F.col("_e2") * u)
    fits = F.when(F.col("_last") + 1 >= frames, slope).otherwise(F.raise_error(F.lit("series is shorter than the window")).cast("double"))
    return out.withColumn(name, fits / F.lit(frame_s) * 60).drop("_y", "_ry", "_r", "_c1", "_centre", "_e1", "_e2", "_last")


# ---- prominent peaks -------------------------------------------------------------------------

def turning_points(series: Ordered, value: str) -> DataFrame:
    """Local maxima with the lowest value between each and the next one.

    Equal neighbours form a plateau, whose middle (rounded down) is the peak. Rows: keys, ``n`` (0, 1, 2 and on;
    0 for the stretch before the first peak), row number ``mid``, ``height``, and ``valley`` = minimum
    from this peak up to the next peak or the end of the series.
    """
    return _turning_points(replace(series, rows=series.staged(1, 1, _neighbours(value))), value)


def _neighbours(value: str) -> dict:
    return {"_l": lambda w: F.lag(value).over(w), "_r": lambda w: F.lead(value).over(w)}


def _turning_points(series: Ordered, value: str) -> DataFrame:
    """``turning_points`` of rows that know their neighbours ``_l`` and ``_r``."""
    v = F.col(value)
    begins = F.when(F.col("_l").isNull() | (F.col("_l") != v), F.struct(F.col(RN).alias("first"), F.coalesce(F.col("_l") < v, F.lit(False)).alias("rises")))
    o = series.with_columns(_begin=begins).prefix(_run=("last", F.col("_begin")))
    o = o.with_columns(_run=F.coalesce("_begin", "_run"))
    o = o.with_columns(_top=F.coalesce(F.col("_r") < v, F.lit(False)) & F.col("_run.rises"))  # last row of a plateau that rose
    o = o.prefix(_n=("sum", F.col("_top").cast("int"))).with_columns(n=F.col("_n") + F.col("_top").cast("int"))
    mid = F.floor((F.col("_run.first") + F.col(RN)) / 2)
    return o.rows.groupBy(*series.keys, "n").agg(
        F.max(F.when(F.col("_top"), mid)).alias("mid"), F.max(F.when(F.col("_top"), v)).alias("height"), F.min(F.when(~F.col("_top"), v)).alias("valley"))


def _first_above(values: Column, least: Column) -> Column:
    """Place from 1 of the first element above ``least``, 0 without one."""
    return F.array_position(F.transform(values, lambda x: x > least), True)


def _lower(*columns: Column) -> Column:
    return F.least(*columns)


def prominences(points: DataFrame, keys: Sequence[str], wanted: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """(keys, mid, prominence) of the ``wanted`` peaks (keys, n, mid, height), or of every peak.

    The height drop is taken to the higher of the two lowest values on the way to higher ground (or
    the series' end) on each side. Points are gathered in blocks of ``fan``, blocks in blocks of blocks and so on, each with its
    highest top and lowest valley. A peak looks for higher ground in its own block, then climbs to the
    first block of blocks that has some, and goes down again to the very point: one join per storey, and no
    more than ``fan`` values per look, however far the higher ground is.
    """
    by = [*keys]
    most = points.agg(F.max("n")).first()[0] or 0
    storeys, span = [], 1
    rows = points.select(*by, "n", F.coalesce(F.col("height").cast("double"), F.lit(float("-inf"))).alias("h"), F.col("valley").cast("double").alias("v"))
    while not storeys or span <= most:
        packed = rows.groupBy(*by, F.floor(F.col("n") / fan).alias("b")).agg(F.array_sort(F.collect_list(F.struct("n", "h", "v"))).alias("e"))
        packed = packed.select(*by, "b", F.col("e.h").alias("hs"), F.col("e.v").alias("vs"))
        storeys.append(packed)
        rows = packed.select(*by, F.col("b").alias("n"), F.array_max("hs").alias("h"), F.array_min("vs").alias("v"))
        span *= fan
    asked = points.where("height IS NOT NULL") if wanted is None else wanted
    q = asked.select(*by, "n", "mid", F.col("height").cast("double").alias("h"))
    hs, vs, h, n = F.col("hs"), F.col("vs"), F.col("h"), F.col("n")
    # upwards: the same blocks serve both sides
    at = (n % fan).cast("int")
    q = meet(q.withColumn("b", F.floor(n / fan)), storeys[0], [*by, "b"])
    back, ahead = _first_above(F.reverse(F.slice(hs, 1, at)), h), _first_above(F.slice(hs, at + 2, fan), h)
    back, ahead = back.cast("int"), ahead.cast("int")
    q = q.select(*by, "n", "mid", "h", (back > 0).alias("met_l"), (ahead > 0).alias("met_r"),
                 F.array_min(F.when(back > 0, F.slice(vs, at - back + 1, back)).otherwise(F.slice(vs, 1, at))).alias("low_l"),
                 F.array_min(F.slice(vs, at + 1, F.when(ahead > 0, ahead).otherwise(fan))).alias("low_r"))
    nowhere = F.lit(None).cast("struct<storey:int,b:bigint>")
    q = q.withColumns({"to_l": nowhere, "to_r": nowhere})
    width = fan
    for storey in range(1, len(storeys)):
        at, home = (F.floor(n / width) % fan).cast("int"), F.floor(n / (width * fan))
        # settled peaks look nowhere, each under a block number of its own
        q = meet(q.withColumn("b", F.when(F.col("met_l") & F.col("met_r"), -1 - n).otherwise(home)), storeys[storey], [*by, "b"], "left")
        back, ahead = _first_above(F.reverse(F.slice(hs, 1, at)), h).cast("int"), _first_above(F.slice(hs, at + 2, fan), h).cast("int")
        low_l = F.array_min(F.when(back > 0, F.slice(vs, at - back + 2, back - 1)).otherwise(F.slice(vs, 1, at)))
        low_r = F.array_min(F.slice(vs, at + 2, F.when(ahead > 0, ahead - 1).otherwise(fan)))
        new = {}
        for side, found, low, child in (("l", back, low_l, at - back), ("r", ahead, low_r, at + ahead)):
            open_ = ~F.col(f"met_{side}")
            new[f"low_{side}"] = F.when(open_, _lower(F.col(f"low_{side}"), low)).otherwise(F.col(f"low_{side}"))
            new[f"to_{side}"] = F.when(open_ & (found > 0), F.struct(F.lit(storey - 1).alias("storey"), (home * fan + child).cast("long").alias("b"))).otherwise(F.col(f"to_{side}"))
            new[f"met_{side}"] = F.col(f"met_{side}") | F.coalesce(found > 0, F.lit(False))
        q = q.withColumns(new).drop("b", "hs", "vs")
        width *= fan
    if len(storeys) == 1:
        return q.select(*by, "mid", (h - F.greatest("low_l", "low_r")).alias("prominence"))
    sides = F.array(*[F.struct(F.lit(s == "l").alias("back"), F.col(f"low_{s}").alias("low"), F.col(f"to_{s}.storey").alias("storey"), F.col(f"to_{s}.b").alias("to")) for s in "lr"])
    q = q.select(*by, "n", "mid", "h", F.inline(sides))
    for storey in range(len(storeys) - 2, -1, -1):  # downwards to the point
        q = meet(q.withColumn("b", F.when(F.col("storey") == storey, F.col("to")).otherwise(-1 - n)), storeys[storey], [*by, "b"], "left")
        last, first = _first_above(F.reverse(hs), h).cast("int"), _first_above(hs, h).cast("int")
        on_top = 0 if storey == 0 else 1  # a point's valley lies behind it, a block's own valleys are looked at inside it
        low = F.array_min(F.when(F.col("back"), F.slice(vs, F.size(hs) - last + 1 + on_top, fan)).otherwise(F.slice(vs, 1, first - 1)))
        child = F.when(F.col("back"), F.size(hs) - last).otherwise(first - 1)
        here = F.col("storey") == storey
        q = q.withColumns({"low": F.when(here, _lower(F.col("low"), low)).otherwise(F.col("low")), "to": F.when(here, F.col("b") * fan + child).otherwise(F.col("to")),
                           "storey": F.when(here, F.lit(storey - 1)).otherwise(F.col("storey"))}).drop("b", "hs", "vs")
    return q.groupBy(*by, "mid", "h").agg(F.max("low").alias("low")).select(*by, "mid", (h - F.col("low")).alias("prominence"))


def apart(peaks: DataFrame, keys: Sequence[str], place: str, distance: float, first: Sequence[Column], reach: int = REACH) -> DataFrame:
    """Greedy spacing: keep a row unless a kept row with priority (smaller ``first`` tuple) is nearer than ``distance``.

    Stretches of ``reach`` distances, with a copy of what lies less than one distance beyond their edges, are swept by priority. What
    depends on a copy stays open and is swept again in stretches twice as long, together with what was kept.
    """
    by, ranks = [*keys], [f"_o{i}" for i in range(len(first))]
    p = peaks.withColumns(dict(zip(ranks, first)))
    # rows of one place conflict too: exactly one of them, the first, can stay
    rest = [c for c in peaks.columns if c not in (*by, place)]
    lone = p.groupBy(*by, place).agg(F.min(F.struct(*ranks, *rest)).alias("row"))
    now, width, before = lone.withColumn("kept", F.lit(False)), distance * reach, None

    def step(s: Column, x: Column) -> Column:
        near = lambda c: F.exists(s[c], lambda k: F.abs(k - x["at"]) < distance)
        keep = x["kept"] | (x["own"] & ~near("kept") & ~near("open"))
        add = lambda c, yes: F.when(yes, F.concat(s[c], F.array(x["at"]))).otherwise(s[c])
        return F.struct(add("kept", keep).alias("kept"), add("open", ~keep & ~near("kept")).alias("open"))

    none = F.array().cast("array<double>")
    while True:
        home = F.floor(F.col(place) / width)
        beside = F.array_distinct(F.array(home, *[F.floor((F.col(place) + d) / width) for d in (-distance, distance)]))
        each = now.select(*by, F.explode(beside).alias("b"), F.struct(
            F.struct(*[F.col(f"row.{c}") for c in ranks], place).alias("rank"), F.col(place).cast("double").alias("at"), home.alias("home"), "kept", F.col("row").alias("row"), F.col(place).alias("place")).alias("e"))
        each = each.select(*by, "b", F.col("e").withField("own", F.col("e.home") == F.col("b")).alias("e"))
        swept = each.groupBy(*by, "b").agg(F.array_sort(F.collect_list("e")).alias("e"))
        swept = swept.withColumn("s", F.aggregate("e", F.struct(none.alias("kept"), none.alias("open")), step))
        left = F.filter("e", lambda x: x["own"] & (F.array_contains(F.col("s.kept"), x["at"]) | F.array_contains(F.col("s.open"), x["at"])))
        out = swept.select(*by, "s", F.explode(left).alias("e"))
        now = cut(out.select(*by, F.col("e.place").alias(place), F.col("e.row").alias("row"), F.array_contains(F.col("s.kept"), F.col("e.at")).alias("kept")), "spaced")
        if before is not None:
            release(before)
        if now.where("NOT kept").isEmpty():
            return now.select(*[F.col(c) if c in (*by, place) else F.col(f"row.{c}").alias(c) for c in peaks.columns])
        before, width = now, width * 2


def prominent_peaks(series: Ordered, value: str, at: str, floor: DataFrame | None, min_prominence: float, distance: int) -> DataFrame:
    """Local maxima of ``value`` that are high, separated and prominent enough.

    ``floor`` holds the least height per series (column ``least``) or is None. Order of the tests: height, then distance
    (highest first, the later one on ties), then prominence on the whole series.
    """
    return _prominent_peaks(replace(series, rows=series.staged(1, 1, _neighbours(value))), value, at, floor, min_prominence, distance)


def _prominent_peaks(series: Ordered, value: str, at: str, floor: DataFrame | None, min_prominence: float, distance: int) -> DataFrame:
    rows = cut(series.rows.select(*series.keys, RN, BLOCK, at, value, "_l", "_r"), "smooth")
    points = cut(_turning_points(replace(series, rows=rows), value), "turning")
    tops = points.where("height IS NOT NULL").drop("valley")
    if floor is not None:
        tops = meet(tops, floor, series.keys).where(F.col("height") >= F.col("least")).drop("least")
    spaced = apart(tops, series.keys, "mid", distance, [-F.col("height"), -F.col("mid")])
    prom = meet(spaced, prominences(points, series.keys, spaced), [*series.keys, "mid"]).where(F.col("prominence") >= min_prominence)
    times = rows.select(*series.keys, F.col(RN).alias("mid"), F.col(at).alias("t_peak"))
    return meet(prom.select(*series.keys, "mid", "height", "prominence"), times, [*series.keys, "mid"])


def passages(levels: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, value: str = "level",
             frames: int | None = None, distance: int | None = None, threshold: float = fixed.EVENT_EXCESS,
             min_prominence: float | None = None, constant_when_short: bool = False, **limits: int) -> DataFrame:
    """Closest-approach instants: prominent peaks of the smoothed level above baseline + threshold."""
    n = odd_frames(fixed.SMOOTH_SECONDS) if frames is None else frames
    gap = max(1, round(fixed.SEPARATION_SECONDS / fixed.FRAME_SECONDS)) if distance is None else distance
    # A constant series has no peak, so a series no longer than the window, which stands for its median, has no floor to pass.
    size = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len")).where(F.col("_len") > n).drop("_len")
    floor = meet(baselines(levels, keys, value).select(*keys, (F.col("baseline") + threshold).alias("least")), size, keys)
    o = number_rows(levels, keys, order, **limits)
    h = n // 2
    rows = o.staged(h + 2, h + 1, *_mean_stages(o, value, n, "smooth"), _neighbours("smooth"))
    return _prominent_peaks(replace(o, rows=rows), "smooth", at, floor, threshold if min_prominence is None else min_prominence, gap)
