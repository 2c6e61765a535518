"""Intervals: merging, coverage, overlap joins and counts, calendars and gaps.

Intervals are half-open ``[start_utc, end_utc)`` with start < end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions.times import epoch_s, floor_grid
from tidelight.operators.guards import refuse
from tidelight.operators.ordered import Ordered, number_rows


def _us(col: str | Column) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def chain_groups(ordered: Ordered, start: Column, end: Column, gap: Column, strict: bool) -> Ordered:
    """Number the chains of intervals whose distance to the running end is at most (or below) ``gap``."""
    o = ordered.prefix(_reach=("max", end))
    joined = (start - F.col("_reach") < gap) if strict else (start - F.col("_reach") <= gap)
    o = o.with_columns(_new=F.when(F.col("_reach").isNotNull() & joined, 0).otherwise(1))
    o = o.prefix(_before=("sum", F.col("_new")))
    return o.with_columns(chain=F.col("_before") + F.col("_new"))


def merge_intervals(df: DataFrame, keys: Sequence[str] = (), gap_s: float = fixed.FILE_SECONDS,
                    strict: bool = True, **limits: int) -> DataFrame:
    """Merge intervals of one key whose gap is below ``gap_s`` (or at most, when not strict)."""
    distinct = df.groupBy(*keys, "start_utc").agg(F.max("end_utc").alias("end_utc"), F.count(F.lit(1)).alias("_n"))
    keyed = distinct if keys else distinct.withColumn("_one", F.lit(1))
    by = list(keys) or ["_one"]
    o = number_rows(keyed, by, ["start_utc"], **limits)
    o = chain_groups(o, _us("start_utc"), _us("end_utc"), F.lit(int(gap_s * 1e6)), strict)
    return o.rows.groupBy(*by, "chain").agg(
        F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"), F.sum("_n").alias("n_merged")
    ).drop("chain", "_one")


def prefer_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tag: str = "kept") -> DataFrame:
    """Flag the preferred row of every key; the others are the reported duplicates.

    The winner comes from a partial aggregate (smallest order values), so copies of one key never
    meet in one task.
    """
    pick = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min(pick).alias("_best"), F.count(F.lit(1)).alias("n_copies"))
    return df.join(best, [*keys]).withColumn(tag, F.col("_best") == pick).drop("_best")


def file_index(files: DataFrame, device: str, rank: Column | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse names, then split into (one row per start, rejected or duplicate rows with a reason).

    Compressed copies win over plain ones, earlier containers over later ones. With ``strict`` a name of the own device
    that does not parse stops the job instead of becoming a row; names of other devices are rows either way.
    """
    from tidelight.functions.times import file_interval

    parsed = files.withColumn("_p", file_interval(F.col("name"), device)).select(
        *files.columns, "_p.start_utc", "_p.end_utc", F.col("_p.problem").alias("reason"))
    if strict:
        refuse(parsed, {r: F.col("reason") == r for r in ("no_utc_stamp", "reversed")})
    good = parsed.where("reason IS NULL").drop("reason")
    order = ([rank] if rank is not None else []) + [F.when(F.col("name").endswith(".gz"), 0).otherwise(1), F.col("name")]
    flagged = prefer_first(good, ["start_utc"], order)
    kept = flagged.where("kept").drop("kept")
    lost = flagged.where("NOT kept").drop("kept", "n_copies").withColumn("reason", F.lit("duplicate_start"))
    return kept, lost.unionByName(parsed.where("reason IS NOT NULL"))


def buckets(start: Column, last: Column, seconds: int) -> Column:
    """Every bucket number touched by [start, last]."""
    return F.sequence(F.floor(epoch_s(start) / seconds), F.floor(epoch_s(last) / seconds))


def overlap_pairs(windows: DataFrame, items: DataFrame, keys: Sequence[str] = (), bucket_s: int = 3600,
                  closed: bool = False) -> DataFrame:
    """Pairs of overlapping (w_start, w_end) windows and (start_utc, end_utc) items.

    Both sides are spread over time buckets and equi-joined. A pair is emitted only in the first
    bucket both sides share, so no duplicates arise and none have to be removed.
    """
    w = windows.withColumn("_wb", F.floor(epoch_s(F.col("w_start")) / bucket_s)).withColumn(
        "_b", F.explode(buckets(F.col("w_start"), F.col("w_end"), bucket_s)))
    i = items.withColumn("_ib", F.floor(epoch_s(F.col("start_utc")) / bucket_s)).withColumn(
        "_b", F.explode(buckets(F.col("start_utc"), F.col("end_utc"), bucket_s)))
    j = w.join(i, [*keys, "_b"]).where(F.col("_b") == F.greatest("_wb", "_ib"))
    hit = (F.col("start_utc") <= F.col("w_end")) & (F.col("end_utc") >= F.col("w_start")) if closed else (
        (F.col("start_utc") < F.col("w_end")) & (F.col("end_utc") > F.col("w_start")))
    return j.where(hit).drop("_b", "_wb", "_ib")


def overlap_counts(windows: DataFrame, items: DataFrame, ids: Sequence[str], keys: Sequence[str] = (),
                   closed: bool = False, name: str = "n_overlaps", **limits: int) -> DataFrame:
    """How many items overlap each window, without forming a single pair.

    Overlaps = items that started by the window's end minus items that ended by its start. Items
    and windows become marks on one time line; running counts at the marks give both numbers.
    Items with equal marks are counted first.
    """
    by = list(keys) or ["_one"]
    def keyed(df):
        return df if keys else df.withColumn("_one", F.lit(1))
    w, i = keyed(windows), keyed(items)
    first, second = F.lit(0), F.lit(1)
    starts = i.groupBy(*by, _us("start_utc").alias("at")).agg(F.count(F.lit(1)).alias("_s")).select(
        *by, "at", (second if not closed else first).alias("tie"), "_s", F.lit(0).alias("_e"), F.lit(None).cast("string").alias("side"),
        *[F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in ids])
    ends = i.groupBy(*by, _us("end_utc").alias("at")).agg(F.count(F.lit(1)).alias("_e")).select(
        *by, "at", (first if not closed else second).alias("tie"), F.lit(0).alias("_s"), "_e", F.lit(None).cast("string").alias("side"),
        *[F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in ids])
    ask_end = w.select(*by, _us("w_end").alias("at"), (first if not closed else second).alias("tie"),
                       F.lit(0).alias("_s"), F.lit(0).alias("_e"), F.lit("end").alias("side"), *ids)
    ask_start = w.select(*by, _us("w_start").alias("at"), (second if not closed else first).alias("tie"),
                         F.lit(0).alias("_s"), F.lit(0).alias("_e"), F.lit("start").alias("side"), *ids)
    marks = starts.unionByName(ends).unionByName(ask_end).unionByName(ask_start)
    # Order key: (at, tie, items before questions or after?). Starts must not be seen by a half-open
    # end question at the same instant (tie 1 > 0) and ends must be seen by a start question (0 < 1).
    # For closed windows starts (0) are seen by end questions (1) and ends (1) are not seen by start
    # questions (0). Questions carry no weight, so their own order does not matter.
    order = ["at", "tie", F.coalesce(F.col("side"), F.lit("")), *[F.col(c) for c in ids]]
    o = number_rows(marks, by, order, **limits).prefix(_ns=("sum", F.col("_s")), _ne=("sum", F.col("_e")))
    return (
        o.rows.where("side IS NOT NULL").groupBy(*[k for k in by if k != "_one"], *ids)
        .agg((F.max(F.when(F.col("side") == "end", F.col("_ns"))) - F.max(F.when(F.col("side") == "start", F.col("_ne")))).alias(name))
    )


def covered_seconds(windows: DataFrame, items: DataFrame, ids: Sequence[str], keys: Sequence[str] = (),
                    bucket_s: int = 3600, tolerance_s: float = 1.0) -> DataFrame:
    """Seconds of each window covered by items, overlaps counted once; full within ``tolerance_s``."""
    solid = merge_intervals(items, keys, gap_s=0, strict=False)
    pairs = overlap_pairs(windows, solid, keys, bucket_s)
    secs = (_us(F.least("end_utc", "w_end")) - _us(F.greatest("start_utc", "w_start"))) / F.lit(1e6)
    hit = pairs.groupBy(*keys, *ids).agg(F.sum(secs).alias("covered_s"))
    length = (_us("w_end") - _us("w_start")) / F.lit(1e6)
    out = windows.join(hit, [*keys, *ids], "left").withColumn("covered_s", F.coalesce("covered_s", F.lit(0.0)))
    return (out.withColumn("window_s", length)
            .withColumn("coverage", F.when(F.col("covered_s") >= F.col("window_s") - tolerance_s, "full")
                        .when(F.col("covered_s") > 0, "partial").otherwise("none")))


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.groupBy("coverage").agg(F.count(F.lit(1)).alias("n_windows"))


def available_bins(bins: DataFrame, items: DataFrame, keys: Sequence[str] = (),
                   seconds: int = fixed.BIN_SECONDS) -> DataFrame:
    """Add ``available``: some interval overlaps the epoch-aligned bin for a non-zero time.

    Merged intervals are disjoint, so spreading them over bins yields about one row per bin.
    """
    solid = merge_intervals(items, keys, gap_s=0, strict=False)
    # Stretches of a thousand bins first, then bins, so that no array grows with an interval's length.
    first, last = F.floor(epoch_s(F.col("start_utc")) / seconds), F.floor((_us("end_utc") - 1) / F.lit(1e6) / seconds)
    part = solid.select(*keys, first.alias("_f"), last.alias("_l"), F.explode(F.sequence(F.floor(first / 1000), F.floor(last / 1000))).alias("_p"))
    hit = part.select(*keys, F.explode(F.sequence(F.greatest("_f", F.col("_p") * 1000), F.least("_l", F.col("_p") * 1000 + 999))).alias("_b")).distinct()
    b = bins.withColumn("_b", F.floor(epoch_s(F.col("start_utc")) / seconds))
    return b.join(hit.withColumn("_hit", F.lit(True)), [*keys, "_b"], "left").withColumn(
        "available", F.coalesce("_hit", F.lit(False))).drop("_hit", "_b")


def assign_unit(points: DataFrame, units: DataFrame, ids: Sequence[str], at: str, unit: str, order: Sequence[str],
                keys: Sequence[str] = (), bucket_s: int = 86_400) -> DataFrame:
    """First unit (by ``order``) whose [start_utc, end_utc) holds the instant; '' when there is none."""
    p = points.withColumn("_b", F.floor(epoch_s(F.col(at)) / bucket_s))
    u = units.withColumn("_b", F.explode(buckets(F.col("start_utc"), F.col("end_utc"), bucket_s)))
    u = u.select(*keys, "_b", "start_utc", "end_utc", F.struct(*order, unit).alias("_u"))
    hit = p.select(*keys, *ids, "_b", at).join(u, [*keys, "_b"]).where(
        (F.col(at) >= F.col("start_utc")) & (F.col(at) < F.col("end_utc")))
    best = hit.groupBy(*keys, *ids).agg(F.min("_u").alias("_u"))
    return points.join(best, [*keys, *ids], "left").withColumn(unit, F.coalesce(F.col(f"_u.{unit}"), F.lit(""))).drop("_u")


def flag_runs(bins: DataFrame, keys: Sequence[str], flag: Column, min_s: float = 0, **limits: int) -> DataFrame:
    """Runs of flagged bins; a run ends at an unflagged bin or where the grid jumps."""
    o = number_rows(bins.withColumn("_f", flag), keys, ["start_utc"], **limits)
    o = o.prefix(_pf=("last", F.col("_f")), _pe=("last", F.col("end_utc")))
    joined = F.col("_pf") & (F.col("_pe") == F.col("start_utc"))
    o = o.with_columns(_new=F.when(F.col("_f") & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0))
    o = o.prefix(_before=("sum", F.col("_new"))).with_columns(_run=F.col("_before") + F.col("_new"))
    runs = o.rows.where("_f").groupBy(*keys, "_run").agg(
        F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"), F.count(F.lit(1)).alias("n_bins"))
    length = (_us("end_utc") - _us("start_utc")) / F.lit(1e6)
    return runs.withColumn("seconds", length).where(F.col("seconds") >= min_s).drop("_run")


def mean_by_hour(bins: DataFrame, flag: Column) -> DataFrame:
    """Exactly 24 rows; the mean is NULL for an hour without bins."""
    hours = bins.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    got = bins.groupBy(F.hour("start_utc").alias("hour")).agg(
        F.avg(flag.cast("int")).alias("availability"), F.count(F.lit(1)).alias("n_bins"))
    return hours.join(got, "hour", "left").withColumn("n_bins", F.coalesce("n_bins", F.lit(0)))


def mean_by_day(bins: DataFrame, flag: Column) -> DataFrame:
    return bins.groupBy(F.year("start_utc").alias("year"), F.dayofyear("start_utc").alias("doy")).agg(
        F.avg(flag.cast("int")).alias("availability"), F.count(F.lit(1)).alias("n_bins"))


def empty_units(items: DataFrame, unit: str, span: DataFrame) -> DataFrame:
    """Every calendar unit of the span with its number of items, counted by the item's start."""
    units = span.select(F.explode(F.sequence(
        F.date_trunc(unit, "start_utc"), F.date_trunc(unit, "end_utc"), F.expr(f"INTERVAL 1 {unit.upper()}"))).alias("unit_start"))
    got = items.groupBy(F.date_trunc(unit, "start_utc").alias("unit_start")).agg(F.count(F.lit(1)).alias("n_items"))
    return units.join(got, "unit_start", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def nearest_gap_hours(points: DataFrame, gaps: DataFrame, ids: Sequence[str], at: str, keys: Sequence[str] = (),
                      **limits: int) -> DataFrame:
    """Hours from each instant to the nearest gap, 0 inside one, NULL when there are no gaps."""
    by = list(keys) or ["_one"]
    def keyed(df):
        return df if keys else df.withColumn("_one", F.lit(1))
    g = keyed(gaps).groupBy(*by, "start_utc").agg(F.max("end_utc").alias("end_utc"))
    null_ids = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ids]
    p = keyed(points)

    def line(forward: bool) -> DataFrame:
        edge = _us("start_utc") if forward else -_us("start_utc")
        mark = _us("end_utc") if forward else -_us("start_utc")
        ask = _us(at) if forward else -_us(at)
        marks = g.select(*by, edge.alias("x"), F.lit(0).alias("tie"), mark.alias("m"), *null_ids).unionByName(
            p.select(*by, ask.alias("x"), F.lit(1).alias("tie"), F.lit(None).cast("bigint").alias("m"), *ids))
        o = number_rows(marks, by, ["x", "tie", *[F.col(c) for c in ids], F.col("m")], **limits)
        return o.prefix(_m=("max", F.col("m"))).rows.where("tie = 1").select(*by, *ids, "x", "_m")

    back = line(True).select(*by, *ids, F.when(F.col("_m").isNotNull(), F.greatest(F.lit(0), F.col("x") - F.col("_m"))).alias("_since"))
    ahead = line(False).select(*by, *ids, (F.col("x") - F.col("_m")).alias("_until"))
    both = back.join(ahead, [*by, *ids])
    return both.select(*[k for k in by if k != "_one"], *ids, (F.least("_since", "_until") / F.lit(3.6e9)).alias("gap_hours"))


def grid_span(df: DataFrame, start: str, end: str, seconds: int = fixed.BIN_SECONDS) -> DataFrame:
    """One row with the span of a table, cut to the grid."""
    return df.agg(floor_grid(F.min(start), seconds).alias("start_utc"), floor_grid(F.max(end), seconds).alias("end_utc"))
