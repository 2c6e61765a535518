"""Time columns: names to intervals, zone conversion, grids. All instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.operators.guards import DataError

STAMP = r"(\d{8}T\d{6}(?:\.\d{1,3})?)Z"
HAS_OFFSET = r"([+-]\d\d:?\d\d|Z)$"


def utc(col: Column) -> Column:
    """Parquet timestamps without a zone are UTC by definition."""
    return col.cast("timestamp")


def epoch_s(ts: Column) -> Column:
    return F.unix_micros(utc(ts)) / F.lit(1e6)


def _stamp(text: Column) -> Column:
    plain = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss.SSS")), plain)


def file_interval(name: Column, device: str) -> Column:
    """``device_<start>Z[_<end>Z]...`` -> struct(start_utc, end_utc, problem).

    One stamp means a full-length file. ``problem`` is NULL for a good name.
    """
    pattern = rf"^([^_]+)_{STAMP}(?:_{STAMP})?"
    start = _stamp(F.regexp_extract(name, pattern, 2))
    end_text = F.regexp_extract(name, pattern, 3)
    end = F.when(end_text != "", _stamp(end_text)).otherwise(start + F.expr(f"INTERVAL {fixed.FILE_SECONDS} SECONDS"))
    problem = (
        F.when(F.regexp_extract(name, r"^([^_]+)_", 1) != device, F.lit("other_device"))
        .when(start.isNull() | end.isNull(), F.lit("no_utc_stamp"))
        .when(end <= start, F.lit("reversed"))
    )
    return F.struct(start.alias("start_utc"), end.alias("end_utc"), problem.alias("problem"))


def parse_utc(text: Column) -> Column:
    """ISO text to UTC: offsets are converted, text without one is UTC, blank is NULL."""
    t = F.trim(text)
    return F.when(t != "", F.coalesce(*[
        F.try_to_timestamp(t, F.lit(f))
        for f in (
            "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
            "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
            "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX",
            "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
            "yyyy-MM-dd",
        )
    ]))


def require_offset(text: Column) -> Column:
    """Parsed instant, failing on text that carries no UTC offset."""
    t = F.trim(text)
    return F.when(t.rlike(HAS_OFFSET), parse_utc(t)).otherwise(
        F.raise_error(F.concat(F.lit("no UTC offset: "), F.coalesce(t, F.lit("NULL"))))
    )


def local_window(date: Column, start: str = fixed.LOCAL_WINDOW[0], end: str = fixed.LOCAL_WINDOW[1],
                 zone: str = fixed.LOCAL_ZONE) -> Column:
    """Wall-clock window of a local date as UTC instants (half-open).

    A wall time that daylight saving skips or repeats is refused, never shifted.
    """

    def instant(clock: str) -> Column:
        wall = F.concat_ws(" ", date.cast("string"), F.lit(clock))
        ntz = F.to_timestamp_ntz(wall)
        out = F.convert_timezone(F.lit(zone), F.lit("UTC"), ntz)
        back = F.convert_timezone(F.lit("UTC"), F.lit(zone), out)
        hour = F.expr("INTERVAL 1 HOUR")
        twin = (F.convert_timezone(F.lit("UTC"), F.lit(zone), out - hour) == ntz) | (
            F.convert_timezone(F.lit("UTC"), F.lit(zone), out + hour) == ntz
        )
        return F.when((back == ntz) & ~twin, utc(out)).otherwise(
            F.raise_error(F.concat(F.lit("no single instant for local time "), wall))
        )

    return F.struct(instant(start).alias("start_utc"), instant(end).alias("end_utc"))


def around(ts: Column, half_s: float) -> tuple[Column, Column]:
    step = F.make_dt_interval(secs=F.lit(float(half_s)))
    return utc(ts) - step, utc(ts) + step


def minutes_from(ts: Column, origin: Column) -> Column:
    return (epoch_s(ts) - epoch_s(origin)) / 60


def off_strip(ts: Column, hours: tuple[int, ...] = (16, 17, 18)) -> Column:
    """True when the UTC hour lies outside the hours the baseline was built from."""
    return ~F.hour(utc(ts)).isin(*hours)


def ceil_grid(ts: Column, seconds: int = fixed.BIN_SECONDS) -> Column:
    return F.timestamp_seconds(F.ceil(epoch_s(ts) / seconds) * seconds)


def floor_grid(ts: Column, seconds: int = fixed.BIN_SECONDS) -> Column:
    return F.timestamp_seconds(F.floor(epoch_s(ts) / seconds) * seconds)


def season_bins(spans: DataFrame, months: tuple[int, ...] = fixed.SEASON_MONTHS,
                seconds: int = fixed.BIN_SECONDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole epoch-aligned bins inside each (start_utc, end_utc) span whose start falls in ``months``."""
    first = F.ceil(epoch_s(F.col("start_utc")) / seconds)
    last = F.floor(epoch_s(F.col("end_utc")) / seconds) - 1
    # Days first, then the bins of each day, so that no array grows with the length of a span.
    per_day = 86_400 // seconds
    days = spans.where(first <= last).select(*keep, first.alias("_a"), last.alias("_b")).withColumn(
        "_d", F.explode(F.sequence(F.floor(F.col("_a") / per_day), F.floor(F.col("_b") / per_day)))
    )
    bins = days.select(*keep, F.explode(F.sequence(
        F.greatest("_a", F.col("_d") * per_day), F.least("_b", (F.col("_d") + 1) * per_day - 1))).alias("_bin"))
    out = bins.select(
        *keep,
        F.timestamp_seconds(F.col("_bin") * seconds).alias("start_utc"),
        F.timestamp_seconds((F.col("_bin") + 1) * seconds).alias("end_utc"),
    )
    return out.where(F.month("start_utc").isin(*months))


def calendar_chunks(spans: DataFrame, unit: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each span split at ``unit`` ('month' or 'year') starts, chunks clipped to the span."""
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    begin = F.date_trunc(unit, "start_utc")
    heads = F.sequence(begin, F.col("end_utc"), step)
    out = spans.withColumn("_head", F.explode(heads)).select(
        *keep,
        F.greatest("_head", "start_utc").alias("chunk_start_utc"),
        F.least(F.col("_head") + step, F.col("end_utc")).alias("chunk_end_utc"),
    )
    return out.where("chunk_start_utc < chunk_end_utc")


def season_dates(spans: DataFrame, months: tuple[int, ...] = fixed.SEASON_MONTHS) -> DataFrame:
    """Every season date of each (start_year, end_year) span with its place in newest-year-first order."""
    d = spans.select(F.explode(F.sequence("start_year", "end_year")).alias("year")).distinct()
    d = d.select("year", F.explode(F.sequence(
        F.make_date("year", F.lit(months[0]), F.lit(1)),
        F.last_day(F.make_date("year", F.lit(months[-1]), F.lit(1))))).alias("date"))
    return d.where(F.month("date").isin(*months)).orderBy(F.desc("year"), "date")


def check_span(start: str, end: str) -> None:
    if start >= end:
        raise DataError("span is empty or reversed")
