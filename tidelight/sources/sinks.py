"""Writers that refuse wrong input before anything is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelight import schemas
from tidelight.operators.guards import DataError, refuse, refuse_inside, require_columns, require_schema


def _text(df: DataFrame) -> DataFrame:
    """Instants as ISO text with an offset; NULL stays blank."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return df.select(*[iso(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, fields: Sequence[str], protected: str | None = None) -> None:
    """CSV with exactly these columns."""
    out = require_columns(df, fields)
    if protected:
        refuse_inside(path, protected)
    _text(out).write.csv(path, header=True, mode="errorifexists")


def write_uptime(df: DataFrame, path: str) -> None:
    """Uptime calendar: zone-aware stamps, real booleans, forward bins, at least one row."""
    kinds = {f.name: f.dataType for f in df.schema}
    if not isinstance(kinds.get("available"), T.BooleanType):
        raise DataError("available must be boolean")
    if not all(isinstance(kinds.get(c), T.TimestampType) for c in ("start_utc", "end_utc")):
        raise DataError("bin edges must be zone-aware timestamps")
    out = require_schema(df, schemas.UPTIME)
    refuse(out, {"null_edge_or_flag": F.col("start_utc").isNull() | F.col("end_utc").isNull() | F.col("available").isNull(),
                 "reversed": F.col("end_utc") <= F.col("start_utc"),
                 "available_without_deployment": F.col("available") & (F.coalesce("deployment_id", F.lit("")) == "")}, empty="no bins to write")
    _text(out).write.csv(path, header=True, mode="errorifexists")


def write_deployments(df: DataFrame, path: str) -> None:
    out = require_schema(df, schemas.DEPLOYMENTS)
    refuse(out, {"reversed": F.col("end_utc") <= F.col("start_utc")}, empty="no deployments to write")
    _text(out).write.csv(path, header=True, mode="errorifexists")


def write_frames(df: DataFrame, path: str) -> None:
    """Frames partitioned by date and sorted by time in each file, so that time filters skip files and row groups."""
    dated = df.withColumn("date", F.to_date(F.timestamp_micros((F.col("t_utc_s") * 1e6).cast("bigint"))))
    spread = dated.repartitionByRange("date", "path").sortWithinPartitions("date", "t_utc_s")
    spread.write.partitionBy("date").mode("append").parquet(path)


def write_provenance(df_like: DataFrame, path: str, **facts) -> None:
    """One JSON row about the data that follows; call it before the data is written."""
    row = df_like.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()], F.current_timestamp().alias("generated_utc"))
    row.coalesce(1).write.json(path, mode="errorifexists")


def write_run(df: DataFrame, folder: str, run_id: str, facts: dict) -> None:
    """Provenance first, then this run's table (never overwritten), then the ``latest`` copy (always overwritten)."""
    write_provenance(df, f"{folder}/provenance/run_id={run_id}", run_id=run_id, **facts)
    df.write.parquet(f"{folder}/runs/run_id={run_id}", mode="errorifexists")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/runs/run_id={run_id}")
    written.write.parquet(f"{folder}/latest", mode="overwrite")


def write_population(folder: str, hist: DataFrame, median_spectra: DataFrame, window_stats: DataFrame, season: str = "year") -> None:
    hist.write.partitionBy(season).parquet(f"{folder}/hist", mode="errorifexists")
    median_spectra.write.parquet(f"{folder}/median_spectra", mode="errorifexists")
    window_stats.write.parquet(f"{folder}/window_stats", mode="errorifexists")


def events_wide_schema(bands: Sequence[str]) -> T.StructType:
    """One count per band, and their total over the detection bands."""
    counts = [*(f"n_{b}" for b in bands), "total_detection_events"]
    return T.StructType([T.StructField("scene_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in counts]])


def write_events(long: DataFrame, wide: DataFrame, folder: str, bands: Sequence[str]) -> None:
    """Both tables with their fixed columns and types; a table that differs stops the job before anything is written."""
    long, wide = require_schema(long, schemas.EVENTS_LONG), require_schema(wide, events_wide_schema(bands))
    long.write.parquet(f"{folder}/events_long", mode="errorifexists")
    wide.write.parquet(f"{folder}/events_wide", mode="errorifexists")


def write_ambient(ambient: DataFrame, path: str) -> None:
    refuse(ambient, {"null_level": F.col("ambient").isNull()}, empty="no ambient to write")
    ambient.write.parquet(path, mode="errorifexists")


def write_per_scene_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """One folder of detections per scene; rows of a scene are brought together first to avoid small files."""
    require_columns(df, fields).repartition("scene_id").write.partitionBy("scene_id").csv(path, header=True, mode="errorifexists")


def write_summaries(df: DataFrame, path: str) -> None:
    """One nested JSON document per scene."""
    df.repartition("scene_id").write.partitionBy("scene_id").json(path, mode="errorifexists")


def write_review(review: DataFrame, path: str) -> None:
    _text(require_schema(review, schemas.REVIEW)).write.csv(path, header=True, mode="errorifexists")


def write_ranked(scores: DataFrame, path: str) -> None:
    """A ranked list is as short as its limit, so one ordered file is right."""
    scores.coalesce(1).write.json(path, mode="errorifexists")
