"""Hand-made and derived tables: scene lists, labels, counts, metadata, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight import schemas
from tidelight.functions.text import truthy
from tidelight.functions.times import HAS_OFFSET, parse_utc, require_offset
from tidelight.operators.guards import DataError, refuse


def read_text_csv(spark: SparkSession, path: str, required: Sequence[str], place: str | None = None) -> DataFrame:
    """CSV with every value as trimmed text and trimmed header names; blank values become NULL.

    ``place`` adds a column that orders rows as they lie in the files: file name, first byte of the block a task read, and
    a running number inside the block. It does not depend on how blocks are dealt to tasks.
    """
    raw = spark.read.option("header", "true").csv(path)
    texts = [F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))).alias(c.strip()) for c in raw.columns]
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    out = raw.select(*texts, *([at.alias(place)] if place else []))
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise DataError(f"{path}: missing columns {missing}")
    return out


def scenes(raw: DataFrame, ident: str = "id", at: str = "acquired") -> DataFrame:
    """Scene list ordered by time; every instant must state its UTC offset."""
    opt = lambda c, t: (F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c)
    return raw.select(F.col(ident).alias("scene_id"), require_offset(F.col(at)).alias("acquired_utc"),
                      opt("clear_percent", "double"), opt("instrument", "string")).orderBy("acquired_utc")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return scenes(read_text_csv(spark, path, ["id", "acquired"]))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels, the last row of a scene winning: of several files that of the greatest name, inside a file the lowest line.

    An absent file gives no rows, a bad row an error.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schemas.LABELS)
    placed = read_text_csv(spark, path, ["scene_id", "acquired_utc", "area_km2"], "_place")
    raw = placed.drop("_place")
    refuse(raw, {
        "empty_scene_id": F.col("scene_id").isNull(), "no_utc_offset": ~F.coalesce(F.col("acquired_utc").rlike(HAS_OFFSET), F.lit(False)),
        "no_area": F.col("area_km2").isNull(), "bad_area": F.col("area_km2").isNotNull() & F.col("area_km2").try_cast("double").isNull()})
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in raw.columns and f.name != "acquired_utc" else
            (parse_utc(F.col("acquired_utc")).alias(f.name) if f.name == "acquired_utc" else F.lit(None).cast(f.dataType).alias(f.name))
            for f in schemas.LABELS]
    last = placed.groupBy("scene_id").agg(F.max_by(F.struct(*cols), "_place").alias("_l"))
    return last.select("_l.*")


def read_manual_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts per 13-character instant: rows without a key are skipped, a blank count is an error."""
    raw = read_text_csv(spark, path, ["timestamp", "vessel count"]).where("timestamp IS NOT NULL")
    refuse(raw, {"blank_count": F.col("`vessel count`").isNull()})
    return raw.select("timestamp", F.col("`vessel count`").cast("int").alias("vessel_count"))


def deployments(raw: DataFrame, device: str, study_end: str) -> DataFrame:
    """(deployment_id, start_utc, end_utc) by start; a missing end means the end of the study."""
    begin = parse_utc(F.coalesce(*[F.col(c) for c in ("begin", "dateFrom") if c in raw.columns]))
    end = F.coalesce(parse_utc(F.coalesce(*[F.col(c) for c in ("end", "dateTo") if c in raw.columns])), parse_utc(F.lit(study_end)))
    code = F.coalesce(*[F.col(c) for c in ("locationCode", "code") if c in raw.columns])
    stamp = F.date_format(begin, "yyyyMMdd'T'HHmmss'Z'")
    out = raw.select(F.concat(F.lit(f"{device}@"), code, F.lit(":"), stamp).alias("deployment_id"), begin.alias("start_utc"), end.alias("end_utc"))
    refuse(out, {"no_begin": F.col("start_utc").isNull(), "empty_or_reversed": F.col("end_utc") <= F.col("start_utc")}, empty="no deployments")
    return out.orderBy("start_utc")


def read_deployments(spark: SparkSession, path: str, device: str, study_end: str) -> DataFrame:
    return deployments(spark.read.json(path), device, study_end)


SEARCH_SCHEMA = (
    "id string, properties struct<acquired:string,cloud_cover:double,clear_percent:double,instrument:string,sun_elevation:double,"
    "sun_azimuth:double,view_angle:double,satellite_azimuth:double>, _links struct<thumbnail:string,tiles:string>, "
    "geometry struct<type:string,coordinates:array<array<array<double>>>>")


def search_results(items: DataFrame) -> DataFrame:
    """Nested search results -> flat scene rows with date and year."""
    p = items.select("id", "properties.*", F.col("_links.thumbnail").alias("thumbnail"), F.col("_links.tiles").alias("tiles_link"), "geometry")
    p = p.withColumn("acquired", parse_utc(F.col("acquired"))).withColumnRenamed("satellite_azimuth", "sat_azimuth")
    return p.withColumn("date", F.to_date("acquired")).withColumn("year", F.year("acquired"))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return search_results(spark.read.schema(SEARCH_SCHEMA).option("multiLine", "true").json(path))


def uptime_from_text(raw: DataFrame) -> DataFrame:
    return raw.select(parse_utc(F.col("start_utc")).alias("start_utc"), parse_utc(F.col("end_utc")).alias("end_utc"),
                      truthy(F.col("available")).alias("available"), F.coalesce("deployment_id", F.lit("")).alias("deployment_id"))


def read_uptime(spark: SparkSession, path: str) -> DataFrame:
    return uptime_from_text(read_text_csv(spark, path, ["start_utc", "end_utc", "available"]))


def read_box_cache(spark: SparkSession, path: str, asset: str, geometry: str, need: Sequence[str] = ()) -> DataFrame:
    """Cached boxes of one asset and geometry (partition columns). Absent evidence columns stay absent."""
    df = spark.read.parquet(path).where((F.col("asset") == asset) & (F.col("geom") == geometry))
    lost = [c for c in need if c not in df.columns]
    if lost:
        raise DataError(f"the cache has no {lost}")
    return df


def check_swept_confidence(lowest: float, cached_floor: float) -> None:
    """A sweep below the confidence the boxes were cached at would silently miss boxes."""
    if lowest < cached_floor:
        raise DataError(f"confidence {lowest} lies below the cached floor {cached_floor}")


def read_population(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("hist", "median_spectra", "window_stats")}


def season_frames(spark: SparkSession, path: str, start: Column, end: Column) -> DataFrame:
    """Frames between two instants from a date-partitioned table.

    Files are stored under the date they start on, so the lower edge reaches one file further back.
    """
    from tidelight import fixed

    pad = start - F.make_dt_interval(secs=F.lit(float(fixed.FILE_SECONDS)))
    df = spark.read.parquet(path)
    return df.where((F.col("date") >= F.to_date(pad)) & (F.col("date") <= F.to_date(end))
                    & (F.col("t_utc_s") >= F.unix_micros(start) / 1e6) & (F.col("t_utc_s") < F.unix_micros(end) / 1e6))
