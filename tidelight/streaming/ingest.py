"""Resumable ingest and running population counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelight import fixed
from tidelight.sources.files import GLOB, decode, frames_of

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, landing: str, out: str, device: str, checkpoint: str, max_files: int = 1000, **grid) -> StreamingQuery:
    """Decode files that were not seen before and stop; running it again continues where it ended.

    Each batch lands in its own ``batch=`` folder and overwrites it, so a repeated batch adds nothing.
    """
    src = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", GLOB)
           .option("maxFilesPerTrigger", max_files).load(landing))

    def store(batch: DataFrame, batch_id: int) -> None:
        raw = f"{out}/decoded/batch={batch_id}"
        decode(batch.select("path", "content"), device, **grid).write.parquet(raw, mode="overwrite")
        done = spark.read.parquet(raw)
        frames_of(done, device).write.parquet(f"{out}/frames/batch={batch_id}", mode="overwrite")
        seen = done.groupBy("path").agg(F.max("reason").alias("reason"))
        seen.select("path", F.when(F.col("reason").isNull(), "present").otherwise("error").alias("status"), "reason").write.parquet(
            f"{out}/retrievals/batch={batch_id}", mode="overwrite")

    return src.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_histogram(frames: DataFrame, season: str, axis_max: int = fixed.LEVEL_AXIS_MAX) -> DataFrame:
    """Counts per (season, bin, level) of a stream of frames. The key space is finite, so no watermark is needed."""
    c = frames.select(season, F.posexplode("levels").alias("bin", "level"))
    held = F.least(F.greatest(F.col("level"), F.lit(0)), F.lit(axis_max - 1)).cast("int")
    return c.groupBy(season, "bin", held.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def partial_histogram(frames: DataFrame, season: str, batch: int, axis_max: int = fixed.LEVEL_AXIS_MAX) -> DataFrame:
    return running_histogram(frames, season, axis_max).withColumn("batch", F.lit(batch))


def sum_partials(partials: DataFrame, season: str) -> DataFrame:
    """Mergeable counters of several batches, summed."""
    return partials.groupBy(season, "bin", "level").agg(F.sum("n").alias("n"))
