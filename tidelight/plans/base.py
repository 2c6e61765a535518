"""Registry of runnable queries and the stand-in tables they read.

The driver's tables stand in for the archive: ``embeddings`` for frames and pixels, ``events`` for
level series and file intervals, ``lineitem`` and ``orders`` for detections and scenes. Each stand-in
exists twice, as a DataFrame and as the SQL text the oracle starts from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.functions.times import epoch_s, utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, floats: Sequence[str] = (), digits: int = 6):
    """Register a query under its function name, with the SQL that must give the same rows.

    ``floats`` are rounded on both sides; adding 0.0 turns -0.0 into 0.0.
    """

    def add(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(Tables(spark, sf))
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in floats}) if floats else df

        QUERIES[fn.__name__] = run
        if sql:
            fix = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats)
            ORACLE[fn.__name__] = f"SELECT * REPLACE ({fix}) FROM ({sql}) AS q" if fix else sql
        return fn

    return add


class Tables:
    """Stand-in tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # stamps without a zone are UTC
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def frames(self) -> DataFrame:
        """win (season and window), frame, levels."""
        to_level = F.transform("embedding", lambda x: (F.floor(x.cast("double") * 100) + 50).cast("int"))
        return self.raw("embeddings").select(F.col("label").alias("win"), F.col("vec_id").alias("frame"), to_level.alias("levels"))

    def series(self) -> DataFrame:
        """user_id (window), event_type (band), t in seconds, event_id, level."""
        e = self.raw("events")
        return e.select("user_id", "event_type", "event_id", utc(F.col("ts")).alias("at"), epoch_s(F.col("ts")).alias("t"),
                        F.floor(F.col("value") / 4).cast("int").alias("level"))

    def spans(self) -> DataFrame:
        """user_id, event_id, [start_utc, end_utc) of one to six hours."""
        e = self.raw("events")
        start = utc(F.col("ts"))
        return e.select("user_id", "event_id", "event_type", start.alias("start_utc"),
                        F.timestamp_micros(F.unix_micros(start) + (1 + F.col("event_id") % 6) * 3_600_000_000).alias("end_utc"))

    def windows(self, kind: str = "purchase", half_h: int = 2) -> DataFrame:
        """Windows around the events of one type."""
        e = self.raw("events").where(F.col("event_type") == kind)
        at = F.unix_micros(utc(F.col("ts")))
        return e.select("user_id", F.col("event_id").alias("scene_id"), utc(F.col("ts")).alias("acquired_utc"),
                        F.timestamp_micros(at - half_h * 3_600_000_000).alias("w_start"), F.timestamp_micros(at + half_h * 3_600_000_000).alias("w_end"))

    def marks(self) -> DataFrame:
        """Detections in metres: scene_id, id (unique inside a scene), side (A or B), x, y and attributes."""
        best = {c: F.min(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")}
        li = self.raw("lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(*best.values())
        return li.select(
            F.col("l_suppkey").alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.when(F.col("l_orderkey") % 3 == 0, "A").when(F.col("l_orderkey") % 3 == 1, "B").otherwise("C").alias("side"),
            (F.col("l_extendedprice") / 50).alias("x"), ((F.col("l_orderkey") % 2003) + F.col("l_linenumber") / 8).alias("y"),
            F.col("l_quantity").alias("length_m"), (F.col("l_quantity") / (1 + F.col("l_linenumber") % 4)).alias("width_m"),
            (1 - F.col("l_discount")).alias("score"), (F.col("l_tax") * 100).alias("fill"), (F.col("l_discount") * 300).alias("nir_snr"),
            F.year("l_shipdate").alias("year"), (F.lit(-125.3) + F.col("l_extendedprice") / 50 / 73_000).alias("lon"),
            (F.lit(48.8) + ((F.col("l_orderkey") % 2003) + F.col("l_linenumber") / 8) / 110_540).alias("lat"))

    def pixels(self) -> DataFrame:
        """64 x 64 rasters: scene_id, row, col, nir, green, red, valid, clear."""
        e = self.raw("embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
        v = F.col("v").cast("double")
        return e.select(
            F.floor(F.col("vec_id") / 64).alias("scene_id"), (F.col("vec_id") % 64).cast("int").alias("row"), "col",
            (F.floor(v * 100) + 50).cast("int").alias("nir"), (F.floor(v * v * 1000) + 20).cast("int").alias("green"),
            ((F.col("vec_id") * 7 + F.col("col") * 3) % 11 != 0).alias("valid"), ((F.col("vec_id") + 2 * F.col("col")) % 13 != 0).alias("clear"))

    def boxes(self) -> DataFrame:
        """One box per raster row: scene_id, box, x1, y1, x2, y2, score."""
        e = self.raw("embeddings")
        d = lambda i: F.col("embedding")[i].cast("double")
        x1, y1 = 28 + 60 * d(0), 28 + 60 * d(1)
        return e.select(F.floor(F.col("vec_id") / 64).alias("scene_id"), F.col("vec_id").alias("box"), x1.alias("x1"), y1.alias("y1"),
                        (x1 + 3 + F.floor(20 * F.abs(d(2)))).alias("x2"), (y1 + 3 + F.floor(20 * F.abs(d(3)))).alias("y2"), F.abs(d(4)).alias("score"))


# The same stand-ins as SQL.
FRAMES = """fr AS (SELECT label AS win, vec_id AS frame,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) + 50 AS INTEGER)) AS levels FROM embeddings)"""
CELLS = FRAMES + """, ce AS (SELECT win, frame, CAST(generate_subscripts(levels, 1) - 1 AS INTEGER) AS bin, unnest(levels) AS level FROM fr)"""
SERIES = """se AS (SELECT user_id, event_type, event_id, ts, epoch_us(ts) / 1e6 AS t, CAST(floor(value / 4) AS INTEGER) AS level FROM events)"""
SPANS = """sp AS (SELECT user_id, event_id, event_type, ts AS start_utc, ts + to_hours(CAST(1 + event_id % 6 AS INTEGER)) AS end_utc FROM events)"""
WINDOWS = """wi AS (SELECT user_id, event_id AS scene_id, ts AS acquired_utc, ts - INTERVAL 2 HOUR AS w_start, ts + INTERVAL 2 HOUR AS w_end
  FROM events WHERE event_type = 'purchase')"""
MARKS = """li1 AS (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount,
  min(l_tax) AS l_tax, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2, 3), mk AS (SELECT l_suppkey AS scene_id, l_orderkey * 10 + l_linenumber AS id,
  CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS side, l_extendedprice / 50 AS x,
  (l_orderkey % 2003) + l_linenumber / 8 AS y, l_quantity AS length_m, l_quantity / (1 + l_linenumber % 4) AS width_m, 1 - l_discount AS score,
  l_tax * 100 AS fill, l_discount * 300 AS nir_snr, year(l_shipdate) AS year, -125.3 + l_extendedprice / 50 / 73000 AS lon, 48.8 + ((l_orderkey % 2003) + l_linenumber / 8) / 110540 AS lat FROM li1)"""
PIXELS = """px AS (SELECT vec_id // 64 AS scene_id, CAST(vec_id % 64 AS INTEGER) AS row, col, CAST(floor(v * 100) + 50 AS INTEGER) AS nir,
  CAST(floor(v * v * 1000) + 20 AS INTEGER) AS green, (vec_id * 7 + col * 3) % 11 <> 0 AS valid, (vec_id + 2 * col) % 13 <> 0 AS clear
  FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
BOXES = """bx AS (SELECT vec_id // 64 AS scene_id, vec_id AS box, x1, y1, x1 + 3 + floor(20 * abs(c)) AS x2, y1 + 3 + floor(20 * abs(d)) AS y2, abs(e) AS score
  FROM (SELECT vec_id, 28 + 60 * CAST(embedding[1] AS DOUBLE) AS x1, 28 + 60 * CAST(embedding[2] AS DOUBLE) AS y1, CAST(embedding[3] AS DOUBLE) AS c,
  CAST(embedding[4] AS DOUBLE) AS d, CAST(embedding[5] AS DOUBLE) AS e FROM embeddings))"""
