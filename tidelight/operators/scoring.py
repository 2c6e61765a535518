"""A user's scorer applied tile by tile."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.operators.detections import suppress_overlaps
from tidelight.session import cut

Scorer = Callable[[pd.DataFrame], Iterable[tuple[float, float, float, float, float]]]


def score_tiles(pixels: DataFrame, scorer: Scorer, tile: bool = False) -> DataFrame:
    """Boxes (x1, y1, x2, y2, score) a scorer finds on each tile, moved back to scene pixels.

    ``pixels`` has scene_id, y0, x0 (tile start), row, col, valid and whatever the scorer reads.
    Tiles without a valid pixel never reach Python. A tile is bounded by its size. ``tile`` adds the tile's start and
    the number of the box in it (y0, x0, i).
    """
    kind = dict(pixels.dtypes)["scene_id"]
    alive = pixels.where("valid").select("scene_id", "y0", "x0").distinct()

    more = ["y0", "x0", "i"] if tile else []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y0"].iloc[0], pdf["x0"].iloc[0]
        rows = [(pdf["scene_id"].iloc[0], x1 + x0, y1 + y0, x2 + x0, y2 + y0, s, y0, x0, i) for i, (x1, y1, x2, y2, s) in enumerate(scorer(pdf))]
        return pd.DataFrame(rows, columns=["scene_id", "x1", "y1", "x2", "y2", "score", "y0", "x0", "i"])[["scene_id", "x1", "y1", "x2", "y2", "score", *more]]

    fields = ", ".join(["scene_id " + kind, *[f"{c} double" for c in ("x1", "y1", "x2", "y2", "score")], *[f"{c} bigint" for c in more]])
    return pixels.join(alive, ["scene_id", "y0", "x0"], "left_semi").groupBy("scene_id", "y0", "x0").applyInPandas(one, fields)


def _starts(place: Column, extent: Column, size: int, step: int) -> Column:
    """Starts of the overlapping tiles of ``size`` that hold a place; the last tile touches the edge."""
    edge = F.greatest(F.lit(0).cast("bigint"), extent.cast("bigint") - size)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((place - size + 1) / step))
    last = F.floor(F.least(place, edge) / step)
    regular = F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    return F.array_union(regular, F.when(place >= edge, F.array(edge)).otherwise(F.array().cast("array<bigint>")))


def halo_tiles(pixels: DataFrame, scenes: DataFrame, size: int, overlap: float) -> DataFrame:
    """Each pixel once for every tile that holds it (y0, x0); neighbouring tiles share ``overlap`` of their length.

    ``scenes``: scene_id, height, width. A pixel is in as many tiles as overlap there, whatever the raster's size.
    """
    step = max(1, round(size * (1.0 - overlap)))
    p = pixels.join(scenes.select("scene_id", "height", "width"), "scene_id")
    p = p.withColumn("y0", F.explode(_starts(F.col("row"), F.col("height"), size, step)))
    return p.withColumn("x0", F.explode(_starts(F.col("col"), F.col("width"), size, step))).drop("height", "width")


def score_overlapping(pixels: DataFrame, scenes: DataFrame, scorer: Scorer, size: int, overlap: float = 0.2, iou: float = fixed.NMS_IOU) -> DataFrame:
    """Boxes (scene_id, x1, y1, x2, y2, score) of a scorer over overlapping tiles, each object once.

    What several tiles find of one object overlaps in scene pixels: the best score stays (of equal scores that of the later tile) and
    suppresses what overlaps it by ``iou`` or more.
    """
    found = score_tiles(halo_tiles(pixels, scenes, size, overlap), lambda pdf: scorer(pdf), tile=True)
    side = 1 << 20  # tiles and boxes of a tile are fewer
    found = found.withColumn("box", (F.col("y0") * side + F.col("x0")) * side + F.col("i"))
    boxes = cut(found.select("scene_id", "box", "x1", "y1", "x2", "y2", "score"), "found")
    return suppress_overlaps(boxes, ["scene_id"], iou=iou, cell=float(size)).drop("box")
