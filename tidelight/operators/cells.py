"""Greedy suppression of overlapping boxes in cells that adapt to where the boxes are.

A scene of few boxes is one cell. The cells of a larger scene are split eight by eight, again and again, while they hold more than
``most`` boxes; a box goes to every final cell it touches, so two boxes that overlap share one. Cells are swept by
priority, each box against those kept before it, which are few where boxes crowd. Pairs are never listed.

Three things stay open in a sweep: a box that touches several cells counts as kept once it is free in all of them, what such a box overlaps waits
for it, and of a crowd in the smallest cell only the ``most`` boxes of highest priority are swept, after which what they
suppress leaves. Open boxes are swept again; the foremost of them is always decided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.operators.ordered import meet
from tidelight.session import cut, release

SPLIT, DEPTH = 8, 5
LEAF = ["lv", "cx", "cy"]
_BOX = ["x1", "y1", "x2", "y2"]


def _side(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(SPLIT), level)


def crowded(boxes: DataFrame, keys: Sequence[str], cell: float, most: int) -> DataFrame:
    """keys, lv, cx, cy of the cells with more than ``most`` box centres, in scenes with more than ``most`` boxes.

    ``lv`` 0 are the smallest cells, of length ``cell``; a cell of the next level holds eight by eight of them.
    """
    many = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n")
    at = {c: F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / 2 / cell) for c, a in (("cx", "x"), ("cy", "y"))}
    small = meet(boxes, many, keys, "left_semi").select(*keys, *[v.alias(c) for c, v in at.items()]).groupBy(*keys, "cx", "cy").count()
    width = F.pow(F.lit(SPLIT), F.col("lv")).cast("long")
    levels = small.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).select(
        *keys, "lv", F.floor(F.col("cx") / width).alias("cx"), F.floor(F.col("cy") / width).alias("cy"), "count")
    return levels.groupBy(*keys, *LEAF).agg(F.sum("count").alias("n")).where(F.col("n") > most).drop("n")


def spread(boxes: DataFrame, keys: Sequence[str], cell: float, most: int) -> DataFrame:
    """The boxes once per final cell they touch (lv, cx, cy), and whether that cell holds all of a box (``alone``)."""
    hot = cut(crowded(boxes, keys, cell, most), "crowded")
    whole = boxes.withColumns({"lv": F.lit(DEPTH + 1), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
    if hot.isEmpty():
        return whole.withColumn("alone", F.lit(True))

    def touched(level: Column, x: Column | None = None, y: Column | None = None) -> Column:
        """Cells of a level that a box touches, inside the cell x, y of the next level if that is given."""
        s = _side(level, cell)
        def span(a: str, parent: Column | None) -> Column:
            lo, hi = F.floor(F.col(f"{a}1") / s), F.floor(F.col(f"{a}2") / s)
            return F.sequence(lo, hi) if parent is None else F.sequence(F.greatest(lo, parent * SPLIT), F.least(hi, parent * SPLIT + SPLIT - 1))
        return F.flatten(F.transform(span("x", x), lambda i: F.transform(span("y", y), lambda j: F.struct(level.cast("int").alias("lv"), i.alias("cx"), j.alias("cy")))))

    scenes = hot.select(*keys).distinct().withColumn("_hot", F.lit(True))
    mine = [c for c in boxes.columns]
    rows = meet(whole, scenes, keys, "left")
    stay = F.array(F.struct(F.col("lv").cast("int").alias("lv"), "cx", "cy"))
    rows = rows.select(*mine, F.inline(F.when(F.col("_hot"), touched(F.lit(DEPTH))).otherwise(stay)))
    for level in range(DEPTH, 0, -1):
        flags = hot.where(F.col("lv") == level).withColumn("_hot", F.lit(True))
        rows = meet(rows, flags, [*keys, *LEAF], "left")
        rows = rows.select(*mine, F.inline(F.when(F.col("_hot"), touched(F.lit(level - 1), F.col("cx"), F.col("cy"))).otherwise(stay)))
    inside = [F.floor(F.col(f"{a}{k}") / _side(F.col("lv"), cell)) == F.col(c) for a, c in (("x", "cx"), ("y", "cy")) for k in (1, 2)]
    return rows.withColumn("alone", (F.col("lv") > DEPTH) | (inside[0] & inside[1] & inside[2] & inside[3]))


def overlap(p: Column, q: Column) -> Column:
    """Intersection over union of two structs x1, y1, x2, y2."""
    w = F.greatest(F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"]), F.lit(0.0))
    h = F.greatest(F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"]), F.lit(0.0))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return w * h / (area(p) + area(q) - w * h + 1e-9)


def suppress(boxes: DataFrame, keys: Sequence[str], ident: str, rank: Sequence[str], iou: float, cell: float = 32.0, most: int = 256) -> DataFrame:
    """The boxes (keys, ``ident``, x1, y1, x2, y2) that a greedy pass keeps.

    In the order of ``rank`` (columns, smallest first, unique inside a scene) a box stays unless a kept one overlaps it by ``iou`` or more.
    """
    by, leaf, names = [*keys], [*keys, *LEAF], boxes.columns
    corners = F.struct(*[F.col(c).cast("double").alias(c) for c in _BOX])
    shape = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    kind = boxes.schema[ident].dataType.simpleString()
    none = {"kept": F.array().cast(shape), "open": F.array().cast(shape), "free": F.array().cast(f"array<{kind}>"), "lost": F.array().cast(f"array<{kind}>")}

    def step(s: Column, x: Column) -> Column:
        hit = lambda c: F.exists(s[c], lambda b: overlap(b, x["at"]) >= iou)
        add = lambda c, yes, what: F.when(yes, F.concat(s[c], F.array(what))).otherwise(s[c]).alias(c)
        lost = hit("kept")
        free = ~lost & ~hit("open")
        return F.struct(add("kept", free & x["alone"], x["at"]), add("open", ~lost & ~(free & x["alone"]), x["at"]), add("free", free, x["id"]), add("lost", lost, x["id"]))

    rows, kept = cut(spread(boxes, by, cell, most), "cells"), None
    while True:
        place = F.row_number().over(Window.partitionBy(*leaf).orderBy(*rank))
        seen = rows.withColumn("_p", place).where(F.col("_p") <= most)
        swept = seen.groupBy(*leaf).agg(F.array_sort(F.collect_list(F.struct("_p", F.col(ident).alias("id"), corners.alias("at"), "alone"))).alias("e"))
        swept = swept.select(*leaf, F.aggregate("e", F.struct(*[c.alias(n) for n, c in none.items()]), step).alias("s"))
        verdict = swept.select(*by, F.explode(F.concat(
            F.transform("s.free", lambda i: F.struct(i.alias(ident), F.lit(1).alias("free"), F.lit(0).alias("lost"))),
            F.transform("s.lost", lambda i: F.struct(i.alias(ident), F.lit(0).alias("free"), F.lit(1).alias("lost"))))).alias("v"))
        votes = verdict.groupBy(*by, f"v.{ident}").agg(F.sum("v.free").alias("_free"), F.max("v.lost").alias("_lost"))
        cells = rows.groupBy(*by, ident).agg(F.count(F.lit(1)).alias("_cells"), F.first(F.struct(*[c for c in names if c not in (*by, ident)])).alias("_row"))
        state = cut(meet(cells, votes, [*by, ident], "left").select(
            *by, ident, "_row", (F.coalesce(F.col("_free") == F.col("_cells"), F.lit(False))).alias("_kept"), F.coalesce(F.col("_lost") == 1, F.lit(False)).alias("_gone")), "suppressed")
        done = state.where("_kept").select(*[F.col(c) if c in (*by, ident) else F.col(f"_row.{c}").alias(c) for c in names])
        kept = done if kept is None else kept.unionByName(done)
        if state.where("NOT _kept AND NOT _gone").isEmpty():
            return kept
        # what is open goes on, unless a box that has just been kept suppresses it
        still = meet(rows, state.select(*by, ident, "_kept", "_gone"), [*by, ident])
        here = still.where("_kept").groupBy(*leaf).agg(F.collect_list(corners).alias("_k"))
        rest = meet(still.where("NOT _kept AND NOT _gone").drop("_kept", "_gone"), here, leaf, "left")
        hit = F.coalesce(F.exists("_k", lambda b: overlap(b, corners) >= iou), F.lit(False))
        gone = rest.where(hit).select(*by, ident).distinct()
        new = cut(meet(rest.drop("_k"), gone, [*by, ident], "left_anti"), "cells")
        release(rows)
        rows = new
