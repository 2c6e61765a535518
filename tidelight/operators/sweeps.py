"""Sweeps of filter settings over two assets at once, with persistence and fused counts.

A setting is a bit. A box carries the settings it passes as bits of a few longs, so that one pass over boxes, cells and
pairs answers all settings: years of a cell are counted bit by bit with carries, and the greedy pairing of two assets runs
for all settings together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.functions.geo import grid_cell
from tidelight.operators.detections import near_pairs_any_radius
from tidelight.operators.ordered import meet
from tidelight.session import cut, release

BITS = 63  # settings of one long


def _words(passes: Sequence[Column | dict[tuple, Column]]) -> list[Column]:
    """Longs whose bits tell which settings pass; a condition that is NULL does not hold.

    Settings given as conditions by rule and value share them: each is evaluated once and takes the bits of all settings that ask for it.
    The code Spark generates for a row stays short, which the Java compiler needs.
    """
    out = []
    for i in range(0, len(passes), BITS):
        asked: dict[tuple, list] = {}
        for k, p in enumerate(passes[i : i + BITS]):
            for key, c in (p if isinstance(p, dict) else {("setting", k): p}).items():
                asked.setdefault(key, [c, 0])[1] |= 1 << k
        word = F.lit((1 << len(passes[i : i + BITS])) - 1).cast("long")
        for c, bits in asked.values():
            word = word.bitwiseAND(F.when(c, F.lit(-1).cast("long")).otherwise(F.lit(~bits).cast("long")))
        out.append(word)
    return out


def _any(names: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in names:
        cond = cond | (F.col(n) != 0)
    return cond


def _counted(df: DataFrame, keys: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
    """keys, counts: of every setting the rows that have its bit. Rows of equal bits, few kinds a key, are counted first."""
    kinds = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    flags = F.array(*[F.getbit(F.col(names[k // BITS]), F.lit(k % BITS)) * F.col("_n").cast("double") for k in range(n)])
    sums = kinds.groupBy(*keys).agg(Summarizer.sum(array_to_vector(flags)).alias("v"))
    return sums.select(*keys, F.transform(vector_to_array("v"), lambda x: F.round(x).cast("long")).alias("counts"))


def _without_persistent(boxes: DataFrame, names: Sequence[str], least: int) -> DataFrame:
    """Take a setting's bit from boxes in cells where boxes of that setting were seen in ``least`` or more years."""
    if not least:
        return boxes
    clat, clon = grid_cell(F.col("lat"), F.col("lon"))
    b = boxes.withColumns({"_clat": clat, "_clon": clon})
    at = ["side", "_clat", "_clon"]
    years = b.groupBy(*at, "year").agg(*[F.bit_or(n).alias(n) for n in names])
    per = years.groupBy(*at).agg(*[F.collect_list(n).alias(n) for n in names])  # as many entries as there are years
    zero = F.array_repeat(F.lit(0).cast("long"), least)
    # the k-th entry has the bits seen in more than k years; a new year pushes them on
    add = lambda s, m: F.transform(s, lambda x, k: x.bitwiseOR(m.bitwiseAND(F.when(k == 0, F.lit(-1).cast("long")).otherwise(F.get(s, k - 1)))))
    full = per.select(*at, *[F.element_at(F.aggregate(n, zero, add), -1).alias(f"_full_{n}") for n in names])
    out = meet(b, full, at, "left")
    return out.withColumns({n: F.col(n).bitwiseAND(F.bitwise_not(F.col(f"_full_{n}"))) for n in names}).select(*boxes.columns)


def matched_bits(pairs: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Pairs (a, b, d and the bits of the settings both pass) with the bits of the settings in which they are matched.

    For every bit the matching is the greedy pass by distance (ids break ties). Each round accepts, bit by bit, the pairs that are the
    first open pair of both sides, and closes these sides for the bit.
    """
    by, order = [*keys], ["d", "a", "b"]
    open_, done = cut(pairs.select(*by, *order, *names).where(_any(names)), "pairs"), None
    zero = F.lit(0).cast("long")
    while True:
        ahead = lambda side, n: F.coalesce(F.bit_or(n).over(Window.partitionBy(*by, side).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), zero)
        free = open_.withColumns({f"_t{n}": F.col(n).bitwiseAND(F.bitwise_not(ahead("a", n).bitwiseOR(ahead("b", n)))) for n in names})
        taken = lambda side, n: F.bit_or(f"_t{n}").over(Window.partitionBy(*by, side))
        rest = free.withColumns({f"_n{n}": F.col(n).bitwiseAND(F.bitwise_not(taken("a", n).bitwiseOR(taken("b", n)))) for n in names})
        step = cut(rest, "pairs")
        hit = step.where(_any([f"_t{n}" for n in names])).select(*by, *order, *[F.col(f"_t{n}").alias(n) for n in names])
        done = hit if done is None else done.unionByName(hit)
        before, open_ = open_, step.where(_any([f"_n{n}" for n in names])).select(*by, *order, *[F.col(f"_n{n}").alias(n) for n in names])
        release(before)
        if open_.isEmpty():
            return done


def sweep_assets(boxes: DataFrame, scene: str, configs: Sequence[dict], keep: Callable[[dict, str], Column | dict[tuple, Column]], tol_m: float,
                 persist: Sequence[int] = (0,), once: Callable[[dict], bool] = lambda c: True) -> DataFrame:
    """(config, persist, asset, scene, pred) of every setting, persistence and asset.

    ``boxes``: scene, side ("A" or "B"), id (unique inside a side of a scene), x, y in metres, lat, lon, year and what ``keep`` asks for; ``keep(config, side)`` tells
    whether a box of a side passes, as one condition or as conditions by rule and value. Assets: "A" and "B" count a side's boxes in the scenes that have that side, and only for settings with ``once``, which
    tells settings apart that differ in the other side alone; "both" counts the pairs within ``tol_m`` in scenes that have both sides, "any" the boxes
    of both sides less the pairs. Zeros are included.
    """
    n, ids = len(configs), [c["config"] for c in configs]
    names = [f"_m{i}" for i in range(-(-n // BITS))]
    words = {s: _words([keep(c, s) for c in configs]) for s in "AB"}
    masks = {name: F.when(F.col("side") == "A", a).otherwise(b) for name, a, b in zip(names, words["A"], words["B"], strict=True)}
    b = boxes.where(F.col("side").isin("A", "B"))
    marked = cut(b.withColumns(masks).select(scene, "side", "id", "x", "y", "lat", "lon", "year", *names), "marked")
    scenes = marked.groupBy(scene).agg(F.max(F.col("side") == "A").alias("has_a"), F.max(F.col("side") == "B").alias("has_b"))
    passed = marked.where(_any(names))
    out = None
    for least in persist:
        left = passed if not least else cut(_without_persistent(passed, names, least).where(_any(names)), "passed")
        counts = _counted(left, [scene, "side"], names, n)
        side = lambda s, p: left.where(F.col("side") == s).select(scene, F.col("id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), *[F.col(m).alias(f"{p}{m}") for m in names])  # noqa: E731, B023
        # In cells four times as wide as the tolerance a box needs about two copies, not nine; the rim of 1e-9 is for rounding.
        reach = side("A", "a").withColumn("radius", F.lit(tol_m * (1 + 1e-9)))
        near = near_pairs_any_radius(reach, side("B", "b"), [scene], 4.0 * tol_m).where(F.col("d") <= tol_m)
        near = near.select(scene, "a", "b", "d", *[F.col(f"a{m}").bitwiseAND(F.col(f"b{m}")).alias(m) for m in names])
        both = _counted(matched_bits(near, [scene], names), [scene], names, n)
        all_ = scenes
        for got, name in ((counts.where("side = 'A'").drop("side"), "n_a"), (counts.where("side = 'B'").drop("side"), "n_b"), (both, "n_both")):
            all_ = meet(all_, got.withColumnRenamed("counts", name), [scene], "left")
        at = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(0))
        fused = F.col("has_a") & F.col("has_b")
        rows = []
        for k, c in enumerate(configs):
            single = F.lit(once(c))
            for asset, holds, pred in (("A", F.col("has_a") & single, at("n_a", k)), ("B", F.col("has_b") & single, at("n_b", k)), ("both", fused, at("n_both", k)),
                                       ("any", fused, at("n_a", k) + at("n_b", k) - at("n_both", k))):
                rows.append(F.when(holds, F.struct(F.lit(ids[k]).alias("config"), F.lit(least).alias("persist"), F.lit(asset).alias("asset"), pred.alias("pred"))))
        part = all_.select(F.col(scene).alias("scene"), F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.config", "r.persist", "r.asset", "scene", "r.pred")
        out = part if out is None else out.unionByName(part)
    return out
