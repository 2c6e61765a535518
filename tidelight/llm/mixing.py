"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

A document's rate says how many copies of it the mix wants. Among all rates that meet the word targets
of the sources, entropy balancing takes the ones closest to 1, closeness being relative entropy with each
word counted once. The optimum is exponentially tilted, rate = exp(dual of the source), and the dual
maximises ``target * x - words * exp(x)`` for every source; ``duals`` climbs it by Newton steps on one row
per source. ``take`` rounds rates into copies so that every source comes within a document of its target.

Defined cases: a null text has size 0, and documents of size 0 are taken 0 words. A null source is a
source of its own, ordered last. Rows that repeat (same doc_id, same text) are taken alike,
and the order of rounding is one of content alone, so reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.session import cut

#: No document may give more than so many times its size, no source more than so many times its words.
MOST = 2
#: Newton steps. The error of the dual squares with each; from 0 to ln 2 six steps reach double precision, and to strong thinning each step moves by about one.
STEPS = 24
#: Cells of the rounding order that one pass tells apart, and passes: documents beyond 4096^3 per source share a cell.
CELLS, PASSES = 4096, 3
#: Single documents exchanged after rounding, largest remainder first.
REPAIRS = 6


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but the space and the characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_of() -> Column:
    """A row's place in the random order, from its doc_id and text alone."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")), F.lit("mix")), 1)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every row, and a number that orders rows at random but repeatably."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw_of().alias("draw"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = MOST) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt by weight, no source above ``most`` times its own.

    ``weights`` repeat over the sources in code point order, null last. Sources that would be above their limit
    stop at it and the rest is dealt again by weight. That ends at one level c with target = min(limit, c * weight):
    in the order of limit/weight, the first sources stop at their limits.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(by_name) - 1  # one row per source
    source = source.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int")).alias("weight"))
    limit = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    source = source.select(
        "*", limit.alias("limit"),
        (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"), F.row_number().over(order).alias("place"),
    )
    level = F.col("left") / F.col("open_weight")  # the level if this source and all after it are below their limits
    first = F.min(F.when(level * F.col("weight") <= F.col("limit"), F.struct("place", level.alias("level")))).over(all_rows)
    source = source.select("*", first["level"].alias("level"))
    return source.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def duals(targets: DataFrame, steps: int = STEPS) -> DataFrame:
    """Adds ``dual``, the multiplier of each source's word constraint.

    One Newton step: the gradient is target - words * exp(x), the curvature words * exp(x). A source
    without words or target has dual null (rate 0).
    """
    x: Column = F.lit(0.0)
    frame = targets.select("*", F.when((F.col("source_size") > 0) & (F.col("target") > 0), x).alias("dual"))
    step = F.col("dual") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("target") / (F.col("source_size") * F.exp("dual")) - 1))
    names = targets.columns
    for _ in range(steps):
        frame = frame.select(*names, step.alias("dual"))
    return frame


def balanced(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``sizes`` with source_size, target and rate."""
    solved = duals(targets).select(F.col("source").alias("of"), "source_size", "target", F.coalesce(F.exp("dual"), F.lit(0.0)).alias("rate"))
    return sizes.join(solved, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def take(rates: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, draw, taken: rates rounded down or up to whole copies.

    Within a source, documents are rounded up in random order until the next would pass the target. The
    place where that happens is found by counting, in ``PASSES`` passes over ever finer cells of the order,
    so no source is sorted or gathered. What is then missing is made up by single documents: ``REPAIRS``
    times, the largest size that fits is rounded up once.
    """
    base = F.floor(F.col("rate") + F.lit(1e-9)).cast("long")
    rows = cut(rates.select(
        "*", base.alias("base"), (F.ceil(F.col("rate") - F.lit(1e-9)).cast("long") > base).alias("open"),
        F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"),
    ), "mix")
    by = ["key", "none"]
    state = rows.groupBy(*by).agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need"))
    state = cut(state.select("*", F.lit(0).cast("long").alias("bound")), "mix")  # open rows with draw < bound are rounded up
    bits, width = CELLS.bit_length() - 1, 63
    for _ in range(PASSES):
        above, width = width, width - bits
        stretch = F.shiftright("draw", above) == F.shiftright("bound", above) if above < 63 else F.lit(True)
        cells = rows.filter("open").join(state, by).filter((F.col("draw") >= F.col("bound")) & stretch)
        cells = cells.groupBy(*by, "need", F.shiftright("draw", width).alias("cell")).agg(F.sum("size").alias("words"))
        cells = cells.select("*", F.sum("words").over(Window.partitionBy(*by).orderBy("cell")).alias("run"))  # at most CELLS rows a source
        edge = cells.groupBy(*by).agg(
            F.coalesce(F.min(F.when(F.col("run") > F.col("need"), F.col("cell"))), F.max("cell") + 1).alias("edge"),
            F.coalesce(F.max(F.when(F.col("run") <= F.col("need"), F.col("run"))), F.lit(0)).alias("filled"),
        )
        state = cut(state.join(edge, by, "left").select(
            *by, (F.col("need") - F.coalesce("filled", F.lit(0))).alias("need"),
            F.coalesce(F.shiftleft(F.least("edge", F.lit(2 ** (63 - width) - 1)), width), "bound").alias("bound"),
        ), "mix")
    spare = rows.filter("open").join(state, by).filter((F.col("draw") >= F.col("bound")) & (F.col("size") > 0) & (F.col("size") <= F.col("need")))
    spare = spare.groupBy(*by, "draw").agg(F.sum("size").alias("words"))  # equal rows go together
    spare = cut(spare.groupBy(*by, "words").agg(F.min("draw").alias("draw")), "mix")
    need, picked = state.select(*by, "need"), None
    for _ in range(REPAIRS):
        last = need
        pick = spare.join(last, by).filter(F.col("words") <= F.col("need"))
        if picked is not None:
            pick = pick.join(picked, [*by, "words"], "left_anti")
        pick = pick.groupBy(*by).agg(F.max("words").alias("words"), F.max_by("draw", "words").alias("draw"))
        picked = cut(pick if picked is None else picked.unionByName(pick), "mix")
        given = picked.groupBy(*by).agg(F.sum("words").alias("given"))
        need = state.join(given, by, "left").select(*by, (F.col("need") - F.coalesce("given", F.lit(0))).alias("need"))
    chosen = picked.select(*by, "draw", F.lit(1).alias("chosen"))
    out = rows.join(state.select(*by, "bound"), by).join(chosen, [*by, "draw"], "left")
    up = (F.col("open") & ((F.col("draw") < F.col("bound")) | F.col("chosen").isNotNull())).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "draw", ((F.col("base") + up) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, draw, taken of every document of the mix."""
    sizes = cut(sized(docs), "mix")
    return take(balanced(sizes, source_targets(sizes, weights, share)))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The mix itself: rows of ``docs`` that are taken, with ``copies``, how often. (A column of that name gives way.)"""
    docs = docs.drop("copies")
    sizes = cut(sized(docs), "mix")
    taken = take(balanced(sizes, source_targets(sizes, weights, share))).filter("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_of"), F.col("draw").alias("_draw"), (F.col("taken") / F.col("size")).cast("int").alias("copies")).distinct()
    out = docs.withColumn("_own", draw_of()).join(taken, (F.col("_own") == F.col("_draw")) & F.col("doc_id").eqNullSafe(F.col("_of")))
    return out.select(*docs.columns, "copies")
