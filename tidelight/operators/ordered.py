"""Order-dependent work on series of any length.

A plain window puts one whole series into one task. ``number_rows`` range-partitions all rows by
(series, order), numbers them with per-range offsets and cuts each series into blocks of equal
length; every later window runs per block and takes what came before from a small per-block
summary. Short and long series go the same way. NULL is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelight.session import cut

BLOCK_ROWS = 1_000_000  # rows per block of a series

RN, BLOCK = "_rn", "_block"


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the keys come from the left side."""
    names = {k: f"_on{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(other[n]) for k, n in names.items()]
    return left.join(other, on, how).drop(*names.values())


@dataclass(frozen=True)
class Ordered:
    """Rows numbered 0,1,2.. within each series and cut into blocks of ``block_rows``."""

    rows: DataFrame
    keys: tuple[str, ...]
    block_rows: int

    @property
    def parts(self) -> list[str]:
        return [*self.keys, BLOCK]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(RN)

    def with_columns(self, **columns: Column) -> Ordered:
        return replace(self, rows=self.rows.withColumns(columns))

    def prefix(self, **specs: tuple[str, Column]) -> Ordered:
        """Add aggregates over the rows strictly before each row: ``name=("sum"|"max"|"last", column)``.

        "last" is the latest non-null value. Sums start at 0, the others at NULL.
        """
        before = self.window().rowsBetween(Window.unboundedPreceding, -1)
        whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        local = {n: whole[how](c).over(before) for n, (how, c) in specs.items()}
        per_block = {
            "sum": F.sum,
            "max": F.max,
            "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(RN))),
        }
        earlier = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            self.rows.groupBy(*self.parts)
            .agg(*[per_block[how](c).alias(f"_c_{n}") for n, (how, c) in specs.items()])
            .select(
                *self.parts,
                *[whole[how](F.col(f"_c_{n}")).over(earlier).alias(f"_c_{n}") for n, (how, _) in specs.items()],
            )
            .where(F.col(BLOCK) > 0)
        )
        merge = {
            "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "max": F.greatest,
            "last": F.coalesce,
        }
        out = meet(self.rows.withColumns(local), carried, self.parts, "left")
        out = out.withColumns({n: merge[how](F.col(n), F.col(f"_c_{n}")) for n, (how, _) in specs.items()})
        out = out.drop(*[f"_c_{n}" for n in specs])
        sums = {n: F.coalesce(F.col(n), F.lit(0)) for n, (how, _) in specs.items() if how == "sum"}
        return replace(self, rows=out.withColumns(sums))

    def following(self, **columns: Column) -> Ordered:
        """Add the first non-null value of each column strictly after each row."""
        after = self.window().rowsBetween(1, Window.unboundedFollowing)
        later = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
        carried = self.rows.groupBy(*self.parts).agg(*[F.min_by(c, F.when(c.isNotNull(), F.col(RN))).alias(f"_c_{n}") for n, c in columns.items()])
        carried = carried.select(*self.parts, *[F.first(f"_c_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in columns])
        out = meet(self.rows.withColumns({n: F.first(c, ignorenulls=True).over(after) for n, c in columns.items()}), carried, self.parts, "left")
        return replace(self, rows=out.withColumns({n: F.coalesce(n, f"_c_{n}") for n in columns}).drop(*[f"_c_{n}" for n in columns]))

    def padded(self, before: int, after: int) -> DataFrame:
        """Blocks with copies of up to ``before``/``after`` rows beyond their edges; a row's own block is ``_home``."""
        size = max(self.block_rows, before, after)  # a neighbourhood reaches into the next block at most
        home = F.floor(F.col(RN) / size)
        spread = F.array_distinct(
            F.array(home, F.greatest(F.lit(0), F.floor((F.col(RN) - after) / size)), F.floor((F.col(RN) + before) / size))
        )
        return self.rows.withColumn(BLOCK, F.explode(spread)).withColumn("_home", home)

    def staged(self, before: int, after: int, *stages: dict) -> DataFrame:
        """Add columns computed from up to ``before``/``after`` neighbours, stage by stage.

        Each value is a function of a window ordered by row number; block edges are padded with
        copies of the neighbouring rows, which are dropped again. A stage may use the columns of those before it.
        """
        done, w = self.padded(before, after), Window.partitionBy(*self.keys, BLOCK).orderBy(RN)
        for columns in stages:
            done = done.withColumns({n: f(w) for n, f in columns.items()})
        return done.where(F.col(BLOCK) == F.col("_home")).drop("_home").withColumn(BLOCK, F.floor(F.col(RN) / self.block_rows))

    def centred(self, before: int, after: int, **columns) -> DataFrame:
        """``staged`` with one stage."""
        return self.staged(before, after, columns)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block_rows: int = BLOCK_ROWS) -> Ordered:
    """Number the rows of each series (``order`` must be unique per series)."""
    keys = tuple(keys)
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_seg", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # A series that begins in an earlier range continues in at most one way per range, so this
    # table has fewer rows than there are range partitions and is safe to broadcast.
    offsets = (
        ranged.groupBy(*keys, "_seg")
        .count()
        .withColumn("_offset", F.sum("count").over(earlier))
        .where("_offset > 0")
        .select(*keys, "_seg", "_offset")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)).cast("long") - 1
    numbered = meet(ranged.withColumn(RN, local), F.broadcast(offsets), [*keys, "_seg"], "left")
    numbered = numbered.withColumn(RN, F.col(RN) + F.coalesce("_offset", F.lit(0))).drop("_offset", "_seg")
    return Ordered(numbered.withColumn(BLOCK, F.floor(F.col(RN) / block_rows)), keys, block_rows)


def nearest_rows(points: DataFrame, frames: DataFrame, keys: Sequence[str], at: str, lane: str, lanes: Sequence, value: str, name: str, **limits: int) -> DataFrame:
    """``points`` with an array ``name``: for each of ``lanes`` the value of the frame nearest in time, the earlier one on ties.

    Points and frames of a key are numbered in one order; from there each point looks back and ahead in every lane.
    """
    got = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    p = points.select(*keys, F.col(at), F.lit(1).alias("_late"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(frames.schema[lane].dataType).alias("_lane"), F.lit(None).cast("struct<t:double,v:double>").alias("_got"))
    f = frames.select(*keys, F.col(at), F.lit(0).alias("_late"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), F.col(lane).alias("_lane"), got.cast("struct<t:double,v:double>").alias("_got"))
    o = number_rows(f.unionByName(p), keys, [at, "_late", F.hash("_point", "_lane"), F.hash("_got")], **limits)
    here = {i: F.when(F.col("_lane") == x, F.col("_got")) for i, x in enumerate(lanes)}
    o = o.prefix(**{f"_b{i}": ("last", c) for i, c in here.items()}).following(**{f"_a{i}": c for i, c in here.items()})
    t = F.col(at).cast("double")
    pick = [F.when(F.col(f"_a{i}").isNull() | (t - F.col(f"_b{i}.t") <= F.col(f"_a{i}.t") - t), F.col(f"_b{i}.v")).otherwise(F.col(f"_a{i}.v")) for i in here]
    return o.rows.where("_late = 1").select("_point.*", F.array(*pick).alias(name))


def centred_sum(value: Column, half: int):
    """Sum over ``half`` neighbours on both sides, missing neighbours counting as 0."""
    return lambda w: F.sum(value).over(w.rowsBetween(-half, half))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of an unbounded numeric column, one row per key.

    Equal values are counted first; ranks are then running counts, so no task ever holds all the
    distinct values of a key. For integer levels with a bounded range use ``percentile`` directly.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = number_rows(counted, keys, [value]).prefix(_below=("sum", F.col("_n")))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = meet(ordered.rows, totals, keys)
    def at(pos):  # value whose run of ranks [_below, _below + _n) holds the position
        return F.max(F.when((F.col("_below") <= pos) & (pos < F.col("_below") + F.col("_n")), F.col(value)))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    out = ranked.groupBy(*keys, "_total").agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)
