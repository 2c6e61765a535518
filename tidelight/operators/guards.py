"""Checks that stop a job or count what they reject; nothing is dropped in silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataError(ValueError):
    """Input breaks a stated rule."""


def require_columns(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exactly these columns, in this order; names both missing and extra ones otherwise."""
    missing, extra = column_difference(df.columns, fields)
    if missing or extra:
        raise DataError(f"columns differ: missing {missing}, extra {extra}")
    return df.select(*fields)


def column_difference(have: Sequence[str], want: Sequence[str]) -> tuple[list[str], list[str]]:
    return [c for c in want if c not in have], [c for c in have if c not in want]


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    out = require_columns(df, schema.fieldNames())
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def refuse(df: DataFrame, reasons: dict[str, Column], empty: str | None = None) -> DataFrame:
    """Raise when any row matches a reason, naming the reasons and how many rows match each."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(c).alias(n) for n, c in reasons.items()]
    found = df.agg(*aggs).first().asDict()
    if empty and found["_rows"] == 0:
        raise DataError(empty)
    bad = {n: found[n] for n in reasons if found[n]}
    if bad:
        raise DataError(f"rejected rows: {bad}")
    return df


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first rule a row breaks. A NULL test does not count as broken."""
    out = F
    for name, test in rules:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def tally(df: DataFrame, column: str, name: str = "n_rows") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def row_guard(ok: Column, message: str, value: Column) -> Column:
    """``value`` where ``ok`` holds; otherwise the job fails with ``message`` when the row is read."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def refuse_inside(target: str, protected: str) -> str:
    """Refuse an output folder inside the read-only input tree."""
    import os

    def norm(p: str) -> str:
        return os.path.normpath(p if "://" in p else os.path.abspath(p))

    t, p = norm(target), norm(protected)
    if t == p or t.startswith(p.rstrip("/") + "/"):
        raise DataError(f"{target} lies inside the read-only tree {protected}")
    return target


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    a = left.select(*on).distinct()
    b = right.select(*on).distinct()
    return (
        a.join(b, list(on), "left_anti").withColumn("side", F.lit("left"))
        .unionByName(b.join(a, list(on), "left_anti").withColumn("side", F.lit("right")))
    )


def require_matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    counts = {r["side"]: r["n"] for r in unmatched(left, right, on).groupBy("side").agg(F.count("*").alias("n")).collect()}
    if counts:
        raise DataError(f"keys without a partner: {counts}")
