"""Greedy choices and connected components as rounds over tables.

A greedy pass in priority order keeps an item unless an earlier kept item conflicts with it. The
same set results from rounds: keep every item without an undecided rival of higher priority, drop
the rivals of the kept ones, repeat. The number of open conflicts of the largest group decides where
the rounds run: inside one task per group while every group is small, otherwise as Spark joins over
all groups at once. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelight.session import cut, release

SMALL_GROUP = 200_000  # conflicts or pairs of one group that one task may hold


SLOT_ROWS = 50_000  # rows of small groups that share one call into Python


def slots(df: DataFrame, keys: Sequence[str], small: int) -> DataFrame | None:
    """Add ``_slot``, a hash of the keys that gathers many small groups; None when a group is not small."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    if (n["top"] or 0) > small:
        return None
    return df.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(1 + (n["all"] or 0) // SLOT_ROWS)))


def _fields(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])


def _codes(pdf: pd.DataFrame, *names: str) -> np.ndarray:
    return pdf.groupby(list(names), sort=False).ngroup().to_numpy()


def dropped_by_rivals(conflicts: DataFrame, keys: Sequence[str], small: int = SMALL_GROUP) -> DataFrame:
    """(keys, id) of the items a greedy pass drops; everything else is kept.

    ``conflicts`` has keys, winner and loser: ``winner`` has priority over ``loser``.
    """
    open_ = cut(conflicts.select(*keys, "winner", "loser").distinct(), "conflicts")
    gathered = slots(open_, keys, small)
    if gathered is not None:
        schema = T.StructType([*_fields(open_, keys), T.StructField("id", open_.schema["loser"].dataType)])
        head = [*keys]

        def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
            n = len(pdf)
            ends = pd.concat([pdf[[*head, "winner"]].rename(columns={"winner": "id"}), pdf[[*head, "loser"]].rename(columns={"loser": "id"})], ignore_index=True)
            code = _codes(ends, *head, "id")
            w, x, gone = code[:n], code[n:], np.zeros(code.max() + 1, bool)
            while len(w):
                has_rival = np.zeros_like(gone)
                has_rival[x] = True
                gone[x[~has_rival[w]]] = True
                rest = ~(gone[w] | gone[x])
                w, x = w[rest], x[rest]
            return ends[gone[code]].drop_duplicates()

        return gathered.groupBy("_slot").applyInPandas(rounds, schema)
    lost = None
    while not open_.isEmpty():
        losers = open_.select(*keys, F.col("loser").alias("winner")).distinct()
        keepers = open_.select(*keys, "winner").distinct().join(losers, [*keys, "winner"], "left_anti")
        out = cut(open_.join(keepers, [*keys, "winner"], "left_semi").select(*keys, "loser").distinct(), "lost")
        lost = out if lost is None else lost.unionByName(out)
        # Conflicts of a kept item end with its losers; conflicts won by a dropped item are void.
        gone, before = out.withColumnRenamed("loser", "winner"), open_
        open_ = cut(open_.join(out, [*keys, "loser"], "left_anti").join(gone, [*keys, "winner"], "left_anti"), "conflicts")
        release(before)
    out = lost if lost is not None else conflicts.select(*keys, "loser").limit(0)
    return out.withColumnRenamed("loser", "id")


def keep_greedily(items: DataFrame, keys: Sequence[str], ident: str, conflicts: DataFrame, small: int = SMALL_GROUP) -> DataFrame:
    gone = dropped_by_rivals(conflicts, keys, small).withColumnRenamed("id", ident)
    return items.join(gone, [*keys, ident], "left_anti")


def match_one_to_one(pairs: DataFrame, keys: Sequence[str], a_rank: Sequence[Column], b_rank: Sequence[Column],
                     a_cap: Column | None = None, b_cap: Column | None = None, small: int = SMALL_GROUP) -> DataFrame:
    """One-to-one matching of candidate pairs (a, b) inside each key; ``n`` is how many units a pair takes.

    Each round accepts the pairs that are the best choice of both sides among the open pairs and
    closes the sides that are used up. With both ranks = (distance, a, b) this is the greedy pass
    over pairs by distance; with a_rank = distance and b_rank = a's turn it is the pass in which each
    a in turn takes its nearest free b. A side that stands for several copies has a cap above 1.
    """
    ra, rb = [f"_ra{i}" for i in range(len(a_rank))], [f"_rb{i}" for i in range(len(b_rank))]
    one = F.lit(1).cast("bigint")
    caps = {"_na": one if a_cap is None else a_cap.cast("bigint"), "_nb": one if b_cap is None else b_cap.cast("bigint")}
    open_, names, head = cut(pairs.withColumns({**dict(zip(ra, a_rank)), **dict(zip(rb, b_rank)), **caps}), "pairs"), list(pairs.columns), [*keys]
    gathered = slots(open_, keys, small)
    if gathered is not None:

        def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
            # Sorted by a's rank the first open row of an a is its choice; b's choice has the least place.
            place = pdf.sort_values([*rb, "a"], kind="stable").assign(_p=np.arange(len(pdf)))["_p"]
            p = pdf.assign(_p=place).sort_values([*ra, "b"], kind="stable", ignore_index=True)
            a, b, spot = _codes(p, *head, "a"), _codes(p, *head, "b"), p["_p"].to_numpy()
            left_a, left_b = (np.zeros(c.max() + 1, np.int64) for c in (a, b))
            left_a[a], left_b[b] = p["_na"].to_numpy(), p["_nb"].to_numpy()
            row, units = np.arange(len(p)), np.zeros(len(p), np.int64)
            while len(row):
                first = np.zeros(len(row), bool)
                first[np.unique(a[row], return_index=True)[1]] = True
                least = np.full(len(left_b), len(p))
                np.minimum.at(least, b[row], spot[row])
                hit = row[first & (spot[row] == least[b[row]])]
                units[hit] = np.minimum(left_a[a[hit]], left_b[b[hit]])
                left_a[a[hit]] -= units[hit]
                left_b[b[hit]] -= units[hit]
                row = row[(left_a[a[row]] > 0) & (left_b[b[row]] > 0)]
            return p.assign(n=units).loc[units > 0, [*names, "n"]]

        return gathered.groupBy("_slot").applyInPandas(rounds, T.StructType([*_fields(open_, names), T.StructField("n", T.LongType())]))
    done = None

    def choice(side: str, other: str, rank: Sequence[str]) -> DataFrame:
        # Partial aggregation keeps one candidate per side and task, however many pairs a side has.
        pick = open_.groupBy(*keys, side).agg(F.min(F.struct(*rank, F.col(other).alias("o"))).alias("p"))
        return pick.select(*keys, side, F.col("p.o").alias(other))

    while not open_.isEmpty():
        both = choice("a", "b", ra).join(choice("b", "a", rb), [*keys, "a", "b"])
        hit = cut(both.join(open_, [*keys, "a", "b"]).withColumn("n", F.least("_na", "_nb")), "accepted")
        done = hit if done is None else done.unionByName(hit)
        used = lambda side: hit.select(*keys, side, F.col("n").alias(f"_u{side}"))  # noqa: E731, B023
        rest = open_.join(used("a"), [*keys, "a"], "left").join(used("b"), [*keys, "b"], "left")
        rest = rest.withColumns({f"_n{x}": F.col(f"_n{x}") - F.coalesce(f"_u{x}", F.lit(0)) for x in ("a", "b")}).drop("_ua", "_ub")
        before = open_
        open_ = cut(rest.where("_na > 0 AND _nb > 0"), "pairs")
        release(before)
    return (done if done is not None else open_.withColumn("n", one)).select(*names, "n")


def spread_minimum(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node number of the component of each of ``n`` nodes, given edges a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, label) for every node that has an edge (a, b): the smallest id of its component.

    Labels jump to the label of their label between rounds, so long chains need few rounds.
    """
    ab = edges.select(*keys, "a", "b")
    both = cut(ab.unionByName(ab.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.select(*keys, F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    before = None
    while True:
        lab = labels.select(*keys, F.col("id").alias("b"), F.col("label").alias("lb"))
        near = both.join(lab, [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("lb").alias("near"))
        step = cut(labels.join(near, [*keys, "id"], "left").select(
            *keys, "id", F.col("label").alias("old"), F.least("label", "near").alias("m")), "labels")
        jump = step.select(*keys, F.col("id").alias("m"), F.col("m").alias("jump"))
        new = cut(step.join(jump, [*keys, "m"]).select(*keys, "id", "old", F.least("m", "jump").alias("label")), "labels")
        release(step)
        if before is not None:
            release(before)
        labels, before = new.select(*keys, "id", "label"), new
        if new.where("label <> old").isEmpty():
            return labels
