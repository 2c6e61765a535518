"""Exact top-k search among binary codes by incremental multi-index hashing.

A code is cut into segments, each of which is an index of its own. Around a query's segments the search looks
up values of growing distance r. After radius r every code within ``segments * (r + 1) - 1`` bits has been met
in some segment, so a query ends as soon as its k-th verified distance is no larger.

Equal codes are one entry with its ``k`` smallest ids. Codes are dealt to blocks of at most about
``BLOCK`` entries by their hash; every block is an index and answers all queries, a bounded number of
queries at a time, and the best k of all blocks are the answer. Ties go to the smaller id.

Defined cases: rows without a vector, and vectors of another length than ``bits``, have no code, are not found and
ask nothing. Repeated rows of one id count once per code. A null id is never found and asks nothing. With fewer
than k codes a query gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelight.session import cut

BITS, SEGMENT = 64, 16
#: Entries of a block, queries looked up together, most queries of a task, tasks that a small search is split into.
BLOCK, ASK, GROUP, TASKS = 1 << 16, 64, 1 << 18, 24
#: Salts that split the ids of one code before its smallest are taken.
SALTS = 32


def codes(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """id, code (long: bit j is set if component j is positive); ``vectors``: id, vector."""
    usable = vectors.filter("id is not null and vector is not null").filter(F.size("vector") == bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().fill_null(0).to_numpy(zero_copy_only=False)
            signs = np.packbits(flat.reshape(-1, bits) > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(signs).view(np.int64).ravel())], ["id", "code"])

    return usable.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "id long, code long")


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """code, ids: the k smallest ids of each code, in two steps so that no code is gathered whole."""
    one = Window.partitionBy("code", "salt").orderBy("id")
    two = Window.partitionBy("code").orderBy("id")
    rows = rows.distinct().select("id", "code", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    rows = rows.select("*", F.row_number().over(one).alias("n")).filter(F.col("n") <= k)
    rows = rows.select("id", "code", F.row_number().over(two).alias("n")).filter(F.col("n") <= k)
    return rows.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in x) for x in combinations(range(SEGMENT), radius)], np.int64)


class Index:
    """Multi-index over the codes of a block."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        self.parts = code.view(np.uint16).reshape(-1, BITS // SEGMENT)
        self.order, self.start = [], []
        for s in range(self.parts.shape[1]):
            order = np.argsort(self.parts[:, s], kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(self.parts[order, s], np.arange((1 << SEGMENT) + 1)))

    def met(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) whose segments lie ``radius`` apart somewhere; without repetition."""
        masks, pairs = _masks(radius), []
        parts = queries.view(np.uint16).reshape(-1, BITS // SEGMENT).astype(np.int64)
        for s in range(parts.shape[1]):
            value = parts[:, s, None] ^ masks
            first, last = self.start[s][value], self.start[s][value + 1]
            many = (last - first).ravel()
            who = np.repeat(np.repeat(np.arange(len(queries)), len(masks)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first.ravel(), many)
            pairs.append(who * len(self.code) + self.order[s][at])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.code), found % len(self.code)

    def nearest(self, queries: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[tuple[int, int, int]]:
        """(query number, id, distance) of the k nearest ids, ties by id."""
        weight = np.array([len(x) for x in ids])
        open_, near = np.arange(len(queries)), [{} for _ in queries]
        for radius in range(SEGMENT + 1):
            step = max(1, (1 << 20) // max(1, len(_masks(radius))))
            for a in range(0, len(open_), step):
                asked = open_[a : a + step]
                who, entry = self.met(queries[asked], radius)
                distance = np.bitwise_count((queries[asked[who]] ^ self.code[entry]).view(np.uint64))
                for q, e, d in zip(asked[who].tolist(), entry.tolist(), distance.tolist(), strict=True):
                    near[q][e] = d
            covered = (BITS // SEGMENT) * (radius + 1) - 1
            done = []
            for q in open_.tolist():
                found = near[q]
                inside = [(d, e) for e, d in found.items() if d <= covered]
                if sum(int(weight[e]) for _, e in inside) >= k or radius == SEGMENT:
                    best = sorted((d, int(i)) for d, e in (inside if radius < SEGMENT else [(d, e) for e, d in found.items()]) for i in ids[e])[:k]
                    yield from ((q, i, d) for d, i in best)
                    near[q] = {}
                    done.append(q)
            open_ = np.setdiff1d(open_, done)
            if not len(open_):
                return


def _search(k: int):
    def run(key: tuple, entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asked):
            return pd.DataFrame({"query": [], "id": [], "distance": []}).astype("int64")
        entries = entries.sort_values("code")
        index, ids = Index(np.ascontiguousarray(entries["code"].to_numpy(np.int64))), list(entries["ids"])
        code = asked["code"].to_numpy(np.int64)
        found = [(int(code[a + q]), i, d) for a in range(0, len(code), ASK) for q, i, d in index.nearest(np.ascontiguousarray(code[a : a + ASK]), ids, k)]
        return pd.DataFrame(found, columns=["query", "id", "distance"]).astype("int64")

    return run


def nearest(base: DataFrame, asked: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, neighbor_id, distance, rank: the k nearest of ``base`` (id, code) to each row of ``asked`` (id, code), itself left out."""
    entries = cut(_smallest(base, k + 1), "hamming")
    n = entries.count()
    blocks = max(1, -(-n // block))
    wanted = cut(asked.distinct(), "hamming")
    questions = wanted.select("code").distinct()
    # every block meets every group of queries: one group, unless memory or too few tasks ask for more
    many = questions.count()
    groups = max(1, -(-many // GROUP), min(-(-many // ASK), -(-TASKS // blocks)))
    left = entries.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = questions.select("code", F.pmod(F.xxhash64("code", F.lit("q")), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_search(k + 1), "query long, id long, distance long")
    merged = found.join(wanted.select(F.col("id").alias("query_id"), F.col("code").alias("query")), "query").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id"))
    return merged.select("query_id", F.col("id").alias("neighbor_id"), "distance", rank.alias("rank")).filter(F.col("rank") <= k)
