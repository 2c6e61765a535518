"""Hard negatives from vectors by inner product, through R-trees packed by sort-tile-recursive.

Sort-tile: all rows are numbered by label and the widest component and cut into slabs of equal length; each slab is numbered by the
next component and cut into shards of about ``SHARD`` rows. Inside a task a shard is halved along one component after the
other until pages of ``PAGE`` rows are left; ``FAN`` pages make a node. Shards, nodes and pages have minimum bounding
boxes with their range of labels. A box gives each component of a query an interval, and their sums bound the inner product
from both sides.

A search asks for the first ``k`` rows of a query in each of its score windows, among rows of its label or of all other labels.
It takes boxes best-first from a queue, leaves out those outside all windows and those strictly below the k-th row found
(a tie may still win by its id), and multiplies out the rows of the pages that remain. Queries start in their own
shard; the k-th scores found there decide, by the boxes of all shards, which other shards a query is sent to. Queries meet shards in
groups of at most ``ASK`` queries and one shard; nothing else is held at once.

On vectors without clusters, in many dimensions, boxes overlap and little is left out: every query then meets every
shard. The result is exact either way.

Defined cases: rows without id, label or vector, with a null or non-finite component, of another length than most vectors, or with a
scaled component of ``LARGEST`` or more (sums would not fit a long) take no part. Repeated rows count once; of rows of one id that differ the one of
smallest label, then smallest vector, counts. Ties go to the smaller id. An anchor without other rows of its label, or a window without rows, gives
nothing. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.operators.ordered import RN, number_rows
from tidelight.session import cut

SHARD, PAGE, FAN, ASK, TASKS = 8192, 64, 8, 4096, 24
#: Boxes of shards that a group of queries is compared with at once.
BOXES = 1024
LARGEST = 1 << 27
_LOW, _HIGH = -(1 << 62), 1 << 62


def points(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id, label, v (array of long: floor(scale * x)) of the rows that take part; ``vectors``: id, label, vector."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("x"))
    rows = rows.filter("id is not null and label is not null and x is not null")
    small = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST / scale), F.lit(False)))
    rows = rows.filter(small).select("id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    rows = rows.filter(F.size("v") == (lengths["n"] if lengths else 0))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    return cut(one.select("id", "row.label", "row.v"), "points")


# ---- packing ---------------------------------------------------------------------------------


def packed(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """id, label, v, slab, shard: rows dealt to shards of about equal size by sort-tile."""
    first = rows.select(F.size("v")).first()
    wide = [0, 0]
    if first and first[0]:
        spread = rows.agg(F.array(*[F.coalesce(F.var_pop(F.col("v")[j]), F.lit(0.0)) for j in range(first[0])])).first()[0]
        wide = ([*np.argsort(-np.array(spread), kind="stable").tolist()] * 2)[:2]
    n = max(1, rows.count())
    slabs = int(np.ceil(np.sqrt(n / shard)))
    per_slab = -(-n // slabs)
    per_shard = -(-per_slab // -(-per_slab // shard))
    one = number_rows(rows.withColumn("_c", F.get("v", F.lit(wide[0]))), [], ["label", "_c", "id"]).rows
    one = one.select("id", "label", "v", F.floor(F.col(RN) / per_slab).alias("slab"))
    two = number_rows(one.withColumn("_c", F.get("v", F.lit(wide[1]))), ["slab"], ["_c", "id"]).rows
    return cut(two.select("id", "label", "v", "slab", F.floor(F.col(RN) / per_shard).alias("shard")), "packed")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact."""
    if a.size and b.size and a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of every query with rows in every box."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return _product(plus, low) + _product(minus, high), _product(plus, high) + _product(minus, low)


def _fits(label: np.ndarray, first: np.ndarray, last: np.ndarray, same: bool) -> np.ndarray:
    """Whether a box can hold rows of each query's label, or of another label."""
    if same:
        return (first <= label[:, None]) & (label[:, None] <= last)
    return (first != label[:, None]) | (last != label[:, None])


class Tree:
    """R-tree of one shard: rows in page order, pages, and nodes of ``FAN`` pages."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        turn = [label, *(v[:, j] for j in np.argsort(-v.var(axis=0), kind="stable"))]
        order, ends = [], []

        def tile(rows: np.ndarray, depth: int) -> None:
            if len(rows) <= PAGE:
                order.append(rows)
                ends.append(len(rows))
                return
            rows = rows[np.lexsort((ids[rows], turn[depth % len(turn)][rows]))]
            middle = -(-len(rows) // PAGE) // 2 * PAGE
            tile(rows[:middle], depth + 1)
            tile(rows[middle:], depth + 1)

        tile(np.arange(len(ids)), 0)
        at = np.concatenate(order)
        self.ids, self.label, self.v = ids[at], label[at], v[at]
        self.exact = self.v.astype(np.float64)
        self.largest = int(np.abs(v).max(initial=0)) * v.shape[1]
        self.ends = np.cumsum(ends)
        self.starts = self.ends - ends
        self.pages = self._boxes(self.v, self.label, self.starts)
        self.nodes = tuple(f.reduceat(x, np.arange(0, len(ends), FAN)) for f, x in zip((np.minimum, np.maximum) * 2, self.pages, strict=True))

    @staticmethod
    def _boxes(v: np.ndarray, label: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        return (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts), np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts))

    def search(self, query: Queries, same: bool, k: int) -> Iterator[tuple[int, int, int, int]]:
        """(query number, window, id, score) of the first ``k`` rows of each window that beat its floor."""
        boxes = []
        for low, high, first, last in (self.nodes, self.pages):
            least, most = _bounds(query.v, low, high)
            boxes.append((least, np.where(_fits(query.label, first, last, same), most, _LOW - 1)))
        (node_least, node_most), (page_least, page_most) = boxes
        for a in range(len(query.ids)):
            floor, cap = query.floor[a].copy(), query.cap[a]
            if not len(floor):
                continue
            found: list[list[tuple[int, int]]] = [[] for _ in floor]
            top = int(cap.max())
            x = query.v[a].astype(np.float64) if self.largest * int(np.abs(query.v[a]).max(initial=0)) < 1 << 53 else None

            def open_(most: int, least: int) -> bool:
                return bool(((most >= floor) & (least <= cap)).any())  # noqa: B023

            queue = [(-min(int(m), top), -1, b) for b, m in enumerate(node_most[a]) if open_(m, node_least[a, b])]
            heapify(queue)
            wave = 1
            while queue:
                pages = []
                while queue and len(pages) < wave:
                    _, leaf, b = heappop(queue)
                    if leaf == 0:
                        if open_(page_most[a, b], page_least[a, b]):
                            pages.append(b)
                    elif open_(node_most[a, b], node_least[a, b]):
                        for p in range(b * FAN, min((b + 1) * FAN, len(self.starts))):
                            if open_(page_most[a, p], page_least[a, p]):
                                heappush(queue, (-min(int(page_most[a, p]), top), 0, p))
                if not pages:
                    break
                wave = min(2 * wave, 16)
                rows = np.concatenate([np.arange(self.starts[p], self.ends[p]) for p in pages])
                right = (self.label[rows] == query.label[a]) == same
                rows = rows[right & (self.ids[rows] != query.ids[a])]
                score = (self.exact[rows] @ x).astype(np.int64) if x is not None else self.v[rows] @ query.v[a]
                for w in range(len(floor)):
                    inside = np.flatnonzero((score >= floor[w]) & (score <= cap[w]))
                    if not len(inside):
                        continue
                    if len(inside) > k:  # the k-th of these rows and its ties are enough
                        least = -np.partition(-score[inside], k - 1)[k - 1]
                        inside = inside[score[inside] >= least]
                    merged = sorted(found[w] + list(zip((-score[inside]).tolist(), self.ids[rows[inside]].tolist(), strict=True)))[:k]
                    found[w] = merged
                    if len(merged) == k:
                        floor[w] = max(floor[w], -merged[-1][0])
            for w, rows in enumerate(found):
                for s, i in rows:
                    yield a, w, i, -s


class Queries:
    """Queries of one call; ``floor`` and ``cap`` hold the lowest and highest score wanted in each window."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.label = (np.asarray(table.column(c), np.int64) for c in ("id", "label"))
        self.v = _matrix(table.column("v"))
        self.floor, self.cap = ([np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in ("floors", "caps"))


# ---- search ----------------------------------------------------------------------------------


def _hits(same: bool, k: int):
    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asked.num_rows:
            tree = Tree(np.asarray(rows.column("id"), np.int64), np.asarray(rows.column("label"), np.int64), _matrix(rows.column("v")))
            query = Queries(asked)
            found = [(int(query.ids[a]), w, i, s) for a, w, i, s in tree.search(query, same, k)]
        columns = np.array(found, np.int64).reshape(-1, 4).T
        return pa.table([pa.array(c) for c in columns], ["anchor_id", "window", "id", "score"])

    return run


def _box(key: tuple, rows: pa.Table) -> pa.Table:
    label, v = np.asarray(rows.column("label"), np.int64), _matrix(rows.column("v"))
    return pa.table({"slab": [key[0].as_py()], "shard": [key[1].as_py()], "low": [v.min(axis=0)], "high": [v.max(axis=0)], "first": [label.min()], "last": [label.max()]})


def boxes(tree: DataFrame) -> DataFrame:
    """slab, shard, low, high, first, last: the box of each shard."""
    return tree.groupBy("slab", "shard").applyInArrow(_box, "slab long, shard long, low array<long>, high array<long>, first long, last long")


def _route(same: bool):
    def run(key: tuple, box: pa.Table, asked: pa.Table) -> pa.Table:
        if not box.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "slab", "shard")})
        query = Queries(asked)
        place = [np.asarray(box.column(c), np.int64) for c in ("slab", "shard")]
        least, most = _bounds(query.v, _matrix(box.column("low")), _matrix(box.column("high")))
        fits = _fits(query.label, *(np.asarray(box.column(c), np.int64) for c in ("first", "last")), same)
        home = np.logical_and(*(np.asarray(asked.column(c), np.int64)[:, None] == p for c, p in zip(("slab", "shard"), place, strict=True)))
        useful = np.zeros_like(fits)
        for a, (floor, cap) in enumerate(zip(query.floor, query.cap, strict=True)):
            useful[a] = ((most[a][:, None] >= floor) & (least[a][:, None] <= cap)).any(axis=1)
        at, to = np.nonzero(useful & fits & ~home)  # the own shard has been searched
        return pa.table({"id": query.ids[at], "slab": place[0][to], "shard": place[1][to]})

    return run


HITS = "anchor_id long, window long, id long, score long"


def search(tree: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, window, id, score, rank: the first ``k`` rows in each window of each query.

    ``queries``: id, label, v, slab, shard (where the query's own row lies), floors, caps (lowest and highest score of each window).
    """
    queries = cut(queries, "queries")
    at = ["slab", "shard"]
    near = cut(tree.groupBy(*at).cogroup(queries.groupBy(*at)).applyInArrow(_hits(same, k), HITS), "hits")
    # with k rows found, only rows as good as the k-th can still matter
    full = near.groupBy("anchor_id", "window").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    known = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "s"))).alias("known"))
    raised = F.transform("floors", lambda f, w: F.greatest(f, F.coalesce(F.try_element_at("known", w.cast("long")), f)))
    rest = queries.join(known.withColumnRenamed("anchor_id", "id"), "id", "left").withColumn("floors", raised).drop("known")
    directory = cut(boxes(tree), "boxes")
    n_shards, n_queries = directory.count(), queries.count()
    chunks = max(1, -(-n_shards // BOXES))
    parts = max(1, -(-n_queries // ASK), min(-(-n_queries // PAGE), -(-TASKS // max(1, n_shards))))
    rest = cut(rest.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")), "queries")
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = directory.withColumn("chunk", F.pmod(F.xxhash64(*at), F.lit(chunks)).cast("long")).withColumn("part", each(parts))
    right = rest.withColumn("chunk", each(chunks))
    routed = left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(_route(same), "id long, slab long, shard long")
    sent = cut(rest.drop(*at).join(routed, "id"), "routed")
    rows = tree.join(sent.select(*at, F.col("part").alias("part")).distinct(), at)
    far = rows.groupBy(*at, "part").cogroup(sent.groupBy(*at, "part")).applyInArrow(_hits(same, k), HITS)
    best = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "id"))
    return near.unionByName(far).withColumn("rank", best).filter(F.col("rank") <= k)


def _share(score: Column, percent: int, up: bool) -> Column:
    """percent * score / 100, rounded up or down, exact."""
    part = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil(part) if up else F.floor(part)).cast("long")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id, label, v (see ``points``); ``anchors``: ids of rows. A negative of an anchor and positive is a row of another label whose score
    is between ``least`` and ``most`` percent of the positive's.
    """
    tree = packed(rows, shard)
    asked = cut(tree.join(anchors.select("id").distinct(), "id", "left_semi"), "anchors")
    every = asked.withColumns({"floors": F.array(F.lit(_LOW)), "caps": F.array(F.lit(_HIGH))})
    good = cut(search(tree, every, True, positives), "positives")
    good = good.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("window"))
    windows = good.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("w"))
    wanted = asked.join(windows.withColumnRenamed("anchor_id", "id"), "id").withColumns({
        "floors": F.transform("w", lambda w: _share(w["positive_score"], least, True)),
        "caps": F.transform("w", lambda w: _share(w["positive_score"], most, False))}).drop("w")
    found = search(tree, wanted, False, negatives).select("anchor_id", "window", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return good.join(found, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
