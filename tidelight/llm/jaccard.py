"""N-gram Jaccard join: document groups with (almost) equal sets of word shingles, exactly.

The product of the document-by-shingle incidence with its transpose is taken over the columns that can
matter: of n shingles, in an order that puts frequent ones last, two sets that reach the bound share one
among their first n - ceil(bound * n) + 1. (Any order is right. This one rests on two tables of fixed size:
which shingles many texts share, and how frequent the words are that a shingle consists of.) Equal sets are one row of the matrix. A pair that shares such a
column is dropped unless the bounds from both sizes, from the place of the column, and from a parity map
of the sets allow the overlap; for the rest the overlap is counted in full.

Only the groups are asked for, so pairs are taken in two steps, neither of which lists all pairs of a
column: first every row against one row of the column, whose counted links make groups; then, in columns
that still hold several groups, rows outside the largest group against rows of other groups. A pair that
neither step takes lies in one group already.

Defined cases: null or wordless texts have no shingle and are linked with nothing; texts of fewer words
than a shingle have one, the whole sequence. Rows that share a doc_id are one document with the links of
all its rows; a null doc_id has its class's smallest id, null if there is none. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelight.llm import words
from tidelight.llm.graph import components
from tidelight.session import cut

#: Slots of the two frequency tables and bits of the id filter: 1 MB each and 8 MB, whatever the input.
SLOT_BITS, FILTER_BITS = 20, 26
#: Hashes a task gathers before it counts them, and how many of these, as a power of two, make a shingle or a word one that is told.
GATHER, SHARED, FREQUENT = 1 << 21, 19, 17
PARITY = 512
#: Earlier columns that an entry remembers, to skip pairs met before; what is met again all the same is made distinct later.
REMEMBER = 4
_PARITY_NAMES = [f"b{i}" for i in range(PARITY // 64)]


def ceil_share(percent: int, n: Column, of: int = 100) -> Column:
    return F.floor((n * percent + of - 1) / of).cast("long")


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Two rows: log2 of how many texts share the shingles of a slot, and of how often the words of a slot occur, as far as tasks saw many."""

    def told(parts: list[np.ndarray], kind: int, shift: int) -> pa.RecordBatch:
        every = np.concatenate(parts)
        found, n = np.unique(every, return_counts=True)
        many = n >= max(3, len(every) >> shift)
        slot, where = np.unique((found[many] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), return_inverse=True)
        top = np.zeros(len(slot), np.int64)
        np.maximum.at(top, where, n[many])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot), pa.array(top)], ["kind", "slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, own, held = [], [], 0
        for batch in batches:
            for _, texts in words.slices(batch.column(0)):
                found, bounds = words.hashed(texts)
                own.append(found)
                sets += [x for x, _ in words.shingles(found, bounds, size)]
                held += len(found)
                if held > GATHER:
                    yield told(sets, 0, SHARED)
                    yield told(own, 1, FREQUENT)
                    sets, own, held = [], [], 0
        if own:
            yield told(sets, 0, SHARED)
            yield told(own, 1, FREQUENT)

    slots = docs.select("text").mapInArrow(count, "kind int, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
    table = np.zeros((2, 1 << SLOT_BITS), np.uint8)
    seen = slots.toPandas()  # at most 2 * 2^SLOT_BITS rows
    table[seen["kind"].to_numpy(np.int64), seen["slot"].to_numpy(np.int64)] = np.ceil(np.log2(seen["n"].to_numpy(np.float64) + 1)).astype(np.uint8)
    return table


def _arrays(docs: DataFrame, of_set: Callable, schema: str, keep: Callable | None = None, size: int = 4, score: Callable | None = None) -> DataFrame:
    """One row per text: its id and what ``of_set`` makes of its shingles and their scores."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if keep is not None:
                batch = batch.filter(pa.array(keep(batch.column(2).to_numpy(zero_copy_only=False))))
            for row, texts in words.slices(batch.column(1)):
                found, bounds = words.hashed(texts)
                out = [of_set(x, y) for x, y in words.shingles(found, bounds, size, None if score is None else score(found))]
                ids = batch.column(0).slice(row, len(out))
                cols = [pa.array(c, pa.list_(pa.int64())) if isinstance(c[0], np.ndarray) else pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names)

    return docs.mapInArrow(run, schema)


def _digest(x: np.ndarray) -> tuple[int, int]:
    return int(words.mix(x).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(words.mix(x ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64))


def _parity(spread: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((spread % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame, size: int, percent: int, weight: np.ndarray) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), parity maps, prefix (the columns that can matter, in order).

    A map has a bit for the parity of each residue of the elements; sets of more than ``PARITY`` elements
    have a second, wider one, with a bit per element at least.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def slot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def of_set(x: np.ndarray, frequent: np.ndarray) -> tuple:
        n = len(x)
        first = np.lexsort((x, frequent, shared.value[0][slot(x)]))[: n - (percent * n + 99) // 100 + 1] if n else []
        spread = words.mix(x + np.uint64(77))
        narrow = _parity(spread, PARITY)
        wide = _parity(spread, 1 << (n - 1).bit_length()) if n > PARITY else np.zeros(0, np.int64)
        return (n, *_digest(x), *narrow.tolist(), wide, x[first].view(np.int64) if n else x.view(np.int64))

    schema = "doc_id long, n long, d1 long, d2 long, " + "".join(f"{b} long, " for b in _PARITY_NAMES) + "wide array<long>, prefix array<long>"
    return _arrays(docs.select("doc_id", "text"), of_set, schema, size=size, score=lambda x: shared.value[1][slot(x)].astype(np.int16))


def _needed(percent: int) -> Column:
    """Overlap that sets of sizes n and n_ need."""
    return ceil_share(percent, F.col("n") + F.col("n_"), 100 + percent)


def _sizes_allow(percent: int) -> Column:
    return F.least("n", "n_") >= ceil_share(percent, F.greatest("n", "n_"))


def _maps_allow(percent: int) -> Column:
    """Each element of only one set changes one bit of the parity map, so the maps bound the overlap."""
    apart = F.lit(0)
    for b in _PARITY_NAMES:
        apart = apart + F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_")))
    return apart <= F.col("n") + F.col("n_") - 2 * _needed(percent)


def _wide_allow(percent: int) -> Column:
    """The same with wide maps, where both have one; the longer one is folded to the length of the other."""

    def fold(x: Column, to: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > to, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)

    to = F.least(F.size("wide"), F.size("wide_"))
    apart = F.aggregate(F.zip_with(fold(F.col("wide"), to), fold(F.col("wide_"), to), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    return F.when(to > 0, apart <= F.col("n") + F.col("n_") - 2 * _needed(percent)).otherwise(True)


def _other(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}_") for c in df.columns])


def _tag() -> Column:
    """Tells rows of one doc_id with different sets apart."""
    return F.col("d1").bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("tag")


def counted(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (doc, tag, doc_, tag_) the links u, v: overlap counted over the whole sets.

    Sets are cut again from the texts the pairs name. A filter of fixed size lets these texts through (and
    some others, which the join drops), so texts are not shuffled.
    """
    spark = docs.sparkSession
    ids = cut(pairs.select("doc", "tag").unionByName(pairs.select(F.col("doc_").alias("doc"), F.col("tag_").alias("tag"))).distinct(), "jaccard")
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    marks = ids.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {1 << FILTER_BITS}) % 64 as int))").alias("mark"))
    seen = marks.groupBy("word").agg(F.bit_or("mark").alias("marks")).toPandas()  # at most 2^(FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[seen["word"].to_numpy(np.int64)] = seen["marks"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table)

    def keep(bits: np.ndarray) -> np.ndarray:
        return (shared.value[bits >> 6] >> (bits & 63)) & 1 == 1

    named = docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit"))
    found = _arrays(named, lambda x, _: (_digest(x)[0], x.view(np.int64)), "doc long, d1 long, items array<long>", keep, size).select("doc", _tag(), "items")
    found = cut(found.join(ids, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"]), "jaccard")
    both = pairs.join(found, ["doc", "tag"]).join(_other(found), ["doc_", "tag_"])
    overlap = F.size(F.array_intersect("items", "items_"))
    linked = both.filter(overlap * (100 + percent) >= (F.size("items") + F.size("items_")) * percent)
    return cut(linked.select(F.col("doc").alias("u"), F.col("doc_").alias("v")).distinct(), "jaccard")


def groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id long, text string)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(sets(docs, size, percent, frequencies(docs, size)), "jaccard")
    digest, me, other = ["n", "d1", "d2"], ["doc", "tag"], ["doc_", "tag_"]
    classes = rows.filter("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("doc"))
    matrix = rows.filter("n > 0").join(classes.select(*digest, F.col("doc").alias("doc_id")), [*digest, "doc_id"], "left_semi")
    matrix = cut(matrix.select(F.col("doc_id").alias("doc"), _tag(), F.col("n").cast("int").alias("n"), *_PARITY_NAMES, "wide", "prefix"), "jaccard")

    # an entry is a row's place in a column that other rows share, with the row that comes first in it
    column = Window.partitionBy("col")
    entries = matrix.select(*me, "n", F.posexplode("prefix").alias("pos", "col"))
    entries = entries.select("*", F.count(F.lit(1)).over(column).alias("rows"), F.min(F.struct("pos", *me, "n")).over(column).alias("first")).filter("rows > 1")
    entries = cut(entries.select("col", *me, "n", "pos", *[F.col(f"first.{c}").alias(f"{c}_") for c in (*me, "n")]), "jaccard")
    maps = cut(matrix.drop("prefix").join(entries.select(*me).distinct(), me, "left_semi").dropDuplicates(me), "jaccard")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs whose maps allow a link."""
        both = pairs.select(*me, *other).join(maps, me).join(_other(maps), other)
        return both.filter(_maps_allow(percent) & _wide_allow(percent)).select(*me, *other)

    # step 1: every row against the first rows of its columns, of those the two that share most columns
    against = entries.filter(F.col("doc") != F.col("doc_")).filter(_sizes_allow(percent)).groupBy(*me, *other).agg(F.count(F.lit(1)).alias("columns"))
    rank = F.row_number().over(Window.partitionBy(*me).orderBy(F.desc("columns"), *other))
    first = against.select("*", rank.alias("rank")).filter("rank <= 2")
    links = counted(docs, cut(allowed(first), "jaccard"), size, percent)
    groups = cut(components(links), "jaccard")

    # step 2: columns that hold several groups
    named = entries.drop("doc_", "tag_", "n_").join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    named = cut(named.select("*", F.coalesce("component", "doc").alias("of")).drop("component"), "jaccard")
    shares = named.groupBy("col", "of").agg(F.count(F.lit(1)).alias("rows"))
    mixed = shares.groupBy("col").agg(F.max_by("of", F.struct("rows", "of")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").drop("groups")
    # a pair that may link passes the bound from its places in the first column it shares; met again next to a column met before, it is skipped
    before = Window.partitionBy(*me).orderBy("pos").rowsBetween(-REMEMBER, -1)
    named = cut(named.join(mixed, "col").select("*", F.collect_list("col").over(before).alias("met")), "jaccard")
    outside, others = named.filter(F.col("of") != F.col("main")), _other(named, "col")
    reach = F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")) >= _needed(percent)
    pairs = outside.join(others, "col").filter(
        (F.col("of") != F.col("of_")) & ((F.col("of_") == F.col("main_")) | (F.col("doc") < F.col("doc_")))
        & _sizes_allow(percent) & reach & ~F.arrays_overlap("met", "met_")
    )
    pairs = cut(allowed(pairs.select(*me, *other).distinct()), "jaccard")
    if not pairs.isEmpty():
        more = counted(docs, pairs, size, percent)
        groups = components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    known = classes.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select(*[F.col(c).alias(f"{c}_") for c in digest], F.coalesce("component", "doc").alias("found"))
    out = rows.join(known, (F.col("n") == F.col("n_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Rows of ``docs`` without those whose group has a document of smaller id. Rows of null doc_id stay."""
    found = groups(docs, size, percent).filter("component_id < doc_id").select(F.col("doc_id").alias("_of")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_of"), "left_anti")
