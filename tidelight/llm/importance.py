"""Resampling of documents towards a target collection by importance weights.

Runs of one to three words fall into hashed buckets. What a bucket gains a document is the log ratio of the bucket's share
in the target to its share in all documents; a document weighs the sum over its runs. Gumbel noise from a hash of the id
turns the highest scores into a draw without replacement, in proportion to the weights.

The draw needs one number, the key of the last winner. It is found by weighted median-of-medians selection: each round,
every task reports the median of its remaining keys with their number, the weighted median of these is the pivot,
and the side that cannot hold the wanted rank goes: an eighth of the keys at least (batches have medians, tasks take
the weighted median of their batches). The driver sees one row per task; only winners are sorted.

Defined cases: a null or empty text has no words, no runs and weight 0; it has a score but is never drawn. Equal scores go to the
smaller id, a null id last; its noise is drawn from the empty string. Repeated rows each count and each have a row; equal
keys at the cutoff are drawn in an order of their rows. Fewer documents than one winner needs: nobody is drawn.
Very long texts are worked through in pieces of ``PIECE`` bytes. Empty tables give an empty result, an empty target
gains by the documents alone. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight.llm.words import slices
from tidelight.operators.ordered import RN, number_rows
from tidelight.session import cut, release

BUCKETS, RUN, PIECE = 10_000, 3, 1 << 20
#: Bytes of words stay (A-Z lower-cased), all others become a space.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text piece by piece, and how many of them only repeat the end of the piece before."""
    text, at, tail = text.translate(WORD), 0, []
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found = tail + text[at:end].split()
        yield found, len(tail)
        tail, at = found[1 - RUN :], end


def run_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, bucket of each run of one to three words) of each piece of a text."""
    for found, known in pieces(text):
        spaced = [b" " + w for w in found]
        value, runs = list(map(crc32, found)), []
        for size in range(1, RUN + 1):
            if size > 1:  # a run's checksum goes on from that of the run without its last word
                value = list(map(crc32, spaced[size - 1 :], value))
            runs += value[max(0, known - size + 1) :]
        yield len(found) - known, np.array(runs, np.uint32) % np.uint32(buckets)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for _, part in slices(column):
        for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True):
            yield part.raw[a:b].tobytes()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: runs of all rows of ``text``; a task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for _, found in run_buckets(text, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths: an array of ``buckets`` numbers, whatever the tables' size."""
    both = bucket_counts(target, buckets).withColumn("t", F.lit(True)).unionByName(bucket_counts(docs, buckets).withColumn("t", F.lit(False)))
    rows = both.groupBy("bucket").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in (("t", F.col("t")), ("s", ~F.col("t")))]).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in rows:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row; ``docs``: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                words = features = weight = 0
                for n, found in run_buckets(text, len(gain)):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                rows.append((words, features, weight))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


# ---- selection -------------------------------------------------------------------------------


def _middle(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Total weight and weighted median of the keys (a, b)."""
    order = np.lexsort((b, a))
    run = np.cumsum(n[order])
    at = order[np.searchsorted(2 * run, run[-1])]
    return int(run[-1]), int(a[at]), int(b[at])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = []
    for batch in batches:
        if batch.num_rows:
            a, b = (np.asarray(c) for c in batch.columns)
            seen.append(_middle(np.ones(len(a), np.int64), a, b))
    if seen:
        one = _middle(*np.array(seen, np.int64).T)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in one], ["n", "a", "b"])


def _before(pivot: tuple[int, int]) -> Column:
    return (F.col("a") < pivot[0]) | ((F.col("a") == pivot[0]) & (F.col("b") < pivot[1]))


def _at(pivot: tuple[int, int]) -> Column:
    return (F.col("a") == pivot[0]) & (F.col("b") == pivot[1])


def kth_key(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The key (a, b) of rank ``k`` (from 1) in ascending order; None if there are fewer."""
    table = cut(keys.select("a", "b"), "keys")
    rest, held = table, None
    while True:
        middles = np.array([tuple(r) for r in rest.mapInArrow(_medians, "n long, a long, b long").collect()], np.int64).reshape(-1, 3)
        left = int(middles[:, 0].sum())
        if left < k:
            return None
        if held is not None and 8 * left < held:  # rounds read what is left, not what was discarded
            small = cut(rest, "keys")
            release(table)
            table = rest = small
            held = left
        held = left if held is None else held
        pivot = _middle(*middles.T)[1:]
        below, same = rest.agg(F.count_if(_before(pivot)), F.count_if(_at(pivot))).first()
        if below < k <= below + same:
            release(table)
            return pivot
        if k <= below:
            rest = rest.filter(_before(pivot))
        else:
            rest, k = rest.filter(~_before(pivot) & ~_at(pivot)), k - below - same


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs`` (doc_id, text).

    Of the N rows with ``least`` words or more, floor(percent * N / 100) are drawn and ranked from 1; the
    others have no rank. ``target``: text.
    """
    rows = cut(weighed(docs, gains(docs, target, buckets), seed).withColumn("_row", F.monotonically_increasing_id()), "weighed")
    able = rows.filter(F.col("n_words") >= least).select((-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("b"), "_row")
    k = able.count() * percent // 100
    last = kth_key(able, k) if k else None
    if last is None:
        return rows.drop("_row").withColumn("rank", F.lit(None).cast("long"))
    won = number_rows(able.filter(_before(last) | _at(last)), [], ["a", "b", "_row"]).rows
    ranks = won.filter(F.col(RN) < k).select("_row", (F.col(RN) + 1).alias("rank"))
    return rows.join(ranks, "_row", "left").drop("_row")


def drawn(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns whose id ``resample`` drew."""
    return docs.join(ranked.filter("rank is not null").select("doc_id"), "doc_id", "left_semi")
