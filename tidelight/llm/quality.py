"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), the pair sum as half of
(sum v_i x_i)^2 - sum v_i^2 x_i^2 per factor, so a text costs time in proportion to its features.

It is fitted on at most ``SAMPLE`` labelled documents, those with the smallest hash of their id, dealt to
``PARTS`` parts. In each of ``ROUNDS`` rounds every part makes one pass of AdaGrad steps from the common
weights, and the weights of all parts are averaged: what reaches the driver is ``PARTS`` models of fixed size.

Defined cases: a null or empty text has the statistics of an empty text and gets the score of those. Labels
that are null, and labels of unknown documents, are left out; several labels of one document count each.
Without labelled rows every score is 0.5. doc_id, source, lang and labels are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelight.llm import words
from tidelight.session import cut

#: Hashed words, statistics after them, factors.
BUCKETS, FACTORS = 1 << 13, 4
SAMPLE, PARTS, ROUNDS, STEP = 8_000, 8, 8, 0.1
ACCEPTED = 0.7
_KINDS = np.zeros((256, 6), bool)
_KINDS[65:91, 0] = True  # upper case
_KINDS[97:123, 1] = True  # lower case
_KINDS[48:58, 2] = True  # digits
_KINDS[[*b"!?#$%&*|@^~<>={}[]\\_+/"], 3] = True  # signs
_KINDS[[*b".,;:"], 4] = True  # stops
_KINDS[10, 5] = True  # ends of lines
STATISTICS = ("bias", "upper", "lower", "digit", "sign", "stop", "line_end", "letter", "word_length", "long_words", "words", "length", "distinct", "most_frequent", "repeats", "distinct_pairs")


def features(texts: words.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text's features: words (log counts, unit length), then all statistics."""
    starts, ends, owner = texts.words()
    hashed = words.span(texts.prefix(), starts, ends)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    running = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(_KINDS[texts.raw], axis=0, dtype=np.int64)])
    high = np.concatenate([[0], np.cumsum((texts.raw & 0xC0) == 0xC0)])  # first bytes of other characters
    kinds = running[texts.offsets[1:]] - running[texts.offsets[:-1]]
    others = high[texts.offsets[1:]] - high[texts.offsets[:-1]]
    lengths = (ends - starts).astype(np.float64)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        n, size = b - a, max(1, int(texts.offsets[k + 1] - texts.offsets[k]))
        kind = kinds[k] / size
        if n:
            found, counts = np.unique(hashed[a:b], return_counts=True)
            bucket, where = np.unique((found % np.uint64(BUCKETS)).astype(np.int64), return_inverse=True)
            value = np.log1p(np.bincount(where, counts))
            value /= np.sqrt((value * value).sum())
            same = (hashed[a + 1 : b] == hashed[a : b - 1]).mean() if n > 1 else 0.0
            pairs = len(np.unique(hashed[a + 1 : b] * np.uint64(3) + hashed[a : b - 1])) / (n - 1) if n > 1 else 1.0
            more = (lengths[a:b].mean() / 10, (lengths[a:b] > 12).mean(), np.log1p(n) / 8, np.log1p(size) / 10, len(found) / n, counts.max() / n, same, pairs)
        else:
            bucket, value, more = np.zeros(0, np.int64), np.zeros(0), (0.0,) * 8
        yield np.concatenate([bucket, np.arange(BUCKETS, BUCKETS + len(STATISTICS))]), np.concatenate([value, [1.0], kind[:5], [min(1.0, 10 * kind[5])], [kind[0] + kind[1] + others[k] / size], more])


class Model:
    """Weights as one array: a row for each feature, its weight and then its factors."""

    def __init__(self, table: np.ndarray | None) -> None:
        self.table = table

    @staticmethod
    def start() -> np.ndarray:
        table = np.random.default_rng(7).normal(0, 0.02, (BUCKETS + len(STATISTICS), 1 + FACTORS)).astype(np.float32)
        table[:, 0] = 0
        return table

    def raw(self, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
        rows = self.table[index]
        sums = value @ rows[:, 1:]
        return float(value @ rows[:, 0] + 0.5 * ((sums * sums).sum() - ((value[:, None] * rows[:, 1:]) ** 2).sum())), sums

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 0.5 if self.table is None else 1 / (1 + np.exp(-np.clip(self.raw(index, value)[0], -30, 30)))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], squares: np.ndarray, order: np.ndarray) -> None:
        """One pass of AdaGrad steps on the logistic loss; ``squares`` are the summed squared gradients so far."""
        for k in order:
            index, value, label = examples[k]
            raw, sums = self.raw(index, value)
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label
            x = value[:, None]
            step = slope * np.concatenate([x, x * (sums - x * self.table[index, 1:])], axis=1) + 1e-5 * self.table[index]
            squares[index] += step * step
            self.table[index] -= STEP * step / np.sqrt(squares[index] + 1e-6)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never used for fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _pass(shared, turn: int):
    """A part's pass over its examples, from the common weights."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "doc_id", "label", "text"])
        found = [x for _, texts in words.slices(pa.array(part["text"])) for x in features(texts)]
        examples = [(i, v, y) for (i, v), y in zip(found, part["label"], strict=True)]
        model, squares = Model(shared.value[0].copy()), shared.value[1].copy()
        model.fit(examples, squares, np.random.default_rng(turn).permutation(len(examples)))
        return pd.DataFrame({"n": [len(examples)], "table": [model.table.astype(np.float32).tobytes()], "spread": [squares.astype(np.float32).tobytes()]})

    return one


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents that are not held out and their labels (doc_id, quality 0 or 1)."""
    spark = docs.sparkSession
    ids = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    ids = ids.select("*", F.xxhash64("doc_id", F.lit("quality")).alias("draw")).orderBy("draw", "doc_id", "label").limit(sample)
    # at most SAMPLE texts
    drawn = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.pmod("draw", F.lit(PARTS)).cast("int").alias("part"), "draw", "doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    drawn = cut(drawn, "quality")
    if drawn.isEmpty():
        return Model(None)
    table, spread = Model.start(), np.zeros((BUCKETS + len(STATISTICS), 1 + FACTORS), np.float32)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((table, spread))
        made = drawn.groupBy("part").applyInPandas(_pass(shared, turn), "n long, table binary, spread binary").orderBy("n", "table").collect()  # PARTS models
        n = sum(r["n"] for r in made)
        table, spread = (sum(np.frombuffer(r[c], np.float32).reshape(table.shape) * np.float32(r["n"] / n) for r in made) for c in ("table", "spread"))
    return Model(table)


def scored(docs: DataFrame, model: Model, accepted: float = ACCEPTED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in words.slices(batch.column(2)):
                out = [shared.value.score(i, v) for i, v in features(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(out)), batch.column(1).slice(row, len(out)), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return rows.select("*", (F.col("score") >= accepted).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, least: float = ACCEPTED) -> DataFrame:
    """Rows of ``docs`` that the model accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(i, v) for _, texts in words.slices(batch.column(at)) for i, v in features(texts)]
            yield batch.filter(pa.array([x >= least for x in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
