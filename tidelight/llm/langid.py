"""Language identification: a linear-chain conditional random field over the words of a text.

Every word has affix, n-gram, whole-word and lexicon features; learned transitions tie neighbours, and
forward-backward gives each word's probability of each language, so code-switched texts are labelled
word by word. A text's language is the one with the largest sum over its words.

It is fitted on at most ``SAMPLE`` documents, dealt evenly among languages, of about ``PER_LANGUAGE`` of each of the ``LANGUAGES`` most
frequent languages, cut into code-switched sequences: runs of words from different documents, each word
labelled with its document's language. Parts of the sample are fitted in tasks and their weights averaged
after each round, so what reaches the driver is ``PARTS`` models of fixed size. The lexicon is the
sample's frequent words with their languages.

Defined cases: a null text and a text without a letter get ``und`` and score 0. Rows are judged one by one,
also repeated ones. Documents whose language is null are no examples. Without examples every text is ``und``.
Long texts are worked through in blocks of ``BLOCK`` words without being cut. doc_id, source and lang are
never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelight.llm import words
from tidelight.session import cut

UNKNOWN = "und"
BUCKETS = 1 << 15
PER_LANGUAGE, LANGUAGES, SAMPLE, PARTS, ROUNDS, STEP = 500, 1_000, 8_000, 8, 4, 0.2
LEXICON, LEXICON_BINS = 4_000, 4
SEQUENCE, RUN, BATCH = 48, 12, 32
BLOCK = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_EDGES = ((1, False), (2, False), (3, False), (1, True), (2, True), (3, True), (4, True))


def held_out(doc_id: Column) -> Column:
    """Documents whose language is never used for fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Words:
    """Words of some texts, from the first to the last letter; ``kind`` numbers the distinct ones."""

    bounds: np.ndarray
    kind: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray


def cut_words(texts: words.Texts) -> Words:
    starts, ends, owner = texts.words()
    letter = _LETTER[texts.raw]
    count = np.concatenate([[0], np.cumsum(letter)])
    places = np.flatnonzero(letter)
    has = count[ends] > count[starts]
    starts, ends, owner = starts[has], ends[has], owner[has]
    starts, ends = places[count[starts]] if len(starts) else starts, places[count[ends] - 1] + 1 if len(ends) else ends
    sums = texts.prefix()
    hashes, first, kind = np.unique(words.span(sums, starts, ends), return_index=True, return_inverse=True)
    return Words(np.searchsorted(owner, np.arange(len(texts) + 1)), kind, starts[first], ends[first], hashes, sums)


def features(w: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the distinct words, and the word each belongs to."""
    n, length = len(w.starts), w.ends - w.starts
    own = np.arange(n)
    index, owner = [w.hashes % np.uint64(BUCKETS)], [own]
    for k, (size, last) in enumerate(_EDGES):
        fits = own[length >= size]
        a = w.ends[fits] - size if last else w.starts[fits]
        index.append(words.mix(words.span(w.sums, a, a + size) + np.uint64(k + 1)) % np.uint64(BUCKETS))
        owner.append(fits)
    for size in (2, 3):
        many = np.maximum(0, length - size + 1)
        who = np.repeat(own, many)
        a = w.starts[who] + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
        index.append(words.mix(words.span(w.sums, a, a + size) + np.uint64(100 + size)) % np.uint64(BUCKETS))
        owner.append(who)
    known, code = lexicon
    if len(known):
        at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
        found = own[known[at] == w.hashes]
        index.append((BUCKETS + code[at[found]]).astype(np.uint64))
        owner.append(found)
    return np.concatenate(index).astype(np.int64), np.concatenate(owner)


def emissions(table: np.ndarray, index: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, table[index, k], n) for k in range(table.shape[1])], axis=1) if n else np.zeros((0, table.shape[1]))


def posteriors(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over all texts at once: probabilities of each word's labels.

    Texts are laid out in blocks of ``BLOCK`` words. Each block is first multiplied into one matrix, messages
    pass from block to block, and then run through all blocks side by side.
    """
    n, labels = scores.shape
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return scores
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - np.repeat(bounds[:-1], sizes)
    row, column = first[text] + place // BLOCK, place % BLOCK
    real = np.zeros((total, BLOCK), bool)
    real[row, column] = True
    emit = np.ones((total, BLOCK, labels))
    emit[row, column] = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    opens = np.zeros(total, bool)
    opens[first[blocks > 0]] = True
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for k in range(BLOCK):
        moved = product @ move
        if k == 0:
            moved[opens] = np.eye(labels)
        moved *= emit[:, k, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        product = np.where(real[:, k, None, None], moved, product)
    into, out = np.ones((total, labels)), np.ones((total, labels))
    order = np.argsort(-blocks, kind="stable")
    longest = int(blocks.max())
    for j in range(1, longest):
        at = first[order[: np.searchsorted(-blocks[order], -j, "left")]] + j  # texts of more than j blocks
        message = np.einsum("bi,bij->bj", into[at - 1], product[at - 1])
        into[at] = message / message.sum(axis=1, keepdims=True)
    for j in range(longest - 1, 0, -1):
        at = first[order[: np.searchsorted(-blocks[order], -j, "left")]] + j
        message = np.einsum("bij,bj->bi", product[at], out[at])
        out[at - 1] = message / message.sum(axis=1, keepdims=True)
    ahead = np.empty((total, BLOCK, labels))
    message = into
    for k in range(BLOCK):
        moved = message @ move
        if k == 0:
            moved[opens] = 1.0
        moved = moved * emit[:, k]
        message = np.where(real[:, k, None], moved / moved.sum(axis=1, keepdims=True), message)
        ahead[:, k] = message
    message = out
    for k in range(BLOCK - 1, -1, -1):
        ahead[:, k] *= message
        moved = (emit[:, k] * message) @ move.T
        message = np.where(real[:, k, None], moved / moved.sum(axis=1, keepdims=True), message)
    found = ahead[row, column]
    return found / found.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray
    transitions: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    def label(self, texts: words.Texts) -> tuple[Words, np.ndarray]:
        found = cut_words(texts)
        index, owner = features(found, self.lexicon)
        scores = emissions(self.table, index, owner, len(found.starts))[found.kind]
        return found, posteriors(scores, found.bounds, self.transitions)


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def _word_counts(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [cut_words(texts) for _, texts in words.slices(_lowered(batch))]
    hashes = np.concatenate([np.zeros(0, np.uint64), *[w.hashes[w.kind] for w in found]])
    return np.unique(hashes, return_counts=True)


def _lexicon(drawn: DataFrame, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``LEXICON`` most frequent words of the sample, and a code for language and purity."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        hashes, n = _word_counts(pa.array(part["text"], pa.string()))
        return pd.DataFrame({"word": hashes.view(np.int64), "lang": part["lang"].iloc[0], "n": n})

    by_lang = drawn.groupBy("part", "lang").applyInPandas(count, "word long, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    top = by_lang.groupBy("word").agg(F.sum("n").alias("all"), F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("most")).orderBy(F.desc("all"), "word").limit(LEXICON).toPandas()
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    code = top["lang"].map({x: k for k, x in enumerate(labels)}).to_numpy(np.int64) * LEXICON_BINS + np.minimum(LEXICON_BINS - 1, (top["most"] / top["all"] * LEXICON_BINS).to_numpy(np.int64))
    order = np.argsort(hashes)
    return hashes[order], code[order]


def _sequences(w: Words, label: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word kinds and labels of code-switched sequences; about as many words as there are."""
    rows = max(1, len(w.kind) // SEQUENCE)
    runs = SEQUENCE // RUN
    text = np.repeat(np.arange(len(label)), np.diff(w.bounds))
    start = rng.integers(0, max(1, len(w.kind)), (rows, runs))
    again = rng.random((rows, runs)) < 0.5  # half of the runs go on in the same place
    for k in range(1, runs):
        start[:, k] = np.where(again[:, k], start[:, k - 1] + RUN, start[:, k])
    at = np.minimum(start[:, :, None] + np.arange(RUN), len(w.kind) - 1).reshape(rows, SEQUENCE)
    return w.kind[at], label[text[at]]


def _pass(shared, turn: int):
    """A part's pass over its sequences: AdaGrad on the likelihood of the labels."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        labels, table, transitions, squares, squares_t, lexicon = shared.value
        table, transitions, squares, squares_t = table.copy(), transitions.copy(), squares.copy(), squares_t.copy()
        part = part.sort_values(["draw", "doc_id", "text"])
        column = _lowered(pa.array(part["text"], pa.string())).fill_null("")
        offsets = np.cumsum([0, *[len(x.as_py().encode()) for x in column]])
        texts = words.Texts(np.frombuffer("".join(column.to_pylist()).encode(), np.uint8), offsets)  # this part's share of SAMPLE texts
        w = cut_words(texts)
        label = part["lang"].map({x: k for k, x in enumerate(labels)}).to_numpy(np.int64)
        n = len(w.kind)
        if n:
            index, owner = features(w, lexicon)
            order = np.argsort(owner, kind="stable")
            index, size = index[order], np.bincount(owner, minlength=len(w.starts))
            begin = np.cumsum(size) - size
            kinds, wanted = _sequences(w, label, np.random.default_rng(turn))
            for a in range(0, len(kinds), BATCH):
                kind, truth = kinds[a : a + BATCH], wanted[a : a + BATCH]
                used, where = np.unique(kind, return_inverse=True)
                where = where.reshape(kind.shape)
                who = np.repeat(np.arange(len(used)), size[used])
                rows = index[np.repeat(begin[used] - np.cumsum(size[used]) + size[used], size[used]) + np.arange(len(who))]
                scores = emissions(table, rows, who, len(used))[where]
                slope, slope_t = _slopes(scores, truth, transitions)
                per_word = np.stack([np.bincount(where.ravel(), slope[..., k].ravel(), len(used)) for k in range(len(labels))], axis=1)
                touched, place = np.unique(rows, return_inverse=True)
                step = np.stack([np.bincount(place, per_word[who, k], len(touched)) for k in range(len(labels))], axis=1) / len(kind) + 1e-6 * table[touched]
                squares[touched] += step * step
                table[touched] -= STEP * step / np.sqrt(squares[touched] + 1e-8)
                squares_t += (slope_t / len(kind)) ** 2
                transitions -= STEP * slope_t / len(kind) / np.sqrt(squares_t + 1e-8)
        return pd.DataFrame({"n": [n], **{k: [x.astype(np.float32).tobytes()] for k, x in (("a", table), ("b", transitions), ("c", squares), ("d", squares_t))}})

    return one


def _slopes(scores: np.ndarray, truth: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood by word scores and transitions; all sequences have one length."""
    rows, length, labels = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions)
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, length):
        x = (ahead[:, k - 1] @ move) * emit[:, k]
        ahead[:, k] = x / x.sum(axis=1, keepdims=True)
    for k in range(length - 2, -1, -1):
        x = (emit[:, k + 1] * behind[:, k + 1]) @ move.T
        behind[:, k] = x / x.sum(axis=1, keepdims=True)
    own = ahead * behind
    own /= own.sum(axis=2, keepdims=True)
    pair = ahead[:, :-1, :, None] * move * (emit[:, 1:] * behind[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    own[np.arange(rows)[:, None], np.arange(length), truth] -= 1
    return own, pair.sum(axis=(0, 1)) - seen


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """A model from documents that are not held out and have a language; None if there are none."""
    spark = docs.sparkSession
    text_hash = F.xxhash64("text").alias("text_hash")
    known = docs.filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", text_hash)
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("of")).orderBy(F.desc("of"), "lang").limit(LANGUAGES)
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), 1).alias("draw")
    ids = known.join(F.broadcast(counts), "lang").select("doc_id", "lang", "text_hash", draw, "of").filter(F.col("draw") / float(2**63) * F.col("of") < per_language)
    # the first of each language, then the second ... : where the sample is full, frequent languages leave room to rare ones
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text_hash"))  # about ``per_language`` rows
    ids = cut(ids.drop("of").distinct().withColumn("rank", rank).orderBy("rank", "draw", "doc_id", "lang", "text_hash").limit(sample).drop("rank"), "langid")
    same = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text", F.xxhash64("text").alias("_hash"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("text_hash") == F.col("_hash"))
    drawn = same.join(F.broadcast(ids), on).select("doc_id", "lang", "text", "draw", F.pmod("draw", F.lit(PARTS)).cast("int").alias("part"))
    drawn = cut(drawn.dropDuplicates(["doc_id", "lang", "draw"]), "langid")  # at most SAMPLE texts
    labels = sorted(r["lang"] for r in drawn.select("lang").distinct().collect())  # at most SAMPLE
    if not labels:
        return None
    lexicon = _lexicon(drawn, labels)
    shapes = [(BUCKETS + LEXICON_BINS * len(labels), len(labels)), (len(labels), len(labels))] * 2
    state = [np.zeros(x, np.float32) for x in shapes]
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((labels, *state, lexicon))
        made = drawn.groupBy("part").applyInPandas(_pass(shared, turn), "n long, a binary, b binary, c binary, d binary").orderBy("n", "a").collect()  # PARTS models
        n = max(1, sum(r["n"] for r in made))
        state = [sum(np.frombuffer(r[c], np.float32).reshape(x) * np.float32(r["n"] / n) for r in made) for c, x in zip("abcd", shapes, strict=True)]
    return Model(labels, state[0], state[1], lexicon)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (mean probability of that language over the words), n_words of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, texts in words.slices(_lowered(batch.column(2))):
                n = len(texts)
                rest = [batch.column(k).slice(row, n) for k in (0, 1)]
                if model is None:
                    best, score, many = pa.array([UNKNOWN] * n), np.zeros(n), np.zeros(n, np.int64)
                else:
                    found, chance = model.label(texts)
                    many = np.diff(found.bounds)
                    total = np.concatenate([np.zeros((1, chance.shape[1])), np.cumsum(chance, axis=0)])
                    mean = (total[found.bounds[1:]] - total[found.bounds[:-1]]) / np.maximum(1, many)[:, None]
                    letters = (many > 0) & batch.column(3).slice(row, n).to_numpy(zero_copy_only=False).astype(bool)
                    best = pa.array([model.labels[k] if ok else UNKNOWN for k, ok in zip(mean.argmax(axis=1), letters, strict=True)])
                    score = np.where(letters, np.clip(mean.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*rest, best, pa.array(score), pa.array(many)], ["doc_id", "held_out", "lang_pred", "score", "n_words"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letter.alias("letters"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_words long")


def word_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, langs: the likeliest language of each word that has a letter, in text order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.labels)
        for batch in batches:
            for row, texts in words.slices(_lowered(batch.column(1))):
                found, chance = shared.value.label(texts)
                best = names[chance.argmax(axis=1)] if len(chance) else names[:0]
                langs = [best[a:b].tolist() for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(langs, pa.list_(pa.string()))], ["doc_id", "langs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, langs array<string>")
