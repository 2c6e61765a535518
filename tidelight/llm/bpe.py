"""Byte-level byte-pair encoding of a corpus by merge replay, and decoding.

A word (a match of the split pattern) has the same tokens wherever it stands, so the merges are replayed once for
the distinct words of the whole corpus and not for its texts:

1. Texts are split once. A slice of texts becomes the sequence of word numbers of every text (two bytes each, as a rule), its
   words that are tokens as they stand, and its other distinct words in buckets by hash. All of it is packed and dealt out by slice, once.
2. The buckets of all slices are dealt out by bucket, so that a word of the corpus is replayed in one place. There an inverted index leads from
   token pairs, by the rank of what they merge into, to their places in the words. Ranks are applied in order, each to all
   places of its index entry; a merge looks only at the two neighbours it touches and enters their new pairs.
3. Tokens return to their slice, which lines up the tokens of its texts.

No group is larger than one slice (``SLICE`` characters of text, or one text where it is longer) or one bucket (the words of
a shuffle partition before small ones are joined). Replay takes ``BLOCK`` bytes of words at a time (one word at least). Step 1 reads ``docs`` in one pass whose parts both other steps read; a lost part is made again, so
``docs`` should be a table of files (``cut`` a computed one), whose rows come in the same order again.

Defined cases: a null or empty text has no tokens. Rows that repeat, share an id or have none each give a row. Texts that look like
special tokens are ordinary text. Word length is not limited. An empty table gives an empty result; other columns
are not looked at. Decoding null gives null, of no tokens the empty string; an id outside the vocabulary stops the job.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

SLICE, BLOCK = 16 << 20, 1 << 18
_LOADED: dict[int, Vocabulary] = {}


class Vocabulary:
    """Byte strings by rank; pairs are looked up by what they merge into."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.texts = {t.decode(): r for r, t in enumerate(tokens) if _is_text(t)}
        single = [bytes([b]) for b in range(256)]
        self.byte = np.array([self.ranks[b] for b in single], np.int64)
        self.two = np.array([[self.ranks.get(a + b, -1) for b in single] for a in single], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, or -1."""
        pair = (a, b)
        rank = self.pairs.get(pair)
        if rank is None:
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            rank = self.pairs[pair] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokens of a rank file for all tasks: as large as the file, whatever the corpus."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0, 1, 2 and on")
    return spark.sparkContext.broadcast([t for _, t in ranked])


def _loaded(shared: Broadcast) -> Vocabulary:
    key = id(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(shared.value)
    return _LOADED[key]


# ---- merges ----------------------------------------------------------------------------------


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Token ids of each word: all merges of all words, rank by rank."""
    whole = [v.ranks.get(w) for w in words]  # a word that is a token needs no merge
    parts = [w for w, rank in zip(words, whole, strict=True) if rank is None]
    raw = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    last = np.cumsum([len(w) + 1 for w in parts], dtype=np.int64) - 1  # the gap behind each word: there nothing merges
    n = len(raw)
    numbers = v.byte[raw]
    numbers[last] = -1
    near = v.two[raw[:-1], raw[1:]] if n else np.zeros(0, np.int64)
    near[last[:-1]] = near[last - 1] = -1
    at = np.flatnonzero(near >= 0)
    at = at[np.argsort(near[at], kind="stable")]
    ranks, begin = np.unique(near[at], return_index=True)
    index = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(at, begin[1:]), strict=True)} if len(at) else {}
    held_as = list if n <= 4 * BLOCK else lambda x: array("q", x)  # one very long word: no object per symbol
    token, left, right = held_as(numbers.tolist() if n <= 4 * BLOCK else numbers), held_as(range(-1, n - 1)), held_as(range(1, n + 1))
    queue = list(index)
    heapify(queue)
    merged, ends = v.merged, last.tolist()

    def enter(rank: int, place: int) -> None:
        places = index.get(rank)
        if places is None:
            index[rank] = [place]
            heappush(queue, rank)
        else:
            places.append(place)

    while queue:
        rank = heappop(queue)
        held = -1  # words up to here wait: one of their new pairs has a lower rank
        for p in sorted(index.pop(rank, ())):
            if p < held:
                enter(rank, p)
                continue
            a, q = token[p], right[p]
            if a < 0 or token[q] < 0 or merged(a, token[q]) != rank:
                continue  # one side went into another merge
            r, o = right[q], left[p]
            token[p], token[q], right[p], left[r] = rank, -2, r, p
            if token[r] >= 0 and (new := merged(rank, token[r])) >= 0:
                enter(new, p)
                held = ends[bisect_right(ends, p)] if new < rank else held
            if o >= 0 and token[o] >= 0 and (new := merged(token[o], rank)) >= 0:
                enter(new, o)
                held = ends[bisect_right(ends, p)] if new < rank else held
    out, spans = [], zip([0, *(e + 1 for e in ends)], ends)
    for rank in whole:
        if rank is None:
            a, b = next(spans)
            out.append([t for t in token[a:b] if t >= 0])
        else:
            out.append([rank])
    return out


# ---- packed rows -----------------------------------------------------------------------------


def _zip(*parts: np.ndarray | bytes) -> bytes:
    """Parts packed into one value. Numbers go byte plane by byte plane: high bytes are mostly alike."""
    raw = [p if isinstance(p, bytes) else p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts]
    whole = b"".join(raw)
    return np.array([len(p) for p in raw], np.int64).tobytes() + (pa.compress(whole, "zstd", asbytes=True) if whole else b"")


def _unzip(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    total = int(sizes.sum())
    whole = pa.decompress(data[8 * len(kinds) :], total, "zstd", asbytes=True) if total else b""
    ends = np.cumsum(sizes).tolist()
    planes = [np.frombuffer(whole[e - n : e], np.uint8).reshape(np.dtype(k).itemsize, -1) for e, n, k in zip(ends, sizes.tolist(), kinds, strict=True)]
    return [np.ascontiguousarray(p.T).view(k).ravel() for p, k in zip(planes, kinds, strict=True)]


def _steps(numbers: np.ndarray) -> np.ndarray:
    return np.diff(numbers, prepend=np.int32(0)).astype(np.int32)


def _replayed(shared: Broadcast):
    """Tokens of word rows (slice, bucket, packed) sorted by bucket: each word of a bucket is replayed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(shared)
        rows, now = [], None

        def finished() -> Iterator[pa.RecordBatch]:
            index, asked = _Numbers(), []
            for _, packed in rows:
                steps, lengths, raw = _unzip(packed, np.int32, np.uint32, np.uint8)
                text, ends = raw.tobytes(), np.cumsum(lengths).tolist()
                asked.append((steps, [index[text[e - n : e]] for e, n in zip(ends, lengths.tolist(), strict=True)]))
            made, block, size = [], [], 0
            for k, word in enumerate(index):
                block.append(word)
                size += len(word)
                if size >= BLOCK or k == len(index) - 1:
                    made += replay(block, v)
                    block, size = [], 0
            out = []
            for steps, places in asked:
                ids = [made[k] for k in places]
                out.append(_zip(steps, np.array([len(x) for x in ids], np.uint32), np.fromiter(chain.from_iterable(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array(out, pa.binary())], ["slice", "packed"])

        for batch in batches:
            for place, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and rows:
                    yield from finished()
                    rows = []
                now = bucket
                rows.append((place, packed))
        if rows:
            yield from finished()

    return run


# ---- texts -----------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str | bytes) -> int:
        self[word] = number = len(self)
        return number


def _width(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def _split(pattern: str, shared: Broadcast, buckets: int):
    """A row (slice, doc_ids, packed) for each slice, and rows (slice, bucket, packed) with its words that are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, find, rank_of = TaskContext.get().partitionId() << 32, regex.compile(pattern), _loaded(shared).texts
        ids, sequences, numbers, size, kind = [], [], _Numbers(), 0, None

        def finished() -> Iterator[pa.RecordBatch]:
            sequence = np.concatenate([np.zeros(0, np.uint32), *sequences])
            # frequent words get small numbers
            turn = np.argsort(-np.bincount(sequence, minlength=len(numbers)), kind="stable")
            place = np.empty(len(turn), np.uint32)
            place[turn] = np.arange(len(turn), dtype=np.uint32)
            every = list(numbers)
            every = [every[k] for k in turn.tolist()]
            known = np.array([rank_of.get(w, -1) for w in every], np.int32)
            words = [w.encode() for w, k in zip(every, known.tolist(), strict=True) if k < 0]
            number = np.flatnonzero(known < 0).astype(np.int32)
            bucket = np.fromiter(map(crc32, words), np.uint32, len(words)) % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            full, begin = np.unique(bucket[order], return_index=True)
            packed = [_zip(known, np.array([len(s) for s in sequences], np.int64), place[sequence].astype(_width(len(known))))]
            for at in np.split(order, begin[1:]) if len(order) else []:
                some = [words[k] for k in at.tolist()]
                packed.append(_zip(_steps(number[at]), np.array([len(w) for w in some], np.uint32), b"".join(some)))
            yield pa.RecordBatch.from_arrays([
                pa.array([here] * len(packed), pa.int64()), pa.array([ids] + [None] * len(full), pa.list_(kind)),
                pa.array([None, *full.tolist()], pa.int64()), pa.array(packed, pa.binary())], ["slice", "doc_ids", "bucket", "packed"])

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                # a long text does not keep all its words at once
                words = find.findall(text) if len(text) < BLOCK else (m.group() for m in find.finditer(text))
                ids.append(doc_id)
                sequences.append(np.fromiter(map(numbers.__getitem__, words), np.uint32))
                size += len(text) + 64
                if size >= SLICE:
                    yield from finished()
                    ids, sequences, numbers, size, here = [], [], _Numbers(), 0, here + 1
        if ids:
            yield from finished()

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word rows of the split texts."""
    for batch in batches:
        rows = batch.filter(pc.is_valid(batch.column(2)))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3)], ["slice", "bucket", "packed"])


def _lined_up(key: tuple, rows: pa.Table, made: pa.Table) -> pa.Table:
    """Tokens of the texts of one slice."""
    main = rows.filter(pc.is_null(rows.column("bucket"))).combine_chunks()
    packed = main.column("packed")[0].as_py()
    words = int(np.frombuffer(packed, np.int64, 1)[0]) // 4
    known, lengths, sequence = _unzip(packed, np.int32, np.int64, _width(words))
    many, begin = (known >= 0).astype(np.int32), np.arange(words, dtype=np.int32)
    flat, end = [known], words
    for other in made.column("packed"):
        steps, length, ids = _unzip(other.as_py(), np.int32, np.uint32, np.int32)
        number = np.cumsum(steps)
        many[number] = length
        begin[number] = end + np.cumsum(length, dtype=np.int64) - length
        flat.append(ids)
        end += len(ids)
    flat = np.concatenate(flat)
    out = np.empty(int(np.dot(np.bincount(sequence, minlength=words), many.astype(np.int64))), np.int32)
    at, ends = 0, [0]
    for n in lengths.tolist():
        s = sequence[at : at + n]
        at += n
        m = many[s]
        run = np.cumsum(m, dtype=np.int64)
        total = int(run[-1]) if n else 0
        out[ends[-1] : ends[-1] + total] = flat[np.repeat(begin[s] - run + m, m) + np.arange(total)]
        ends.append(ends[-1] + total)
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
    return pa.table([main.column("doc_ids").combine_chunks().flatten(), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, shared: Broadcast, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every row; ``docs``: doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("doc_id", "cast(text as string) as text")
    split = rows.mapInArrow(_split(pattern, shared, buckets), f"slice long, doc_ids array<{kind}>, bucket long, packed binary").repartition("slice")
    # chosen in Python, so that both readers keep the whole exchange and Spark makes it once
    words = split.mapInArrow(_words, "slice long, bucket long, packed binary")
    made = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_replayed(shared), "slice long, packed binary")
    return split.groupBy("slice").cogroup(made.groupBy("slice")).applyInArrow(_lined_up, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, shared: Broadcast) -> DataFrame:
    """The table with a column ``decoded`` (binary): the bytes of its ``ids``."""
    names = [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(shared)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            made = [b"".join(map(v.tokens.__getitem__, _checked(x.values, len(v.tokens)))) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def _checked(ids: pa.Array, size: int) -> list[int]:
    numbers = np.asarray(ids, np.int64)
    if len(numbers) and not 0 <= numbers.min() <= numbers.max() < size:
        raise ValueError("a token id is not in the vocabulary")
    return numbers.tolist()
