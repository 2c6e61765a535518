"""Byte-pair encoding, hard negatives and importance resampling against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight.llm import bpe, importance, queries, rtree

public = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string"


# --- byte-pair encoding -------------------------------------------------------------------------


def reference(path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(rng):
    signs = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", " ", " ", "\x1c", "é", "ß", "日本", "한", "й", "💡", "'s", "'LL", "1", "２", "٣", ".", "!?", "<|endoftext|>", "\x00", "é", "Ⅷ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*texts, None, "", " ", "a" * 5000, "ab" * 4000, "é" * 3000, "word " * 3000, "\n" * 500 + "x", "antidisestablishmentarianism", "zzzzzzzz" * 9]


def test_bpe_equals_the_public_library_and_decodes(spark):
    path = public.path("byte_bpe_50k.tiktoken")
    own, texts = reference(path), odd_texts(random.Random(1))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    shared = bpe.vocabulary(spark, path)
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("slice", F.lit(1)).repartition(3)
    got = sorted(((r["doc_id"], bytes(r["decoded"]), r["ids"]) for r in bpe.decode(bpe.encode(docs, shared, public.PATTERN), shared).collect()), key=repr)
    want = sorted(((i, (t or "").encode(), own.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert got == want


def test_bpe_in_small_slices_is_the_same(spark, monkeypatch):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    own, texts = reference(path), odd_texts(random.Random(2))
    shared = bpe.vocabulary(spark, path)
    v = bpe.Vocabulary(shared.value)
    words = [w.encode() for t in texts for w in bpe.regex.findall(public.PATTERN, t or "")]
    want = [own.encode_ordinary(w.decode()) for w in words]
    assert bpe.replay(words, v) == want
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "BLOCK", 20)
    assert bpe.replay(words, v) == want  # in arrays instead of lists

    class Task:
        def partitionId(self):
            return 3

    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task()))
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = list(bpe._split(public.PATTERN, shared, 7)(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 50 and len({p.column("slice")[0].as_py() for p in parts}) == len(parts)
    seen = {}
    for part in parts:
        made = pa.Table.from_batches(bpe._replayed(shared)(bpe._words(iter([part]))), pa.schema({"slice": pa.int64(), "packed": pa.binary()}))
        lined = bpe._lined_up((part.column("slice")[0],), pa.Table.from_batches([part]), made)
        seen.update({r["doc_id"]: r["ids"] for r in lined.to_pylist()})
    assert seen == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_merges_that_make_an_earlier_rank_come_first():
    # "ab" (258) makes "abc" (256) possible, which goes before the second "ab" of the word
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"cab", b"ab"]
    v = bpe.Vocabulary(tokens)

    def by_hand(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [v.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [v.ranks[p] for p in parts]

    rng = random.Random(0)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))).encode() for _ in range(400)]
    assert bpe.replay(words, v) == [[v.ranks[w]] if w in v.ranks else by_hand(w) for w in words]


def test_bpe_of_an_empty_table_and_foreign_ids(spark):
    shared = bpe.vocabulary(spark, public.path("byte_bpe_50k.tiktoken"))
    assert bpe.encode(spark.createDataFrame([], DOCS), shared, public.PATTERN).count() == 0
    frame = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(frame, shared).collect()} == {1: None, 2: b"", 3: b'!"'}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), shared).collect()


def test_op11_columns(spark):
    sf = "/root/testdata/sf0.001"
    own = reference(public.path("byte_bpe_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- hard negatives -----------------------------------------------------------------------------

VECTORS = "id long, label int, vector array<float>"


def mined_by_hand(rows, every, scale=256, positives=5, negatives=3):
    v = {i: (lab, [math.floor(scale * float(np.float32(x))) for x in vec]) for i, lab, vec in rows}
    out = []
    for a in sorted(v):
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v[a][1], v[b][1])) for b in v if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if v[b][0] == v[a][0]][:positives]:
            near = [b for b in order if v[b][0] != v[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:negatives]
            out += [(a, p, n + 1, b, score[p], score[b]) for n, b in enumerate(near)]
    return sorted(out)


def mined(spark, rows, every, shard):
    frame = spark.createDataFrame(rows, VECTORS).withColumn("shard", F.lit("clash")).repartition(3)
    points = rtree.points(frame)
    return sorted(tuple(r) for r in rtree.mine(points, points.filter(f"id % {every} = 0"), shard=shard).collect())


@pytest.mark.parametrize("kind", ["plain", "clusters", "ties"])
def test_hard_negatives_against_brute_force(spark, kind):
    rng = np.random.default_rng({"plain": 1, "clusters": 2, "ties": 3}[kind])
    n, d = 700, 6
    if kind == "plain":
        x, label = rng.normal(size=(n, d)), rng.integers(0, 4, n)
    elif kind == "clusters":
        middle = rng.normal(size=(9, d)) * 4
        at = rng.integers(0, 9, n)
        x, label = middle[at] + rng.normal(size=(n, d)) * 0.3, at % 3
    else:  # a third of all rows are one vector, and scores repeat
        x, label = rng.integers(-2, 3, (n, d)) / 256, rng.integers(0, 2, n)
        x[: n // 3] = 2 / 256
    rows = [(i, int(lab), [float(c) for c in vec]) for i, (lab, vec) in enumerate(zip(label, x))]
    want = mined_by_hand(rows, 10)
    assert want and mined(spark, rows, 10, 90) == want


def test_hard_negatives_leave_out_what_takes_no_part(spark):
    good = [(i, i % 2, [float(i + 1), 3.0]) for i in range(0, 40)]
    bad = [(100, None, [1.0, 1.0]), (110, 1, None), (120, 1, [1.0, None]), (130, 1, [float("nan"), 1.0]), (140, 0, [float("inf"), 1.0]), (150, 1, [1.0]), (None, 1, [1.0, 1.0]), (160, 1, [1e30, 1.0])]
    again = [good[3], good[10], (20, 5, [9.0, 9.0])]  # 20 keeps its smaller label
    assert mined(spark, good + bad + again, 10, 8192) == mined_by_hand(good, 10)
    assert mined(spark, [], 10, 8192) == []
    assert mined(spark, [(0, 1, [1.0])], 10, 8192) == []
    huge = [(i, i % 2, [float(2**18 - i), float(2**18 - 7 * i)]) for i in range(30)]  # beyond 2^53 at scale 256
    assert mined(spark, huge, 10, 16) == mined_by_hand(huge, 10)


def test_boxes_leave_rows_out_when_there_are_clusters():
    rng = np.random.default_rng(4)
    middle = rng.integers(-500, 500, (20, 8))
    v = middle[np.arange(4000) % 20] + rng.integers(-9, 10, (4000, 8))
    tree = rtree.Tree(np.arange(4000), np.arange(4000) % 20, v)
    seen = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree.exact = tree.exact.view(Counting)
    import pyarrow as pa

    asked = rtree.Queries(pa.table({"id": [0], "label": [0], "v": [v[0].tolist()], "floors": [[-(1 << 62)]], "caps": [[1 << 62]]}))
    found = list(tree.search(asked, True, 5))
    score = v @ v[0]
    order = [i for i in sorted(range(4000), key=lambda i: (-score[i], i)) if i % 20 == 0 and i != 0][:5]
    assert [(i, s) for _, _, i, s in found] == [(i, int(score[i])) for i in order]
    assert sum(seen) < 1000


# --- importance resampling ----------------------------------------------------------------------


def words_of(text):
    out, now = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            now += c
        elif now:
            out, now = [*out, now], ""
    return [*out, now] if now else out


def runs_of(words):
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled_by_hand(rows, target, percent=5, least=20, buckets=10_000, seed=42):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for run in runs_of(words_of(text)):
                into[bucket(run)] += 1
    total_s, total_t = sum(s), sum(t)
    out = []
    for i, text in rows:
        words = words_of(text)
        gain = [math.floor(1000 * math.log(float(t[b] + 1) * (total_s + buckets) / (float(s[b] + 1) * (total_t + buckets)))) for b in map(bucket, runs_of(words))]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(gain), sum(gain), sum(gain) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], 2**63 - 1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_against_plain_counting(spark):
    rng = random.Random(5)
    def text():
        return "".join(rng.choice(["the", "The", "é", "x9", "Ünder", "日本", "fox"]) + rng.choice([" ", "  ", "-", "\n", "/", "a"]) for _ in range(rng.randrange(80)))
    rows = [(i, text()) for i in range(400)] + [(400, None), (401, ""), (402, "!!"), (None, text() * 3), (403, "fox the " * 30_000)]
    target = [text() for _ in range(20)] + [None]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"rank": F.lit(1), "a": F.lit(2), "_row": F.lit("clash")}).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit("clash"))
    for percent in (5, 100):
        got = sorted((tuple(r) for r in importance.resample(docs, goal, percent=percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
        assert got == resampled_by_hand(rows, target, percent)
    ranked = importance.resample(docs, goal)
    assert importance.drawn(docs, ranked).count() == ranked.filter("rank is not null").count()


def test_long_texts_in_pieces_give_the_same_runs(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["a", "bb", "ccc", "dddddddddd"]) for _ in range(500)) + "  "
    whole = sorted(np.concatenate([b for _, b in importance.run_buckets(text.encode())]).tolist())
    for piece in (1, 7, 50, 10_000):
        monkeypatch.setattr(importance, "PIECE", piece)
        got = list(importance.run_buckets(text.encode()))
        assert sum(n for n, _ in got) == 500
        assert sorted(np.concatenate([b for _, b in got]).tolist()) == whole
    assert sorted(whole) == sorted(zlib.crc32(r.encode()) % 10_000 for r in runs_of(words_of(text)))


def test_repeated_and_few_rows(spark):
    same = [(7, "a b c " * 10)] * 60  # equal keys at the cutoff
    goal = spark.createDataFrame([("a b",)], "text string")
    rows = importance.resample(spark.createDataFrame(same, DOCS), goal).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3] and len(rows) == 60
    assert [r["rank"] for r in importance.resample(spark.createDataFrame(same[:19], DOCS), goal).collect()] == [None] * 19
    assert importance.resample(spark.createDataFrame([], DOCS), goal).count() == 0
    assert importance.resample(spark.createDataFrame(same, DOCS), goal.limit(0)).filter("rank is not null").count() == 3


def test_selection_finds_every_rank(spark):
    rng = random.Random(7)
    keys = [(rng.randrange(5), rng.randrange(40)) for _ in range(200)] + [(3, 3)] * 90
    frame = spark.createDataFrame(keys, "a long, b long").repartition(6)
    order = sorted(keys)
    for k in (1, 2, 100, 150, 289, 290):
        assert importance.kth_key(frame, k) == order[k - 1]
    assert importance.kth_key(frame, 291) is None


def test_op13_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_importance_resampling(spark, sf).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == resampled_by_hand(rows, target)
