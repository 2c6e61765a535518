"""Mixing, URL rules, classifiers, token rollups and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelight.llm import langid, mixing, quality, tokens, urls, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- words --------------------------------------------------------------------------------------


def test_words_and_shingles_are_those_of_a_regex():
    import pyarrow as pa

    texts = ["The cat  sat", None, "", " a\tb\n", "É é\u00a0x", "x" * 10, "\n\n", "one two three four five"]
    seen = []
    for row, part in words.slices(pa.array(texts)):
        starts, ends, owner = part.words()
        seen += [(row + int(o), bytes(part.raw[a:b]).decode()) for a, b, o in zip(starts, ends, owner, strict=True)]
    assert seen == [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    (_, part), = words.slices(pa.array(["A b c d e", "a B c d", "b c d e", "a b", "A B", "b a"]))
    found = [set(x.tolist()) for x, _ in words.shingles(*words.hashed(part), 4)]
    assert len(found[0]) == 2 and found[1] < found[0] and found[2] < found[0] and found[1] != found[2]
    assert found[3] == found[4] and len(found[3]) == 1 and found[3] != found[5]


# --- mixing -------------------------------------------------------------------------------------


def targets_by_hand(sizes, share=1.5):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        dealt = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if dealt[s] > 2 * sizes[s]}
        if not above:
            return target | dealt
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, "x " * rng.choice([0, 1, 5, 50, 400, rng.randrange(3000)]), "en", rng.choice(["b", "b", "b", "a", "C", "é", None, "z"]), 0) for k in range(900)] + [(k, None, "en", "empty", 0) for k in range(900, 905)]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    assert len(got) == len(rows)
    sizes = {}
    for i, t, _, s, _ in rows:
        assert got[i]["size"] == len((t or "").split())
        sizes[s] = sizes.get(s, 0) + got[i]["size"]
    want = targets_by_hand(sizes)
    taken = {}
    for i, _, _, s, _ in rows:
        assert got[i]["target"] == pytest.approx(want[s]) and got[i]["source_size"] == sizes[s]
        assert got[i]["taken"] in {0, got[i]["size"], 2 * got[i]["size"]}
        taken[s] = taken.get(s, 0) + got[i]["taken"]
    for s, n in taken.items():
        assert want[s] - 60 <= n <= want[s] + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(frame).collect()}
    assert copies == {i: r["taken"] // r["size"] for i, r in got.items() if r["taken"]}


def test_mix_edges(spark):
    frame = spark.createDataFrame([(1, "a b", "en", "s", 1), (1, "a b", "en", "s", 1), (None, None, None, None, None)], DOCS).withColumn("size", F.lit("x")).withColumn("key", F.lit("y"))
    assert sorted((r["size"], r["taken"]) for r in mixing.mix(frame).collect()) == [(0, 0), (2, 2), (2, 2)]
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0
    plan = mixing.mixed(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_newton_reaches_the_dual(spark):
    frame = spark.createDataFrame([("a", 100, 150.0), ("b", 100, 200.0), ("c", 1000, 1.0), ("d", 0, 0.0), ("e", 5, 0.0)], "source string, source_size long, target double")
    found = {r["source"]: r["dual"] for r in mixing.duals(frame).collect()}
    assert found["a"] == pytest.approx(np.log(1.5)) and found["b"] == pytest.approx(np.log(2)) and found["c"] == pytest.approx(np.log(0.001)) and found["d"] is None and found["e"] is None


# --- URLs ---------------------------------------------------------------------------------------


def judged_by_hand(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for v, r in urls.GIVEN if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_given_rules_and_parts(spark):
    links = [
        "http://WWW.Example.org/es/1?x=/a#b", "https://a.example.org/en/12", "https://example.org/en/2", "https://notexample.org/es/", "https://x.com/fr/", "https://x.com/fr", "https://x.com", "ftp://org/", "com/de/", None,
        "", "https://x.com/de/#", "https://example.org.com/de/x", "a://b://c/de/", "http://É.com/FR/", "http://x.org?q", "http://.org/y", "://org/",
    ]
    pages = spark.createDataFrame(list(enumerate(links)), "page_id long, url string").withColumn("rule", F.lit("mine")).withColumn("tokens", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, none, urls.given_rules(spark)).collect()}
    want = {k: judged_by_hand(u) for k, u in enumerate(links)}
    assert got == {k: (h, p, r, v or "allow") for k, (h, p, r, v) in want.items()}
    assert urls.judge(pages.limit(0), none, urls.given_rules(spark)).count() == 0


def test_mined_rules_block_what_the_labels_show(spark):
    rng = random.Random(6)
    pages, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        site = "pills" if bad else rng.choice(["news", "blog"])
        pages.append((k, f"https://{site}.site{rng.randrange(4)}.net/{rng.choice(['en', 'fr'])}/{k}"))
        if k % 3:
            labels.append((k, 0 if bad else 1, 0))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame, marks, urls.given_rules(spark)).collect()}
    assert got == {k: "block" if k % 4 == 0 else "allow" for k in range(400)}


def test_mined_rules_equal_counting(spark):
    rng = random.Random(8)
    rows = [([t for t in "abcd" if rng.random() < 0.5], rng.random() < 0.4) for _ in range(300)]
    frame = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {}
    for r in urls.mine(frame, 0.02, 0.3).collect():
        got.setdefault(r["rule_id"], (set(), r["confidence"]))[0].add(r["token"])
    from itertools import combinations

    full = [(set(t), b) for t, b in rows if t]
    counted = {}
    for n in (1, 2, 3, 4):
        for x in combinations("abcd", n):
            has = [b for t, b in full if set(x) <= t]
            if has and sum(has) / len(full) >= 0.02 and sum(has) / len(has) >= 0.3:
                counted[frozenset(x)] = sum(has) / len(has)
    want = {x: c for x, c in counted.items() if not any(y < x and d >= c - 1e-12 for y, d in counted.items())}
    assert {frozenset(x): pytest.approx(c) for x, c in got.values()} == want


# --- classifiers --------------------------------------------------------------------------------


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    good, bad = ["river", "stone", "house", "green", "water", "walked"], ["BUY!!", "###", "WIN!!", "$$$"]
    rows, marks = [], []
    for k in range(400):
        ok = k % 3 != 0
        rows.append((k, " ".join(rng.choice(good if ok or rng.random() < 0.2 else bad) for _ in range(rng.randrange(5, 60))), "en", "s", 0))
        marks.append((k, int(ok), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "stone " * 30000, "en", "s", 0), (None, "river stone", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([*marks, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark, labelled):
    docs, marks = labelled
    out = quality.scored(docs.withColumn("score", F.lit("mine")), quality.fit(docs, marks)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]))
    tested = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in tested) >= 0.95 * len(tested)


def test_quality_without_labels_and_on_empty_tables(spark, labelled):
    docs, marks = labelled
    none = quality.fit(docs, marks.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), none).count() == 0 and quality.accepted(docs.limit(0), none).columns == docs.columns


def test_pair_sum_is_the_sum_over_pairs():
    model = quality.Model(quality.Model.start())
    rng = np.random.default_rng(0)
    model.table[:] = rng.normal(0, 0.3, model.table.shape)
    index, value = np.array([3, 77, 500, 8195]), np.array([0.5, -1.0, 2.0, 0.25])
    v = model.table[index, 1:]
    pairs = sum((v[a] @ v[b]) * value[a] * value[b] for a in range(4) for b in range(a))
    assert model.raw(index, value)[0] == pytest.approx(float(value @ model.table[index, 0] + pairs), rel=1e-4)


SYLLABLES = {"aa": ("ka", "ri", "mo", "tu"), "bb": ("sch", "ei", "ung", "ver"), "cc": ("é", "aux", "oui", "tion")}


def test_languages_on_held_out_and_switched_texts(spark):
    rng = random.Random(10)

    def text(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n))

    rows = [(k, text(lang, rng.randrange(5, 80)), lang, "s", 0) for k, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    odd = [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "12 !! 34", "bb", "s", 0), (1003, text("bb", 20000), None, None, 0), (None, "kari", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    model = langid.fit(docs)
    out = langid.predicted(docs.withColumn("letters", F.lit("x")), model).collect()
    assert len(out) == len(rows) + len(odd)
    found = {r["doc_id"]: r for r in out}
    tested = [(k, lang) for k, _, lang, _, _ in rows if held(k)]
    assert all(found[k]["held_out"] for k, _ in tested)
    assert sum(found[k]["lang_pred"] == lang for k, lang in tested) >= 0.97 * len(tested)
    assert {k: found[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)} == {1000: "und", 1001: "und", 1002: "und", 1003: "bb"}
    assert all(0 <= r["score"] <= 1 for r in out) and found[1001]["score"] == 0
    mixed = spark.createDataFrame([(1, text("aa", 30) + " " + text("cc", 30) + " 99 " + text("bb", 30))], "doc_id long, text string")
    langs = langid.word_labels(mixed, model).first()["langs"]
    want = ["aa"] * 30 + ["cc"] * 30 + ["bb"] * 30
    assert len(langs) == 90 and sum(a == b for a, b in zip(langs, want)) >= 84
    assert langid.fit(docs.limit(0)) is None and {r["lang_pred"] for r in langid.predicted(docs, None).collect()} == {"und"}


def test_rare_languages_keep_their_place_in_a_full_sample(spark):
    rows = [(1000 * k + i, f"{lang} {lang}word {i}", lang, "s", 9) for k, lang in enumerate(("aa", "bb", "cc", "dd")) for i in range(800)] + [(9000 + i, f"rare rareword {i}", "ee", "s", 9) for i in range(12)]
    drawn = langid.fit(spark.createDataFrame(rows, DOCS), per_language=10, sample=20)
    assert drawn.labels == ["aa", "bb", "cc", "dd", "ee"]


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, moves, bounds = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 9])
    got = langid.posteriors(scores, bounds, moves)
    for a, b in ((0, 4), (4, 9)):
        total = np.zeros((b - a, 3))
        for path in product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + k, p] for k, p in enumerate(path)) + sum(moves[p, q] for p, q in zip(path, path[1:])))
            for k, p in enumerate(path):
                total[k, p] += w
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))


# --- token rollups ------------------------------------------------------------------------------


def test_rollup_is_the_sum_of_its_batches_and_ignores_replays(spark, tmp_path):
    rows = [(1, "hello world", "en", "a", 0), (2, "hello world", "en", "a", 0), (3, None, None, None, 0), (4, "", "fr", "a", 0), (5, "x" * 50000, "fr", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tokens", F.lit("mine"))
    own = tokens.encoding(TOKENIZER)
    counts = tokens.counted(docs, TOKENIZER, "v1")
    assert {r["doc_id"]: r["tokens"] for r in counts.collect()} == {i: len(own.encode_ordinary(t or "")) for i, t, *_ in rows}
    rollup = tokens.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("load", lambda: tokens.inserts(counts))
    assert not rollup.commit("load", lambda: 1 / 0)
    assert rollup.commit("none", lambda: tokens.inserts(counts.limit(0)))
    n, m = len(own.encode_ordinary("hello world")), len(own.encode_ordinary("x" * 50000))

    def totals():
        return {(r["source"], r["lang"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}

    assert totals() == {("a", "en", "v1"): (2, 2 * n), (None, None, "v1"): (1, 0), ("a", "fr", "v1"): (1, 0), ("b", "fr", "v1"): (1, m)}
    assert {r["doc_id"] for r in tokens.later_copies(counts).collect()} == {2}
    rollup.commit("gone", lambda: tokens.deletes(counts.filter("doc_id in (2, 3)")))
    five = counts.filter("doc_id = 5")
    rollup.commit("anew", lambda: tokens.revisions(five, five.withColumn("tokenizer_version", F.lit("v2")).withColumn("tokens", F.lit(7).cast("long"))))
    (tmp_path / "rollup" / "rows" / "lost").mkdir()  # a writer that never committed
    (tmp_path / "rollup" / "commits" / "died").touch()  # a writer that made its record and died before naming its rows
    assert totals() == {("a", "en", "v1"): (1, n), ("a", "fr", "v1"): (1, 0), ("b", "fr", "v2"): (1, 7)}
    assert not rollup.committed("died") and rollup.commit("died", lambda: tokens.inserts(counts.filter("doc_id = 4")))
    assert rollup.committed("died") and not rollup.commit("died", lambda: 1 / 0)
    assert totals() == {("a", "en", "v1"): (1, n), ("a", "fr", "v1"): (2, 0), ("b", "fr", "v2"): (1, 7)}
    assert not rollup._publish("died", "rows/other") and totals()[("a", "fr", "v1")] == (2, 0)  # the second of two writers
    with pytest.raises(ValueError, match="batch"):
        rollup.commit("../x", lambda: tokens.inserts(counts))


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    good, bad = [f"{a}{b}" for a in ("ri", "sto", "hou", "gre", "wa") for b in ("ver", "ne", "se", "en", "ter", "lk")], ["BUY!!", "###", "WIN!!", "$$$"]

    def prose(n, of):
        return " ".join(rng.choice(of) for _ in range(n))

    item = prose(25, good)
    rows = [(k, "\n".join(prose(30, good) for _ in range(3)), "en", f"s{k % 3}", 0) for k in range(200)]
    rows += [(200 + k, prose(80, bad), "en", "s0", 0) for k in range(60)]
    rows += [(300, rows[0][1], "en", "s1", 0)]  # a copy: all its lines go
    near = prose(100, good)
    rows += [(301, near, "en", "s1", 0), (302, " ".join(x if k not in (20, 70) else "else" for k, x in enumerate(near.split())), "en", "s1", 0)]
    rows += [(303, prose(20, good) + " " + item + " " + prose(20, good), "en", "s2", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(not 200 <= k < 260), 0) for k in range(260)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(200))
    assert kept[0] == clean | {300, 301, 302, 303}
    assert kept[1] == clean | {301, 302, 303}
    assert kept[2] == clean | {301, 303}
    assert kept[3] == clean | {301}
    assert kept[4] <= kept[3] and docs.columns[-1] == "copies"
    assert [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
