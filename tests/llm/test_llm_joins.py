"""Line dedup, Jaccard groups, decontamination, Hamming search and licence scans against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelight.llm import graph, hamming, jaccard, leaks, licenses, lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS).repartition(3)


def prose(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, times):
    w = text.split(" ")
    for _ in range(times):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"x{rng.randrange(9)}"], [w[k], f"x{rng.randrange(9)}"]])
    return " ".join(w)


# --- components ---------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(20)]
    star = [(100, k) for k in range(101, 140)]
    frame = spark.createDataFrame([*chain, *star, (500, 501), (501, 500), (7, 7)], "u long, v long")
    found = {r["node"]: r["component"] for r in graph.components(frame).collect()}
    assert found == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 140)}, 500: 500, 501: 500}
    assert graph.components(frame.limit(0)).count() == 0


# --- line dedup ---------------------------------------------------------------------------------


def lines_by_hand(rows, shortest):
    forms = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            form = re.sub(r"[\x20\x09-\x0D]+", " ", line).lower().strip(" ")
            if form:
                forms.append(((i, k), form))
    first = {}
    for place, form in sorted(forms):
        first.setdefault(form, place)

    def near(a, b):
        a, b = a.split(" "), b.split(" ")
        if min(len(a), len(b)) < shortest or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    gone = {p for p, f in forms if first[f] != p or any(first[g] < first[f] and near(f, g) for g in first if g != f)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, n) for n in (7, 8, 9, 12, 30)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(6)) for _ in range(25)]
    texts += [None, "", "\n\n", "  A  b\t\na B", "é" * 5 + "\nÉ" * 2, "w1 " * 5000]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(spark, texts)).collect()}
    assert got == lines_by_hand(rows, lines.SHORTEST)


def test_lines_of_few_repeated_words_against_brute_force(spark):
    rng = random.Random(11)
    flags = [" ".join(rng.choice("01") for _ in range(n)) for n in (9, 9, 10, 10, 10, 11) for _ in range(12)]
    long = " ".join(rng.choice("ab") for _ in range(3 * lines.BLOCK))
    cut = long.split(" ")
    texts = ["a x b a y b a z b", "a y b a x b a z b", "a y b a x b a z b w", "\n".join(flags), long, *[" ".join(cut[:k] + cut[k + 1 :]) for k in (0, lines.BLOCK - 1, lines.BLOCK, 3 * lines.BLOCK - 1)]]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(spark, texts)).collect()}
    assert got == lines_by_hand(list(enumerate(texts)), lines.SHORTEST) and got[2] == ""


def test_line_counts_repeated_rows_null_ids_and_clashing_columns(spark):
    frame = docs_of(spark, ["one\ntwo", "one\ntwo", "two\nthree", "three"], [5, 5, 6, None]).withColumn("n_lines", F.lit("mine")).withColumn("gone", F.lit(1))
    out = [tuple(r) for r in lines.dedup(frame).select("doc_id", "text", "n_lines", "n_dropped", "gone").collect()]
    assert sorted(out, key=str) == sorted([(5, "one\ntwo", 2, 0, 1), (5, "one\ntwo", 2, 0, 1), (6, "three", 2, 1, 1), (None, "", 1, 1, 1)], key=str)
    assert lines.dedup(frame.limit(0)).count() == 0


def test_shortened_leaves_out_emptied_documents_only(spark):
    out = lines.shortened(docs_of(spark, ["one\n", "one", "", None, "one\nmore"]))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {0: ("one\n", 4), 2: ("", 0), 3: (None, 0), 4: ("more", 4)}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_line_dedup_runs_no_python(spark):
    plan = lines.dedup(docs_of(spark, ["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


# --- Jaccard ------------------------------------------------------------------------------------


def groups_by_hand(rows, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    found = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(found):
        for j, b in found[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in found}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_groups_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    base = [prose(rng, n, 200) for n in (3, 40, 120, 700, 1500)]
    texts = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4, 8])) for _ in range(110)] + [prose(rng, 50, 6) for _ in range(15)]
    texts += [None, "", " \n", "one two", "ONE  two", "É one", "é one", "a b c d", "a b c d a b c d"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs_of(spark, texts), size, percent).collect()}
    assert got == groups_by_hand(list(enumerate(texts)), size, percent)


def test_a_chain_of_copies_is_one_group_and_one_stays(spark):
    rng = random.Random(1)
    texts = [prose(rng, 150, 400)]
    for _ in range(12):
        texts.append(edited(rng, texts[-1], 3))
    frame = docs_of(spark, texts)
    want = groups_by_hand(list(enumerate(texts)), 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(frame, 5, 80).collect()} == {i: c for i, (_, c) in want.items()}
    assert {r["doc_id"] for r in jaccard.one_of_each(frame, 5, 80).collect()} == {c for _, c in want.values()}


def test_group_edges(spark):
    frame = docs_of(spark, ["a b c d e", "a b c d e", "a b c d e", "q r s t", "q r s t"], [4, 4, None, 9, 8]).withColumn("n", F.lit("x")).withColumn("doc", F.lit("y"))
    got = sorted((tuple(r) for r in jaccard.groups(frame, 4, 85).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (9, 1, 8), (8, 1, 8)], key=str)
    assert jaccard.groups(frame.limit(0)).count() == 0
    assert {r["doc_id"] for r in jaccard.one_of_each(frame).collect()} == {4, 8, None}


# --- decontamination ----------------------------------------------------------------------------

ITEM = "John Smith bought 12 apples and 7 kg of rice from the market for Anna on monday morning while 12 more came."


def leak_ids(spark, texts, items=((9, ITEM), (10, "short one here"), (11, None))):
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs_of(spark, texts), spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_reparameterised_questions_are_found_and_inconsistent_ones_not(spark):
    other = ITEM.replace("John Smith", "Peter van Jones").replace("Peter van", "Peter").replace("12", "30").replace("Anna", "Maria").replace("7 kg", "9 lb")
    texts = ["so. " + ITEM, "well. " + other, "well. " + other.replace("30 more", "31 more"), "well " + ITEM.lower().replace("rice", "wheat flour"), None, "", "and a SHORT one, here", "word " * 3000 + ITEM]
    assert leak_ids(spark, texts) == {(0, 9), (1, 9), (6, 10), (7, 9)}


def test_new_values_may_coincide_but_not_split(spark):
    item = "A farmer sells 5 apples and 7 pears at the market and then gives 5 more away for nothing."
    texts = ["so. " + item.replace("5", "4").replace("7", "4"), "so. " + item.replace("7", "5"), "so. " + item.replace("5 apples", "4 apples").replace("5 more", "6 more")]
    assert leak_ids(spark, texts, [(9, item)]) == {(0, 9), (1, 9)}


def test_leaks_equal_plain_containment_on_prose(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.choice([5, 20, 40]), 300)) for k in range(12)]
    texts = [prose(rng, 60, 300) + (" " + items[k % 12][1] + " " if k % 3 == 0 else " ") + prose(rng, 10, 300) for k in range(60)]
    # numbers within words make every word a placeholder, so letters only
    spell = str.maketrans("0123456789", "abcdefghij")
    items, texts = [(k, t.translate(spell)) for k, t in items], [t.translate(spell) for t in texts]
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if f" {x} " in t}
    assert leak_ids(spark, texts, items) == want


def test_items_of_few_literal_words_are_found_as_they_stand(spark):
    items = [(1, "Who is Barack Obama?"), (2, "What is 7 times 8?"), (3, "The Old Man And The Sea"), (4, "1 2 3 5 8 13 21 34 55 89")]
    texts = [f"well. {items[0][1]} So.", f"well. {items[1][1]} So.", f"well {items[2][1]} Again.", f"so {items[3][1]} on", "Who is John Obama? What is 7 times 9?", "1 2 3 4 5 6 7 8 9 10 11 12"]
    assert leak_ids(spark, texts, items) == {(0, 1), (1, 2), (2, 3), (3, 4)}


def test_leaks_equal_plain_containment_on_numbered_words(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([5, 20, 40]), 300)) for k in range(12)]
    texts = [prose(rng, 60, 300) + (" " + items[k % 12][1] + " " if k % 3 == 0 else " ") + prose(rng, 10, 300) for k in range(60)]
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if f" {x} " in t}
    assert leak_ids(spark, texts, items) == want


def test_clean_keeps_rows_and_columns(spark):
    frame = docs_of(spark, [ITEM, "fine", None], [1, 2, None]).withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    out = leaks.clean(frame, items)
    assert out.columns == frame.columns and {r["doc_id"] for r in out.collect()} == {2, None}
    assert leaks.clean(frame, items.limit(0)).count() == 3 and leaks.clean(frame.limit(0), items).count() == 0


# --- Hamming search -----------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    code = {k: rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for k in range(900)}
    code |= {k: base[0] for k in range(900, 1000)}  # a third of a code's rows alike
    signed = {k: c - 2**64 if c >= 2**63 else c for k, c in code.items()}
    frame = spark.createDataFrame(list(signed.items()), "id long, code long")
    got = {}
    for r in hamming.nearest(frame, frame.filter("id % 50 = 0"), k=7, block=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    want = {q: [(n + 1, d, i) for n, (d, i) in enumerate(sorted(((code[q] ^ code[i]).bit_count(), i) for i in code if i != q)[:7])] for q in code if q % 50 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_codes_skip_what_is_no_vector(spark):
    rows = [(1, [1.0] * 63 + [-1.0]), (2, None), (3, [1.0]), (None, [1.0] * 64), (4, [float("nan")] * 64), (4, [float("nan")] * 64)]
    found = hamming.codes(spark.createDataFrame(rows, "id long, vector array<float>"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2**63 - 1), (4, 0), (4, 0)]
    near = hamming.nearest(found, found, k=3)
    assert sorted(tuple(r) for r in near.collect()) == [(1, 4, 63, 1), (4, 1, 63, 1)]
    assert hamming.nearest(found.limit(0), found, 3).count() == 0


# --- licences -----------------------------------------------------------------------------------


def test_licences_wrapped_at_any_width(spark):
    import textwrap

    heads = ["Copyright (c) 2020 Somebody", "Copyright 2019-2021 The Authors. All rights reserved.", "© me", "Copyright by Some Body", "# Copyright: (C) 1999 X"]
    texts, want = [], []
    for name, body in {i: t for i, t in licenses.KNOWN if len(t) > 400}.items():
        for width in range(40, 121):
            lines = [x for part in body.split("\n") for x in textwrap.wrap(part, width)]
            texts.append("\n".join([heads[width % len(heads)], "", *lines]))
            want.append(name)
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs_of(spark, texts), licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_license_scan_of_odd_rows(spark):
    texts = ["Released under the MIT License.", "Released under the MIT License.", None, "x " * 200_000 + "\nLICENCED under the MIT licence!", "the mit\nSub-License x"]
    docs = docs_of(spark, texts, [1, 1, None, 4, 5]).withColumns({"digest": F.lit("clash"), "license_id": F.lit("clash"), "line": F.lit("clash")})
    got = sorted(((r["doc_id"], r["license_id"], r["notices"]) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()), key=repr)
    assert got == sorted([(1, "MIT", "MIT"), (1, "MIT", "MIT"), (None, None, None), (4, None, "MIT"), (5, None, None)], key=repr)


def test_licences_by_canonical_digest(spark):
    mit = licenses.KNOWN[0][1]
    texts = [
        "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " , "), mit.replace("sublicense", "sub-license"), mit + " more", "hello\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0.",
        None, "", "© me", "All rights reserved.",
    ]
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["digest"] is None) for r in licenses.scan(docs_of(spark, texts), licenses.known_licenses(spark)).collect()}
    assert got == {
        0: ("MIT", None, False), 1: ("MIT", None, False), 2: (None, None, False), 3: (None, "CC-BY-NC-4.0,MIT", False),
        4: (None, None, True), 5: (None, None, True), 6: (None, None, True), 7: (None, None, True),
    }
    assert licenses.scan(docs_of(spark, texts).limit(0), licenses.known_licenses(spark)).count() == 0
