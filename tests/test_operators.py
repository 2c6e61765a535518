"""Planted truth, refusals and brute-force checks for single operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelight import fixed
from tidelight.functions import geo, maths, times
from tidelight.operators import detections as de
from tidelight.operators import estimators as es
from tidelight.operators import events as ev
from tidelight.operators import gating as ga
from tidelight.operators import greedy as gr
from tidelight.operators import intervals as iv
from tidelight.operators import raster as ra
from tidelight.operators import reports, spectra as sp
from tidelight.operators.guards import DataError, column_difference, require_matched
from tidelight.operators.scoring import halo_tiles, score_overlapping, score_tiles

BAND = {"small_craft": fixed.BANDS["small_craft"][:2]}


def surface(spark, loud, value=70, frames=1200, hot=(400, 600)):
    """A quiet surface of level 20 with ``loud`` bins raised during the hot frames."""
    lv = F.when(F.col("id").between(hot[0], hot[1] - 1), F.array(*[F.lit(value if b in loud else 20) for b in range(512)])).otherwise(
        F.array_repeat(F.lit(20), 512))
    return spark.range(frames).select(F.lit("w").alias("win"), F.col("id").alias("frame"), (F.col("id") * 0.25).alias("t"), lv.alias("levels"))


def events_of(frames, **kw):
    lv = sp.band_levels(frames, BAND, ["win", "frame", "t"])
    return ev.find_events(lv, ["win"], ["frame"], "t", **kw).collect()


# ---- bands and events ------------------------------------------------------------------------

def test_planted_event_is_recovered(spark):
    e = events_of(surface(spark, range(4, 41)))
    assert len(e) == 1 and e[0].peak_excess == 50 and e[0].duration_s == 50 and e[0].t_start == 100.0 and e[0].t_peak == 100.0


def test_out_of_band_and_single_bin_stay_silent(spark):
    assert events_of(surface(spark, range(80, 121))) == []
    assert events_of(surface(spark, [20], 120)) == []


def test_shuffle_destroys_the_event(spark):
    f = surface(spark, range(4, 41))
    lv = sp.band_levels(f, BAND, ["win", "frame", "t"]).select("win", "frame", "t", "level")
    sh = ev.shuffled(lv, ["win"], ["frame"], "frame", seed=1)
    assert ev.find_events(sh, ["win"], ["frame"], "t").count() == 0


def test_band_bins_and_refusals():
    got = {n: sp.band_bins(b[0], b[1]) for n, b in fixed.BANDS.items()}
    assert got == {"small_craft": (4, 40), "ship_proxy": (1, 4), "rain": (52, 100), "control": (205, 408)}
    assert sp.band_bins(1_000, 4_000, half_open=True) == (4, 15)
    for bad in ((100, 1_000), (1_000, 500), (1_000, 110_000)):
        with pytest.raises(DataError):
            sp.check_band(*bad)
    with pytest.raises(DataError):
        sp.check_calibrated(1_000, 60_000)
    with pytest.raises(DataError, match="Nyquist"):
        sp.band_bins(1_000, 129_000)
    with pytest.raises(DataError, match="no bins"):
        sp.band_bins(300, 310, slack_hz=0)
    assert sp.common_support(250, 60_000, 10, 16_000, 32_000, 1_000) == (250, 16_000)
    with pytest.raises(DataError, match="narrower"):
        sp.common_support(250, 60_000, 10, 300, 32_000, 1_000)
    assert ev.min_frames() == 80 and ev.odd_frames(45.0) == 181


def test_baseline_rules(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, level double")
    for p in (0.0, 1.0):
        with pytest.raises(DataError):
            sp.baselines(df, ["k"], p=p)
    amb = spark.createDataFrame([("a", b, None if b == 6 else 1.0) for b in range(20)], "k string, bin int, ambient double")
    with pytest.raises(Exception, match="NULL ambient"):
        sp.band_baseline(amb, ["k"], {"x": (1_000.0, 2_000.0)}, 20).collect()
    w = spark.createDataFrame([(2020,), (2021,)], "season int")
    with pytest.raises(DataError, match="2021"):
        sp.require_seasons(w, w.where("season = 2020"), "season")


def test_histogram_overflow_and_total(spark):
    rng = np.random.default_rng(11)
    g = rng.integers(-3, 200, (300, 64))
    df = spark.createDataFrame(pd.DataFrame({"y": 1, "levels": list(g.tolist())}))
    h = sp.histogram(df, ["y"])
    assert h.agg(F.sum("n")).first()[0] == g.size and h.agg(F.sum("n_over")).first()[0] == int((g >= 160).sum())
    p = {r.bin: r for r in sp.histogram_percentiles(h, ["y"], [0.05, 0.5, 0.95]).collect()}
    for b in range(64):
        col = np.clip(g[:, b], 0, 159)
        for q in (5, 50, 95):
            assert p[b][f"p{q}"] == np.percentile(col, q, method="inverted_cdf")


def test_hump_without_power_is_an_error(spark):
    flat = surface(spark, [], frames=3, hot=(0, 0))
    with pytest.raises(Exception, match="no power"):
        sp.hump_centroid(flat, ["win"]).collect()


def test_tone_check_lists_every_miss(spark):
    f = surface(spark, [20], 120)
    claim = lambda b, fr, lv: spark.createDataFrame([("w", b, fr, lv)], "win string, claimed_bin int, claimed_frame int, claimed_level int")
    ok = sp.tone_check(f, ["win"], "frame", claim(20, 400, 120), 0, 0, 0).first()
    assert ok.misses == "" and (ok.bin, ok.frame, ok.level) == (20, 400, 120)
    assert sp.tone_check(f, ["win"], "frame", claim(30, 10, 90), 1, 1, 3).first().misses == "frequency,time,level"


# ---- intervals and calendar --------------------------------------------------------------------

def ts(text):
    return F.to_timestamp(F.lit(text))


def test_straddling_file_counts_only_inside(spark):
    w = spark.range(1).select(F.lit(1).alias("id"), ts("2020-07-01 18:00:00").alias("w_start"), ts("2020-07-01 18:30:00").alias("w_end"))
    f = spark.range(1).select(ts("2020-07-01 17:58:00").alias("start_utc"), ts("2020-07-01 18:03:00").alias("end_utc"))
    r = iv.covered_seconds(w, f.unionByName(f), ["id"]).first()
    assert r.covered_s == 180.0 and r.coverage == "partial"


def test_touching_is_not_overlap(spark):
    bins = spark.range(4).select(F.timestamp_seconds(F.col("id") * 300).alias("start_utc"), F.timestamp_seconds((F.col("id") + 1) * 300).alias("end_utc"))
    item = spark.range(1).select(F.timestamp_seconds(F.lit(300)).alias("start_utc"), F.timestamp_seconds(F.lit(600)).alias("end_utc"))
    got = [r.available for r in iv.available_bins(bins, item).orderBy("start_utc").collect()]
    assert got == [False, True, False, False]


def test_season_grid_has_all_bins(spark):
    span = spark.range(1).select(ts("2021-04-30 23:58:00").alias("start_utc"), ts("2021-10-01 00:01:00").alias("end_utc"))
    b = times.season_bins(span)
    r = b.agg(F.count("*").alias("n"), F.min("start_utc").cast("string").alias("a"), F.max("end_utc").cast("string").alias("z")).first()
    assert (r.n, r.a, r.z) == (153 * 288, "2021-05-01 00:00:00", "2021-10-01 00:00:00")


def test_local_time_that_does_not_exist_or_repeats_is_refused(spark):
    d = lambda x: spark.range(1).select(times.local_window(F.to_date(F.lit(x)), "02:15:00", "03:30:00", "America/Vancouver").alias("w"))
    assert str(d("2024-07-01").first().w.start_utc) == "2024-07-01 09:15:00"
    with pytest.raises(Exception, match="no single instant"):
        d("2024-03-10").collect()
    twice = spark.range(1).select(times.local_window(F.to_date(F.lit("2024-11-03")), "01:15:00", "03:30:00", "America/Vancouver").alias("w"))
    with pytest.raises(Exception, match="no single instant"):
        twice.collect()
    w = spark.range(1).select(times.local_window(F.to_date(F.lit("2024-12-01"))).alias("w")).first().w
    assert w.start_utc.hour == 17 and w.end_utc.hour == 19


def test_hour_without_bins_is_null(spark):
    b = spark.range(2).select(F.timestamp_seconds(F.col("id") * 300).alias("start_utc"), F.lit(True).alias("available"))
    got = iv.mean_by_hour(b, F.col("available")).collect()
    assert len(got) == 24 and sum(r.availability is not None for r in got) == 1


# ---- greedy choices ------------------------------------------------------------------------------

def _mis(edges, nodes):
    order = sorted(nodes)
    kept = []
    for n in order:
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    return set(nodes) - set(kept)


@pytest.mark.parametrize("small", [10_000, 0])
def test_greedy_drop_matches_a_sequential_pass(spark, small):
    rnd = random.Random(4)
    want, rows = set(), []
    for k in ("a", "b"):
        e = {(i, j) for i in range(40) for j in range(i + 1, 40) if rnd.random() < 0.08}
        want |= {(k, x) for x in _mis(e, range(40))}
        rows += [(k, i, j) for i, j in e]
    got = gr.dropped_by_rivals(spark.createDataFrame(rows, "k string, winner long, loser long"), ["k"], small)
    assert set(map(tuple, got.collect())) == want


@pytest.mark.parametrize("small", [10_000, 0])
@pytest.mark.parametrize("mode", ["distance", "turn"])
def test_matching_matches_a_sequential_pass(spark, small, mode):
    rnd = random.Random(8)
    rows = [(k, i, j, float(rnd.randrange(6))) for k in ("x", "y") for i in range(15) for j in range(15) if rnd.random() < 0.3]
    want = set()
    for k in ("x", "y"):
        mine, ua, ub = [r for r in rows if r[0] == k], set(), set()
        order = sorted(mine, key=lambda r: (r[3], r[1], r[2])) if mode == "distance" else sorted(mine, key=lambda r: (r[1], r[3], r[2]))
        for _, a, b, _d in order:
            if a not in ua and b not in ub:
                ua.add(a)
                ub.add(b)
                want.add((k, a, b))
    df = spark.createDataFrame(rows, "k string, a long, b long, d double")
    ranks = ([F.col("d"), F.col("a"), F.col("b")],) * 2 if mode == "distance" else ([F.col("d"), F.col("b")], [F.col("a")])
    got = gr.match_one_to_one(df, ["k"], *ranks, small=small)
    assert set(map(tuple, got.select("k", "a", "b").collect())) == want


@pytest.mark.parametrize("small", [10_000, 0])
def test_copies_are_matched_without_pairing_them(spark, small):
    rnd = random.Random(13)
    side = lambda n, off: [("s", off + i, float(rnd.randrange(4) * 3), float(rnd.randrange(3) * 4)) for i in range(n)]
    a, b = side(40, 0), side(30, 100)
    first_a, first_b = ({(r[2], r[3]): min(q[1] for q in rows if q[2:] == r[2:]) for r in rows} for rows in (a, b))
    order = sorted((math.hypot(x[2] - y[2], x[3] - y[3]), first_a[x[2:]], first_b[y[2:]], x[1], y[1]) for x in a for y in b)
    want, ua, ub = set(), set(), set()
    for d, _, _, i, j in order:
        if d <= 3.5 and i not in ua and j not in ub:
            ua.add(i)
            ub.add(j)
            want.add((i, j))
    da = spark.createDataFrame(a, "k string, a long, ax double, ay double")
    db = spark.createDataFrame(b, "k string, b long, bx double, by double")
    got = de.match_by_distance(da, db, ["k"], 3.5, small=small)
    assert {(r.a, r.b) for r in got.collect()} == want


@pytest.mark.parametrize("reach", [256, 4, 1])
def test_spacing_prefers_the_higher_then_the_later(spark, reach):
    rnd = random.Random(21)
    x = [(k, m, float(rnd.randrange(5))) for k in ("u", "v") for m in sorted(rnd.sample(range(200), 60))]
    want = []
    for r in sorted(x, key=lambda r: (-r[2], -r[1])):
        if all(q[0] != r[0] or abs(q[1] - r[1]) >= 7 for q in want):
            want.append(r)
    many = ev.apart(spark.createDataFrame(x, "k string, mid long, height double"), ["k"], "mid", 7, [-F.col("height"), -F.col("mid")], reach)
    assert sorted(map(tuple, many.collect())) == sorted(want)
    p = spark.createDataFrame([("a", 0, 5.0), ("a", 5, 5.0), ("a", 9, 7.0), ("a", 20, 1.0)], "k string, mid long, height double")
    got = ev.apart(p, ["k"], "mid", 6, [-F.col("height"), -F.col("mid")], reach)
    assert sorted(r.mid for r in got.collect()) == [0, 9, 20]


def test_suppression_with_copies_matches_a_sequential_pass(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        x, y = rnd.randrange(12) * 5.0, rnd.randrange(6) * 5.0
        w = 0.0 if i % 15 == 0 else 12.0
        rows.append(("s", i, rnd.randrange(5) / 4, x, y, x + w, y + w))
    rows += [("s", 100 + i, 0.75, *rows[1][3:]) for i in range(20)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], -r[1])):
        def iou(q, r=r):
            inter = max(min(q[5], r[5]) - max(q[3], r[3]), 0) * max(min(q[6], r[6]) - max(q[4], r[4]), 0)
            area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
            return inter / (area(q) + area(r) - inter + 1e-9)
        if all(iou(q) < 0.5 for q in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "scene_id string, box long, score double, x1 double, y1 double, x2 double, y2 double")
    for limits in ({}, {"most": 6}, {"most": 2}):
        got = de.suppress_overlaps(df, ["scene_id"], cell=7.0, **limits)
        assert sorted(r.box for r in got.collect()) == sorted(r[1] for r in kept)


def test_a_pile_of_boxes_is_not_paired(spark):
    """10^5 boxes in one cell: all pairs would be 5 * 10^9."""
    n = 100_000
    i = F.col("id")
    at = lambda k, size: ((i * k) % 10_007) / 10_007 * size
    d = spark.range(n).select(F.lit("s").alias("scene_id"), i.alias("box"), ((i * 7919) % 100_003).cast("double").alias("score"), at(31, 10).alias("x1"), at(57, 10).alias("y1"), (at(91, 10) + 10).alias("w"), (at(13, 10) + 10).alias("h"))
    d = d.select("scene_id", "box", "score", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    got = sorted(r.box for r in de.suppress_overlaps(d, ["scene_id"]).collect())
    rows = np.array([tuple(r) for r in d.orderBy(F.desc("score"), F.desc("box")).select("box", "x1", "y1", "x2", "y2").collect()])
    box, left, kept = rows[:, 1:], np.ones(n, bool), []
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    while left.any():
        k = int(np.argmax(left))
        kept.append(int(rows[k, 0]))
        inter = np.clip(np.minimum(box[:, 2:], box[k, 2:]) - np.maximum(box[:, :2], box[k, :2]), 0, None).prod(axis=1)
        left &= inter / (area + area[k] - inter + 1e-9) < fixed.NMS_IOU
        left[k] = False
    assert got == sorted(kept)


def test_pairs_are_matched_for_all_settings_at_once(spark):
    from tidelight.operators.sweeps import matched_bits

    rnd = random.Random(5)
    settings = 70  # more than one word of bits
    names = ["_m0", "_m1"]
    rows, mask = [], {}
    for a in range(12):
        for b in range(12):
            if rnd.random() < 0.4:
                mask[a, b] = [rnd.random() < 0.6 for _ in range(settings)]
                words = [sum(1 << k for k, x in enumerate(mask[a, b][i * 63 : (i + 1) * 63]) if x) for i in range(2)]
                rows.append(("s", a, b, float(rnd.randrange(6)), *words))
    df = spark.createDataFrame(rows, "k string, a long, b long, d double, _m0 long, _m1 long")
    got = {(r.a, r.b): [bool(r[names[k // 63]] >> (k % 63) & 1) for k in range(settings)] for r in matched_bits(df, ["k"], names).groupBy("a", "b").agg(*[F.bit_or(n).alias(n) for n in names]).collect()}
    for k in range(settings):
        used_a, used_b, want = set(), set(), set()
        for d, a, b in sorted((r[3], r[1], r[2]) for r in rows if mask[r[1], r[2]][k]):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want.add((a, b))
        assert {p for p, bits in got.items() if bits[k]} == want


def test_settings_share_their_conditions(spark):
    """Sixteen settings of few rules take one evaluation a rule and value, and give the bits of every setting taken alone; NULL evidence passes none."""
    from tidelight.operators import sweeps

    grid = de.parameter_grid(conf=(0.2, 0.8), mask=("none", "water"), min_len=(0, 20), max_aspect=(2, 4))
    rng = random.Random(8)
    some = lambda v: None if rng.random() < 0.1 else v
    rows = [(i, some(rng.random()), rng.random() < 0.9, some(rng.random() < 0.5), some(rng.uniform(0, 40)), rng.uniform(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, score double, in_valid boolean, in_water boolean, length_m double, aspect_ratio double")
    settings = [{k: v for k, v in c.items() if k != "config"} for c in grid]
    words = sweeps._words([de.conditions(df.columns, **s) for s in settings])
    assert len(settings) == 16 and len(words) == 1 and str(words[0]).count("CASE WHEN") == 8
    plain = [F.coalesce(de.passes(df.columns, **s), F.lit(False)).alias(f"p{k}") for k, s in enumerate(settings)]
    for r in df.select(words[0].alias("w"), *plain).collect():
        assert r.w == sum(1 << k for k in range(16) if r[f"p{k}"])


def test_pairs_of_two_assets_across_cells(spark):
    """Pairs at exactly the tolerance, over cell borders and below zero, are counted as a plain pass over all pairs does."""
    from tidelight.operators.sweeps import sweep_assets

    rng = random.Random(9)
    rows = [("s", side, i, rng.randrange(-60, 60) / 2, rng.randrange(-60, 60) / 2, 48.0, -125.0, 2000) for side in "AB" for i in range(60)]
    rows += [("t", "A", 0, 20.0, 0.0, 48.0, -125.0, 2000), ("t", "B", 0, 15.0, 0.0, 48.0, -125.0, 2000), ("t", "A", 1, -20.0, 0.0, 48.0, -125.0, 2000), ("t", "B", 1, -20.0, 5.0, 48.0, -125.0, 2000)]
    df = spark.createDataFrame(rows, "scene string, side string, id int, x double, y double, lat double, lon double, year int")
    got = {r.scene: r.pred for r in sweep_assets(df, "scene", [{"config": 0}], lambda c, s: F.lit(True), 5.0).where("asset = 'both'").collect()}
    a, b = ([r for r in rows if r[:2] == ("s", side)] for side in "AB")
    seen, n = set(), 0
    for d, i, j in sorted((math.hypot(p[3] - q[3], p[4] - q[4]), p[2], q[2]) for p in a for q in b):
        if d <= 5.0 and not {("a", i), ("b", j)} & seen:
            seen |= {("a", i), ("b", j)}
            n += 1
    assert got == {"s": n, "t": 2} and n > 20


def test_persistence_is_counted_per_setting(spark):
    from tidelight.operators.sweeps import sweep_assets

    rnd = random.Random(2)
    rows = [(f"s{i % 7}", "AB"[i % 2], i, float(rnd.randrange(40)), float(rnd.randrange(40)), 48.0 + rnd.randrange(4) * 0.01, -125.0, 2015 + rnd.randrange(6), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "scene string, side string, id long, x double, y double, lat double, lon double, year int, score double")
    grid = [{"config": 10 + k, "a": a, "b": b} for k, (a, b) in enumerate(((0.1, 0.2), (0.5, 0.5), (0.9, 0.1)))]
    got = {(r.config, r.persist, r.asset, r.scene): r.pred for r in sweep_assets(df, "scene", grid, lambda c, s: F.col("score") >= c["a" if s == "A" else "b"], 5.0, (0, 2, 5)).collect()}
    for c in grid:
        for least in (0, 2, 5):
            kept = [r for r in rows if r[8] >= (c["a"] if r[1] == "A" else c["b"])]
            years = {}
            for r in kept:
                years.setdefault((r[1], r[5]), set()).add(r[7])
            kept = [r for r in kept if not least or len(years[r[1], r[5]]) < least]
            for scene in {r[0] for r in rows}:
                a, b = ([r for r in kept if r[0] == scene and r[1] == s] for s in "AB")
                pairs, ua, ub = 0, set(), set()
                for d, i, j in sorted((math.hypot(p[3] - q[3], p[4] - q[4]), p[2], q[2]) for p in a for q in b):
                    if d <= 5.0 and i not in ua and j not in ub:
                        ua.add(i)
                        ub.add(j)
                        pairs += 1
                want = {"A": len(a), "B": len(b), "both": pairs, "any": len(a) + len(b) - pairs}
                assert {x: got[c["config"], least, x, scene] for x in want} == want


# ---- rasters -------------------------------------------------------------------------------------

def _pixels(spark, grid, valid=None):
    rows = [("s", r, c, int(v), True if valid is None else bool(valid[r, c]), True) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "scene_id string, row int, col int, nir int, valid boolean, clear boolean")


def _flood(mask):
    lab, n = -np.ones(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if lab[r, c] < 0:
            todo = [(r, c)]
            lab[r, c] = n
            while todo:
                y, x = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        q = (y + dy, x + dx)
                        if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and lab[q] < 0:
                            lab[q] = n
                            todo.append(q)
            n += 1
    return lab, n


@pytest.mark.parametrize("band_rows", [128, 3])
@pytest.mark.parametrize("density", [0.3, 0.6])
def test_components_match_flood_fill(spark, band_rows, density):
    mask = np.random.default_rng(6).random((20, 24)) < density
    px = _pixels(spark, mask)
    lab = ra.label_runs(ra.runs_of(px, F.col("nir") == 1), band_rows)
    got = {}
    for r in lab.collect():
        for c in range(r.c0, r.c1 + 1):
            got[r.row, c] = (r.label.row, r.label.c0)
    want, n = _flood(mask)
    pairs = {(got[rc], want[rc]) for rc in got}
    assert len(got) == mask.sum() and len(pairs) == n == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_water_mask_and_report(spark):
    g = np.zeros((20, 30), int)
    g[0:4] = 100  # a land strip
    g[12, 15] = 100  # a small bright object
    px = _pixels(spark, g).withColumn("clear", ~((F.col("row") == 19) & (F.col("col") < 5)))
    land, report = ra.land_runs(px, 50, 3.0, min_area_m2=500)
    assert tuple(report.first())[1:] == (1, 1)
    masked = ra.water_mask(px, land, 9.0, 3.0)
    got = {(r.row, r.col) for r in masked.where("water").collect()}
    want = {(r, c) for r in range(20) for c in range(30) if r >= 7 and not (r == 19 and c < 5)}
    assert got == want  # the strip and three more rows are gone, the boat stays
    rep = ra.mask_report(masked, land).first()
    assert (rep.valid_px, rep.water_px, rep.land_px, rep.buffered_px, rep.cloud_px) == (600, len(want), 120, 90, 5)
    with pytest.raises(Exception, match="clear mask"):
        ra.water_mask(px.withColumn("clear", F.lit(None).cast("boolean")), land, 9.0, 3.0).collect()


def test_disk_is_the_elliptic_kernel():
    assert ra.disk_half_widths(1) == [(-1, 0), (0, 1), (1, 0)]
    assert ra.disk_half_widths(3) == [(-3, 0), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 0)]


def test_blobs_find_planted_boats(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(8, 13, (60, 60))
    g[20, 10:14] = 90
    for i in range(5):
        g[40 + i, 40 + i] = 80
    g[5, 5] = 70
    px = _pixels(spark, g).withColumn("water", F.lit(True))
    th = ra.robust_threshold(px, "nir", 8.0)
    b = {(r.label_row, r.label_col): r for r in de.blob_reasons(ra.blobs(px, "nir", th, 3.0)).collect()}
    assert set(b) == {(20, 10), (40, 40), (5, 5)}
    line, diag, dot = b[20, 10], b[40, 40], b[5, 5]
    assert (line.length_m, line.width_m, line.n_px, line.nir_peak) == (12.0, 3.0, 4, 90.0) and line.reject_reason == "kept"
    assert diag.length_m == pytest.approx(3 * (4 * math.sqrt(2) + 1)) and diag.width_m == pytest.approx(3.0) and diag.reject_reason == "too_elongated"
    assert dot.reject_reason == "too_few_px" and line.fill == pytest.approx(1.0)


def test_rectangle_is_the_smallest_over_angles(spark):
    rng = np.random.default_rng(7)
    sets = [rng.integers(0, 12, (rng.integers(3, 15), 2)) for _ in range(30)] + [np.array([[k, 2 * k] for k in range(5)]), np.array([[4, 4], [4, 4]])]
    frame = spark.createDataFrame([(i, [(int(x), int(y)) for x, y in pts]) for i, pts in enumerate(sets)], "i int, p array<struct<x:int,y:int>>")
    got = {r.i: r.s for r in frame.select("i", ra.smallest_rectangle(F.col("p")).alias("s")).collect()}
    for i, pts in enumerate(sets):
        turned = [(np.ptp(pts @ [math.cos(a), math.sin(a)]), np.ptp(pts @ [-math.sin(a), math.cos(a)])) for a in np.linspace(0, math.pi / 2, 3_000)]
        assert got[i].long_px * got[i].short_px <= min(a * b for a, b in turned) + 1e-9
        assert got[i].long_px <= math.hypot(*np.ptp(pts, axis=0)) + 1e-9
    assert got[30].long_px == pytest.approx(math.hypot(4, 8)) and got[30].short_px == pytest.approx(0) and (got[31].long_px, got[31].short_px) == (0, 0)


def test_flat_water_is_refused(spark):
    px = _pixels(spark, np.full((3, 3), 5))
    with pytest.raises(Exception, match="no spread"):
        ra.robust_threshold(px, "nir").collect()
    g = np.full((10, 10), 5)
    g[0, 0] = 9  # MAD is 0, the deviation is not
    r = ra.robust_threshold(_pixels(spark, g), "nir").first()
    assert r.mad == 0 and r.sigma == pytest.approx(np.std(g))


def test_support_never_drops_boxes(spark):
    px = _pixels(spark, np.arange(100).reshape(10, 10))
    b = spark.createDataFrame([("s", 1, 2.2, 3.0, 4.0, 5.5), ("s", 2, 50.0, 50.0, 60.0, 60.0), ("s", 3, -5.0, -5.0, 0.5, 0.5)], "scene_id string, box int, x1 double, y1 double, x2 double, y2 double")
    th = ra.robust_threshold(px, "nir", 0.2)
    got = {r.box: r for r in ra.box_support(b, px, th).collect()}
    assert set(got) == {1, 2, 3} and got[2].nir_peak is None and got[2].nir_support == "none" and got[2].possible_false_positive == 1
    assert got[1].nir_peak == 64 and got[1].n_px == 12 and got[3].nir_peak == 11


# ---- detections, scenes, geometry ----------------------------------------------------------------

def test_size_edges_and_bad_lengths(spark):
    v = spark.createDataFrame([(x,) for x in (0.0, 11.99, 12.0, 23.99, 24.0, 40.0)], "x double")
    assert [r[0] for r in v.select(maths.size_class(F.col("x"))).collect()] == ["0-12m"] * 2 + ["12-24m"] * 2 + [">24m"] * 2
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(bad,)], "x double").select(maths.size_class(F.col("x"))).collect()


def test_dominance(spark):
    d = lambda *r: spark.createDataFrame([(x,) for x in r], "r double").agg(de.dominance(F.col("r"))).first()[0]
    assert d(1.0, 4.0) == pytest.approx(1 / (1 + 4**-1.5))
    assert spark.createDataFrame([], "r double").agg(de.dominance(F.col("r"))).first()[0] is None
    with pytest.raises(Exception, match="positive"):
        d(0.0, 1.0)


def test_scene_classes(spark):
    s = spark.createDataFrame([("e",), ("one",), ("two",)], "scene_id string")
    d = spark.createDataFrame([("one", 1, 2.0, 1), ("two", 1, 2.0, 0), ("two", 2, 2.2, 1)], "scene_id string, id int, range_km double, wake_flag int")
    got = {r.scene_id: r for r in de.classify_scenes(s, d).collect()}
    assert [got[k]["class"] for k in ("e", "one", "two")] == ["EMPTY", "SINGLE-DOMINANT", "CROWDED"]
    assert got["e"].dominance is None and got["e"].n_detections == 0 and got["two"].wake_flag_dominant == 0


def test_geodesic_reference_line(spark):
    # The classic Flinders Peak to Buninyong line, recomputed on WGS84 to the metre.
    df = spark.createDataFrame([(144.42486789, -37.95103342, 143.92649553, -37.65282114), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    r = [x.g for x in df.select(geo.geodesic("a", "b", "c", "d").alias("g")).collect()]
    assert r[0].m == pytest.approx(54_972.27, abs=0.05) and r[0].azimuth_deg == pytest.approx(306.86816, abs=1e-4)
    assert r[1].m == 0 and r[2].m == pytest.approx(111_319.4908, abs=1e-3) and r[2].azimuth_deg == pytest.approx(90)


def test_utm_known_points(spark):
    df = spark.createDataFrame([(500_000.0, 0.0, 10.0), (500_000.0, 5_400_000.0, 10.0)], "x double, y double, z double")
    r = [x.p for x in df.select(geo.utm_to_lonlat("x", "y", "z").alias("p")).collect()]
    assert (r[0].lon, r[0].lat) == (-123.0, 0.0)
    # Meridian distance on WGS84 / 0.9996, integrated numerically.
    a, f = fixed.WGS84
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(r[1].lat), 200_001)
    m = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    assert float(np.sum((m[1:] + m[:-1]) / 2 * np.diff(phi))) * 0.9996 == pytest.approx(5_400_000.0, abs=0.01)


def test_cells_round_halves_to_even(spark):
    d = fixed.PERSISTENCE_CELL_DEG
    df = spark.createDataFrame([(2.5 * d[0], 1.0), (3.5 * d[0], 1.0)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.grid_cell(F.col("lat"), F.col("lon"))[0]).collect()] == [2, 4]


def test_evidence_columns_must_exist(spark):
    b = spark.createDataFrame([(0.5,)], "score double")
    with pytest.raises(DataError, match="shore_m"):
        de.select_boxes(b, conf=0.1, shore_m=15.0)
    assert de.without_evidence(b.withColumn("nir_peak", F.lit(1))).columns == ["score"]
    assert column_difference(["a", "b"], ["b", "c"]) == (["c"], ["a"])


def test_grid_skips_empty_and_repeated_settings():
    g = de.parameter_grid(lambda c: c["lo"] >= c["hi"], lambda c: (c["lo"], c["hi"], c["mode"] if c["lo"] else ""), lo=(0, 5), hi=(5, 9), mode=("a", "b"))
    assert [(c["config"], c["lo"], c["hi"], c["mode"]) for c in g] == [(0, 0, 5, "a"), (2, 0, 9, "a"), (6, 5, 9, "a"), (7, 5, 9, "b")]


def test_coverage_of_an_area(spark):
    aoi = ((-125.0, 48.0), (-124.9, 48.0), (-124.9, 48.1), (-125.0, 48.1))
    ring = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    rows = [("all", ring(-125.1, 47.9, -124.8, 48.2)), ("half", ring(-125.1, 47.9, -124.95, 48.2)), ("none", ring(-120.0, 40.0, -119.0, 41.0)), ("same", ring(-125.0, 48.0, -124.9, 48.1))]
    got = {r.id: r for r in ga.aoi_coverage(spark.createDataFrame(rows, "id string, ring array<array<double>>"), aoi).collect()}
    assert got["all"].aoi_covered and got["all"].aoi_coverage == pytest.approx(1.0) and got["same"].aoi_covered
    assert got["half"].aoi_coverage == pytest.approx(0.5, abs=1e-4) and not got["half"].aoi_covered and got["none"].aoi_coverage == 0
    # Ellipsoidal area of the quadrangle, integrated.
    a, f = fixed.WGS84
    e2 = f * (2 - f)
    phi = np.radians(np.linspace(48.0, 48.1, 20_001))
    g = a * a * (1 - e2) * np.cos(phi) / (1 - e2 * np.sin(phi) ** 2) ** 2
    area = float(np.sum((g[1:] + g[:-1]) / 2 * np.diff(phi))) * math.radians(0.1)
    assert got["none"].aoi_missing_m2 == pytest.approx(area, rel=2e-4)  # chords instead of parallels


def test_coverage_is_computed_once_below_a_filter(spark):
    aoi = ((-125.0, 48.0), (-124.9, 48.0), (-124.9, 48.1), (-125.0, 48.1))
    x = F.lit(-125.1) + F.col("id") / 100
    at = lambda dx, y: F.array(x + dx, F.lit(y))
    rings = spark.range(40).select("id", F.array(at(0.0, 47.9), at(0.12, 47.9), at(0.12, 48.2), at(0.0, 48.2)).alias("ring"))
    every = ga.aoi_coverage(rings, aoi)
    kept = ga.contained(every, 60_000_000.0)
    assert {r.id for r in kept.collect()} == {r.id for r in every.collect() if r.aoi_covered or r.aoi_missing_m2 <= 60_000_000.0} != set()
    steps = [df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") for df in (every, kept)]
    assert steps[0] == steps[1] <= 2  # the clipping and the area of what is left


def test_shore_distance_beyond_the_pixels(spark):
    """Scene 1 has pixels in its first rows only, scene 2 lacks single pixels, scene 3 is all water."""
    rng = random.Random(5)
    land = {(1, r, c): rng.random() < 0.05 for r in range(6) for c in range(24)}
    land |= {(2, r, c): rng.random() < 0.05 for r in range(24) for c in range(24) if rng.random() < 0.5}
    land |= {(3, r, c): False for r in range(4) for c in range(24)}
    masked = spark.createDataFrame([(s, r, c, not dry) for (s, r, c), dry in land.items()], "scene_id int, row int, col int, water boolean")
    spots = {(s, i): (rng.randrange(24), rng.randrange(24)) for s in (1, 2, 3) for i in range(30)}
    boxes = spark.createDataFrame([(s, i, c - 1.0, r - 1.0, c + 1.0, r + 1.0) for (s, i), (r, c) in spots.items()], "scene_id int, box int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.scene_id, r.box): r.shore_m for r in ra.shore_distance(boxes, masked, 24, 24, 3.0).collect()}
    assert len(got) == 90
    for (s, i), (r, c) in spots.items():
        want = min((math.hypot(y - r, x - c) * 3.0 for (z, y, x), dry in land.items() if z == s and dry), default=None)
        assert got[s, i] == (want if want is None else pytest.approx(want)), (s, i)


def test_drops_must_exist(spark):
    s = spark.createDataFrame([(1,), (2,)], "id int")
    assert ga.drop_ids(s, s.where("id = 1")).collect()[0].id == 2
    with pytest.raises(DataError, match="3"):
        ga.drop_ids(s, spark.createDataFrame([(3,)], "id int"))
    with pytest.raises(DataError, match="right"):
        require_matched(s, spark.createDataFrame([(1,), (2,), (3,)], "id int"), ["id"])


def test_accounting_must_add_up(spark):
    r = spark.createDataFrame([(s,) for s in ("present", "present", "absent", "error", "empty", "unknown")], "status string")
    t = reports.check_accounting(reports.accounting(r))
    assert tuple(t.first()) == (3, 2, 1, 1, 1, 1)
    with pytest.raises(DataError, match="requested_differs"):
        reports.check_accounting(t.withColumn("requested", F.lit(9)))


def test_estimators_count_two_planted_passages(spark):
    x = np.arange(2400)
    level = 20 + 40 * np.exp(-(((x - 700) / 80.0) ** 2)) + 30 * np.exp(-(((x - 1700) / 80.0) ** 2))
    df = spark.createDataFrame(pd.DataFrame({"win": "w", "frame": x, "t": x * 0.25, "level": np.round(level)}))
    r = es.registry(["win"], ["frame"], "t")
    r["mine"] = es.user_estimator("mine", ["win"], lambda pdf: int((pdf["level"] > 55).any()))
    got = {m.method: m.n_est for m in es.run_all(df, r).collect()}
    assert got == {"raw_events": 2, "merged_10s": 2, "merged_120s": 2, "slope_zero_cross": 2, "peak_prominence": 2, "peak_prominence_strict": 2,
                   "elevated_periods": 2, "any_elevation": 1, "mine": 1}
    p = ev.passages(df, ["win"], ["frame"], "t").orderBy("mid").collect()
    assert [abs(r.mid - m) <= 1 for r, m in zip(p, (700, 1700))] == [True, True]
    assert ev.passages(df.where("frame < 181"), ["win"], ["frame"], "t").count() == 0


def test_constant_input_has_no_correlation(spark):
    c = spark.createDataFrame([("m", 1, 2, 3.0), ("m", 1, 3, 4.0)], "method string, n_est int, truth int, window_level double")
    s = es.score_estimators(c).first()
    assert s.r is None and s.partial_r is None and s.mae == 1.5


def test_tiles_without_valid_pixels_are_skipped(spark):
    px = spark.createDataFrame([("s", 0, 0, 0, 0, True), ("s", 0, 8, 0, 9, False)], "scene_id string, y0 long, x0 long, row int, col int, valid boolean")
    got = score_tiles(px, lambda p: [(0.0, 0.0, 1.0, 1.0, float(len(p)))]).collect()
    assert [tuple(r) for r in got] == [("s", 0.0, 0.0, 1.0, 1.0, 1.0)]


def test_a_box_on_a_seam_is_found_once(spark):
    bright = {(10, 19): 900, (10, 20): 900, (40, 5): 700}
    px = spark.createDataFrame([("s", r, c, bright.get((r, c), 1), True) for r in range(45) for c in range(37)], "scene_id string, row int, col int, nir int, valid boolean")
    scenes = spark.createDataFrame([("s", 45, 37)], "scene_id string, height int, width int")

    def model(p):
        hot = p[p["nir"] > 500]
        return [(float(c - p["x0"].iloc[0]) - 2, float(r - p["y0"].iloc[0]) - 2, float(c - p["x0"].iloc[0]) + 3, float(r - p["y0"].iloc[0]) + 3, float(v)) for r, c, v in hot[["row", "col", "nir"]].to_numpy()]

    tiles = halo_tiles(px, scenes, 20, 0.2)
    starts = {(r.y0, r.x0) for r in tiles.select("y0", "x0").distinct().collect()}
    assert starts == {(y, x) for y in (0, 16, 25) for x in (0, 16, 17)}
    assert {r["count"] for r in tiles.groupBy("y0", "x0").count().collect()} == {400}
    got = score_overlapping(px, scenes, model, 20, 0.2, iou=0.4)
    # the two neighbours overlap by 0.67, so one of them stays, once; the lone pixel too
    assert sorted((r.x1, r.y1, r.score) for r in got.collect()) == [(3.0, 38.0, 700.0), (18.0, 8.0, 900.0)]
    small = spark.createDataFrame([("t", r, c, 1, True) for r in range(3) for c in range(4)], "scene_id string, row int, col int, nir int, valid boolean")
    assert halo_tiles(small, spark.createDataFrame([("t", 3, 4)], "scene_id string, height int, width int"), 20, 0.2).select("y0", "x0").distinct().collect() == [(0, 0)]


def test_reflectance_coefficients_must_pair_up(spark):
    from tidelight.functions.text import band_coefficients

    one = lambda i: f"<ps:bandNumber>{i}</ps:bandNumber><ps:reflectanceCoefficient>{i}e-5</ps:reflectanceCoefficient>"
    good = "".join(one(i) for i in range(1, 5))
    df = spark.createDataFrame([(good,)], "x string")
    assert df.select(band_coefficients(F.col("x")).alias("m")).first().m == {1: 1e-5, 2: 2e-5, 3: 3e-5, 4: 4e-5}
    with pytest.raises(Exception, match="pair up"):
        spark.createDataFrame([(good + "<ps:bandNumber>5</ps:bandNumber>",)], "x string").select(band_coefficients(F.col("x"))).collect()


def test_review_order(spark):
    s = spark.createDataFrame([(1, 0.9, 10.0), (2, 0.9, 30.0), (3, 0.95, 1.0)], "id int, aoi_clear double, glint_angle double")
    assert [r.id for r in ga.review_order(s).collect()] == [3, 2, 1]


def test_review_and_summaries_are_written(spark, tmp_path):
    from tidelight.sources import sinks

    w = spark.createDataFrame([("a", 100, "full"), ("b", 200, "full"), ("c", 300, "none")], "scene_id string, s long, coverage string").select(
        "scene_id", F.timestamp_seconds("s").alias("acquired_utc"), "coverage")
    e = spark.createDataFrame([("a", "small_craft", 160.0, 25.0, 30.0, 5.0)], "scene_id string, band string, t_peak double, duration_s double, peak_excess double, baseline double")
    r = reports.review_rows(e, w)
    got = {x.scene_id: x for x in r.collect()}
    assert got["a"].minutes_from_acquisition == 1.0 and got["b"].reviewer_notes == "DETECTOR SILENT" and got["c"].reviewer_notes == "NO ACOUSTIC DATA"
    assert got["b"].peak_excess is None
    sinks.write_review(r, str(tmp_path / "review"))
    assert spark.read.csv(str(tmp_path / "review"), header=True).count() == 3
    b = spark.createDataFrame([("a", "rain", 1.0, 2.0, 0), ("a", "control", 5.0, 1.0, 1)], "scene_id string, band string, baseline double, peak_excess double, n_events int")
    s = reports.window_summaries(b, spark.createDataFrame([("a", "vessel", 2)], "scene_id string, label string, n_vessels int"))
    row = s.first()
    assert row.bands["control"].baseline == 5.0 and row.label.n_vessels == 2
    sinks.write_summaries(s, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).first().label.label == "vessel"


def test_provided_baseline_and_empty_series(spark):
    lv = spark.createDataFrame([("a", i, float(i), 20.0) for i in range(100)], "k string, n long, t double, level double")
    base = spark.createDataFrame([("a", 5.0)], "k string, baseline double")
    got = ev.find_events(lv, ["k"], ["n"], "t", base=base).collect()
    assert len(got) == 1 and got[0].n_frames == 100
    assert ev.merge_events(ev.find_events(lv, ["k"], ["n"], "t"), ["k"]).count() == 0


def test_ranges_that_are_not_finite_are_no_sources(spark):
    from tidelight.operators import detections as de

    scenes = spark.createDataFrame([("s",), ("t",), ("u",)], "scene_id string")
    found = spark.createDataFrame([("s", "1", 2.0, False), ("s", "2", None, False), ("s", "3", float("nan"), True), ("t", "4", float("inf"), False)], "scene_id string, id string, range_km double, wake_flag boolean")
    got = {r["scene_id"]: (r["n_detections"], r["dominance"], r["class"]) for r in de.classify_scenes(scenes, found).collect()}
    assert got == {"s": (3, 1.0, "SINGLE-DOMINANT"), "t": (1, None, "EMPTY"), "u": (0, None, "EMPTY")}


def test_an_empty_mask_is_refused(spark):
    from tidelight.operators import raster as ra

    pixels = spark.createDataFrame([("s", 1), ("s", 2), ("s", 9)], "scene_id string, nir int")
    scenes = spark.createDataFrame([("s",), ("t",)], "scene_id string")
    with pytest.raises(Exception, match="no usable pixel"):
        ra.robust_threshold(pixels, "nir", scenes=scenes).collect()
    got = {r["scene_id"]: r["n_px"] for r in ra.robust_threshold(pixels, "nir", fail=False, scenes=scenes).collect()}
    assert got == {"s": 3, "t": 0}


def test_split_count_of_a_series_without_peaks_is_zero(spark):
    from tidelight.operators import estimators as es

    base = spark.createDataFrame([("a", 4)], "k string, mid long")
    bands = spark.createDataFrame([(k, b, i, float(i), float(9 - abs(i - 4))) for k in "ab" for b in (1, 2) for i in range(9)], "k string, band int, place long, t double, smooth double")
    assert sorted(map(tuple, es.split_count(base, bands, ["k"], "place", "t", 4, 1.0, 5.0).collect())) == [("a", 1), ("b", 0)]
