"""Long blocks and short ones, whose edges every step crosses, must give the same rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelight.operators import events as ev
from tidelight.operators import intervals as iv
from tidelight.operators.ordered import Ordered, centred_sum, nearest_rows, number_rows, quantiles

SPLIT = {"block_rows": 7}


@pytest.fixture(scope="module")
def levels(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"k{i % 3}", float(i), i, rnd.choice([0, 1, 2, 15, 20, 22])) for i in range(300)]
    return spark.createDataFrame(rows, "k string, t double, id long, level int").cache()


def table(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_numbering_and_prefix(levels):
    def run(**limits):
        o = number_rows(levels, ["k"], ["t"], **limits)
        o = o.prefix(s=("sum", F.col("level")), m=("max", F.col("level")), l=("last", F.when(F.col("level") > 10, F.col("level"))))
        return o, table(o.rows, "k", "id", "_rn", "s", "m", "l")

    plain, a = run()
    split, b = run(**SPLIT)
    assert plain.block_rows > 7 and split.block_rows == 7
    assert str(a) == str(b)
    want = levels.toPandas().sort_values(["k", "t"])
    want["s"] = want.groupby("k")["level"].cumsum() - want["level"]
    assert [r[3] for r in a] == list(want.sort_values(["k", "id"])["s"])


def test_neighbourhoods_cross_blocks(levels):
    def run(**limits):
        o = number_rows(levels, ["k"], ["t"], **limits)
        return table(o.centred(3, 3, s=centred_sum(F.col("level"), 3), n=lambda w: F.lead("level", 2).over(w)), "k", "id", "s", "n")

    assert str(run()) == str(run(**SPLIT))


def test_runs_and_merging(levels):
    def run(**limits):
        e = ev.find_events(levels, ["k"], ["t"], "t", threshold=10.0, frame_s=1.0, shortest=2, **limits)
        return table(e, "k", "t_start", "t_peak", "n_frames", "peak_excess"), table(ev.merge_events(e, ["k"], 6.0, **limits), "k", "t_start", "t_peak", "n_fragments", "duration_s")

    assert run() == run(**SPLIT)
    assert run()[0]


def test_shuffle_is_reproducible(levels):
    a = table(ev.shuffled(levels, ["k"], ["t"], "id", seed=1), "k", "id", "level")
    assert a == table(ev.shuffled(levels, ["k"], ["t"], "id", seed=1, **SPLIT), "k", "id", "level")
    assert a != table(levels, "k", "id", "level")
    assert sorted(x[2] for x in a) == sorted(x[2] for x in table(levels, "k", "id", "level"))


@pytest.fixture(scope="module")
def spans(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        a = rnd.randrange(0, 20_000)
        rows.append((i, "hot" if rnd.random() < 0.6 else "cold", a, a + rnd.randrange(1, 300)))
    df = spark.createDataFrame(rows, "id int, k string, a long, z long")
    return df.select("id", "k", F.timestamp_seconds("a").alias("start_utc"), F.timestamp_seconds("z").alias("end_utc")).cache()


def test_merge_and_counts_match_brute_force(spans):
    p = spans.toPandas()
    merged = {}
    for strict in (True, False):
        for limits in ({}, SPLIT):
            merged[strict, bool(limits)] = table(iv.merge_intervals(spans, ["k"], 60, strict, **limits), "k", "start_utc", "end_utc", "n_merged")
        assert merged[strict, False] == merged[strict, True]
    w = spans.where("id % 5 = 0").select("id", "k", F.col("start_utc").alias("w_start"), (F.col("end_utc") + F.expr("INTERVAL 50 SECONDS")).alias("w_end"))
    for closed in (False, True):
        got = {}
        for limits in ({}, SPLIT):
            got[bool(limits)] = table(iv.overlap_counts(w, spans, ["id"], ["k"], closed, **limits), "id", "n_overlaps")
        want = []
        for r in w.collect():
            q = p[p.k == r.k]
            hit = (q.start_utc <= r.w_end) & (q.end_utc >= r.w_start) if closed else (q.start_utc < r.w_end) & (q.end_utc > r.w_start)
            want.append((r.id, int(hit.sum())))
        assert got[False] == got[True] == sorted(want)


def test_gaps_need_every_rule(spark):
    flags = [False, True, True, False, False, True, None, False]
    rows = [(i if i < 6 else i + 3, f) for i, f in enumerate(flags) if f is not None]
    bins = spark.createDataFrame(rows, "i int, available boolean").select(
        F.lit("a").alias("k"), F.timestamp_seconds(F.col("i") * 300).alias("start_utc"), F.timestamp_seconds((F.col("i") + 1) * 300).alias("end_utc"), "available")
    for limits in ({}, {"block_rows": 2}):
        gaps = iv.flag_runs(bins, ["k"], ~F.col("available"), **limits)
        runs = iv.flag_runs(bins, ["k"], F.col("available"), **limits)
        assert sorted(r.n_bins for r in gaps.collect()) == [1, 1, 2]
        total = gaps.agg(F.sum("seconds")).first()[0] + runs.agg(F.sum("seconds")).first()[0]
        assert total == 300 * len(rows)  # gap and available time add up


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=501), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 401 + ["b"] * 100, "v": v}))
    got = {r.k: r for r in quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for k, part in (("a", v[:401]), ("b", v[401:])):
        for name, q in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert got[k][name] == pytest.approx(np.percentile(part, q))


def _naive_prominence(x, i):
    h, left, right = x[i], x[i], x[i]
    for j in range(i - 1, -1, -1):
        if x[j] > h:
            break
        left = min(left, x[j])
    for j in range(i + 1, len(x)):
        if x[j] > h:
            break
        right = min(right, x[j])
    return h - max(left, right)


@pytest.mark.parametrize("shape", ["random", "stairs", "ties", "flat"])
def test_prominences_of_long_series(spark, shape):
    rnd = random.Random(11)
    if shape == "random":
        x = [float(rnd.randrange(40)) for _ in range(200)]
    elif shape == "stairs":
        x = [float(i // 2 + (3 if i % 2 else 0)) for i in range(150)]
    elif shape == "flat":
        x = [float(i % 2 * 5 + (i == 90)) for i in range(160)]
    else:
        x = [float([0, 5, 1, 5, 2, 5, 0, 9][i % 8]) for i in range(160)]
    df = spark.createDataFrame([("a", float(i), v) for i, v in enumerate(x)], "k string, t double, level double")
    o = number_rows(df, ["k"], ["t"])
    pts = ev.turning_points(o, "level").cache()
    want = {}
    for r in pts.where("height is not null").collect():
        want[r.mid] = _naive_prominence(x, r.mid)
    for fan in (128, 8, 2):
        got = {r.mid: r.prominence for r in ev.prominences(pts, ["k"], fan=fan).collect()}
        assert got == want


def test_plateau_peak_is_the_floored_middle(spark):
    x = [0, 1, 4, 4, 4, 4, 2, 5, 5, 1, 1]
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate(x)], "k string, t double, level double")
    pts = ev.turning_points(number_rows(df, ["k"], ["t"], block_rows=3), "level")
    assert sorted((r.mid, r.height) for r in pts.where("height is not null").collect()) == [(3, 4.0), (7, 5.0)]


def test_rolling_median_and_slope_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 40).astype(float)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t long, level double")
    pad = np.concatenate([np.repeat(x[0], 3), x, np.repeat(x[-1], 3)])
    want = [float(np.median(pad[i:i + 7])) for i in range(40)]
    for limits in ({}, {"block_rows": 9}):
        o = number_rows(df, ["k"], ["t"], **limits)
        assert [r[1] for r in table(ev.rolling_median(o, "level", 7), "t", "median")] == want
        got = [r[1] for r in table(ev.local_slope(o, "level", 9, 0.25), "t", "slope_per_min")]
        for i in range(40):
            c = min(max(i, 4), 35)
            fit = np.polyfit(np.arange(-4, 5), x[c - 4:c + 5], 2)
            slope = 2 * fit[0] * (i - c) + fit[1]
            assert got[i] == pytest.approx(slope / 0.25 * 60, abs=1e-6)


def test_short_series_slope_is_refused(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "k string, t long, level double")
    with pytest.raises(Exception, match="shorter than the window"):
        ev.local_slope(number_rows(df, ["k"], ["t"]), "level", 9, 0.25).collect()


def test_moving_mean_pads_with_zero(spark):
    df = spark.createDataFrame([("a", i, 6.0) for i in range(6)], "k string, t long, level double")
    got = [r[1] for r in table(ev.smooth_mean(number_rows(df, ["k"], ["t"]), "level", 3), "t", "smooth")]
    assert got == [4.0, 6.0, 6.0, 6.0, 6.0, 4.0]


def test_null_is_a_key_like_any_other(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i, float(i)) for i in range(40)], "k string, t long, level double")
    for limits in ({}, SPLIT):
        o = number_rows(df, ["k"], ["t"], **limits).prefix(s=("sum", F.col("level")))
        assert sorted(((r.k, r["_rn"], r.s) for r in o.rows.collect()), key=str) == sorted(((None if i % 2 else "a", i // 2, float(sum(range(i % 2, i, 2)))) for i in range(40)), key=str)
    assert len(ev.rolling_median(o, "level", 5).collect()) == 40


def test_slope_far_from_the_start_of_a_series(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([("a", i, float(rnd.randrange(200))) for i in range(40)], "k string, t long, level double")
    near = number_rows(df, ["k"], ["t"], **SPLIT)
    far = Ordered(near.rows.withColumn("_rn", F.col("_rn") + 10**9 + 1).withColumn("_block", F.floor(F.col("_rn") / 7)), near.keys, 7)
    got = [r[1] for r in table(ev.local_slope(far, "level", 9, 0.25).where("_rn > 1000000010"), "t", "slope_per_min")]
    assert got == pytest.approx([r[1] for r in table(ev.local_slope(near, "level", 9, 0.25).where("_rn > 9"), "t", "slope_per_min")])


def test_of_equal_places_one_stays(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 5, 2.0), ("a", 9, 1.5), ("b", 5, 1.0)], "k string, mid long, height double")
    for reach in (1, 1000):
        kept = ev.apart(df, ["k"], "mid", 3, [-F.col("height")], reach=reach)
        assert table(kept, "k", "mid", "height") == [("a", 5, 2.0), ("a", 9, 1.5), ("b", 5, 1.0)]


def test_prominences_of_ten_million_points(spark):
    n, every = 10_000_000, 9973
    i = F.col("id")
    height = (i * 7919 + (i * i) % 104_729 + F.floor(i / 40) % 90_001) % 1_000_003
    points = spark.range(n).select(F.lit("a").alias("k"), i.alias("n"), i.alias("mid"), F.when(i > 0, height).cast("double").alias("height"), ((i * 104_659) % 999_983 - 1_000_000).cast("double").alias("valley"))
    got = {r.mid: r.prominence for r in ev.prominences(points, ["k"], points.where((i > 0) & (i % every == 0))).collect()}
    k = np.arange(n, dtype=np.int64)
    h, v = (k * 7919 + k * k % 104_729 + k // 40 % 90_001) % 1_000_003, k * 104_659 % 999_983 - 1_000_000
    h[0] = -1
    size = 4096
    tops = np.maximum.reduceat(h, np.arange(0, n, size))

    def higher(at, step):  # the next point above on one side, block by block
        b = at // size
        here = np.arange(at + 1, min(n, (b + 1) * size)) if step > 0 else np.arange(at - 1, b * size - 1, -1)
        hit = np.flatnonzero(h[here] > h[at])
        if len(hit):
            return here[hit[0]]
        far = np.flatnonzero(tops[b + 1 :] > h[at]) if step > 0 else np.flatnonzero(tops[:b][::-1] > h[at])
        if not len(far):
            return None
        c = b + 1 + far[0] if step > 0 else b - 1 - far[0]
        there = np.arange(c * size, min(n, (c + 1) * size))[::step]
        return there[np.flatnonzero(h[there] > h[at])[0]]

    assert len(got) == (n - 1) // every
    for at, prominence in got.items():
        a, z = higher(at, -1), higher(at, 1)
        left, right = v[(0 if a is None else a) : at].min(), v[at : n if z is None else z].min()
        assert prominence == h[at] - max(left, right)


def test_sliding_order_statistics_match_sorting():
    rng = np.random.default_rng(8)
    for values in (rng.integers(0, 40, 300), rng.integers(-5, 5, 300) * 0.5, np.zeros(50), rng.normal(size=200), np.arange(64)[::-1]):
        for width in (1, 2, 7, 49):
            for rank in {0, width // 2, width - 1}:
                got = ev.sliding_order_statistic(values, width, rank)
                assert np.array_equal(got, [np.sort(values[i : i + width])[rank] for i in range(len(values) - width + 1)])


def test_means_of_whole_numbers_and_of_fractions_agree(spark):
    rnd = random.Random(4)
    rows = [("a" if i < 60 else "b", i, rnd.randrange(100)) for i in range(75)]
    df = spark.createDataFrame(rows, "k string, t long, level int").withColumn("x", F.col("level").cast("double"))
    for limits in ({}, {"block_rows": 5}):
        for frames in (1, 5, 31):
            o = number_rows(df, ["k"], ["t"], **limits)
            whole, parts = (dict(table(ev.smooth_mean(o, c, frames), "t", "smooth")) for c in ("level", "x"))
            assert whole == pytest.approx(parts)
            h = frames // 2
            for k, first, last in (("a", 0, 60), ("b", 60, 75)):
                level = {i: v for _, i, v in rows[first:last]}
                assert [whole[i] for i in level] == pytest.approx([sum(level.get(j, 0) for j in range(i - h, i + h + 1)) / frames for i in level])


def test_nearest_rows_of_several_series(spark):
    rnd = random.Random(6)
    frames = [(rnd.choice("uv"), rnd.choice(["p", "q", "r"]), float(t), float(i)) for i, t in enumerate(rnd.sample(range(1000), 150))]
    points = [(rnd.choice("uv"), i, rnd.randrange(1000) + rnd.choice([0.0, 0.5])) for i in range(60)] + [("w", 99, 5.0)]
    f = spark.createDataFrame(frames, "k string, lane string, t double, v double")
    p = spark.createDataFrame(points, "k string, id long, t double")
    for limits in ({}, {"block_rows": 4}):
        got = {r.id: r.near for r in nearest_rows(p, f, ["k"], "t", "lane", ["p", "q", "r"], "v", "near", **limits).collect()}
        for k, i, t in points:
            for lane, value in zip("pqr", got[i], strict=True):
                own = [(abs(x - t), x, v) for kk, ll, x, v in frames if kk == k and ll == lane]
                assert value == (min(own)[2] if own else None)
