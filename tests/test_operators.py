"""Operators on small hand-made inputs: bounds, ties, empty groups, single rows, nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import arrays, bins, clock, detect, erp, fit, islands, psth, ranges, report, scores


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_range_pairs_equal_nested_loop(spark):
    rng = random.Random(20)
    a = [(i, rng.randint(-50, 50)) for i in range(40)]
    b = [(i, rng.randint(-80, 80)) for i in range(150)]
    left, right = spark.createDataFrame(a, "trial long, t0 long"), spark.createDataFrame(b, "e long, t long")
    for before, after in ((5, 5), (0, 7), (-2, 9), (30, 40), (6, -3)):
        for closed in (False, True):
            want = sorted((i, j) for i, t0 in a for j, t in b if t0 - before <= t and (t <= t0 + after if closed else t < t0 + after))
            assert rows(ranges.range_pairs(left, right, "t0", "t", before, after, closed=closed), "trial", "e") == want
    held = {i for i, t0 in a if any(t0 - 1 <= t < t0 + 1 for _, t in b)}
    assert [i for i, _ in rows(ranges.range_pairs(left, right, "t0", "t", 1, 1, how="left_anti"))] == sorted({i for i, _ in a} - held)
    assert [i for i, _ in rows(ranges.range_pairs(left, right, "t0", "t", 1, 1, how="left_semi"))] == sorted(held)


def test_nearest_prefers_the_earlier_of_equals_and_half_open_bounds(spark):
    a = spark.createDataFrame([(1, 100), (2, 200), (3, 1000)], "trial long, t0 long")
    s = spark.createDataFrame([(95,), (105,), (190,), (210,)], "t long")
    assert rows(ranges.nearest_in_window(a, s, "t0", "t", 0, 10, ("trial",))) == [(1, 95, 5), (2, 190, 10)]
    assert rows(ranges.nearest_in_window(a, s, "t0", "t", 10, 10, ("trial",))) == [(1, 105, 5), (2, 210, 0)]


def test_greedy_match_is_the_loop(spark):
    rng = random.Random(21)
    a = sorted((rng.randint(0, 300), i) for i in range(30))
    b = sorted({rng.randint(0, 300) for _ in range(20)})
    taken, want = set(), []
    for t0, i in a:
        t = min(b, key=lambda v: (abs(v - t0), v))
        if abs(t - t0) < 15 and t not in taken:
            taken.add(t)
            want.append((i, t))
    left = spark.createDataFrame([(i, t0) for t0, i in a], "trial long, t0 long")
    got = ranges.greedy_one_to_one(left, spark.createDataFrame([(t,) for t in b], "t long"), "trial", "t0", "t", 15)
    assert rows(got, "trial", "t") == sorted(want)


def test_previous_looks_over_empty_buckets(spark):
    df = spark.createDataFrame([("a", t, t * 10) for t in (1, 2, 9, 100, 101, 5000)] + [("b", 7, 70)], "k string, t long, v long")
    got = ranges.previous(df, ("k",), ("t",), ("v",), F.floor(F.col("t") / 10))
    assert [(r["t"], r["prev_v"]) for r in got.orderBy("k", "t").collect()] == [(1, None), (2, 10), (9, 20), (100, 90), (101, 1000), (5000, 1010), (7, None)]


def test_histogram_counts_silent_trials_and_the_window_end_is_out(spark):
    a = spark.createDataFrame([(1, 100), (2, 500)], "trial long, t0 long")
    s = spark.createDataFrame([("u", 90), ("u", 100), ("u", 109), ("u", 110), ("v", 9999)], "unit string, t long")
    assert rows(psth.counts(a, s, 10, 10, 10)) == [("u", 0, 1), ("u", 1, 2)]
    rate = psth.rates(a, s, 10, 10, 10, 10)
    assert rows(rate) == [("u", 0, 1, 0.5), ("u", 1, 2, 1.0), ("v", 0, 0, 0.0), ("v", 1, 0, 0.0)]
    sharp = {r["unit"]: r for r in psth.sharpness(rate, 10, 10, 0).collect()}
    assert (sharp["u"]["score"], sharp["u"]["latency"], sharp["v"]["score"]) == (0.5, 5.0, 0.0)


def test_classes(spark):
    z = {"motor": [0, 9, 1, 0], "reward": [0, 1, 9, 0], "less": [0, 0, -9, 1], "none": [0, 1, 1, 1], "tie": [0, 9, 9, 0]}
    df = spark.createDataFrame([(u, i, float(v)) for u, vs in z.items() for i, v in enumerate(vs)], "unit string, bin long, z double")
    got = {r["unit"]: (r["unit_class"], r["peak_z"], r["latency"]) for r in psth.classify(df, 20, 10, 10, 3.0).collect()}
    assert got == {"motor": ("MOTOR", 9, -5), "reward": ("REWARD", 9, 5), "less": ("SUPPRESSED", -9, 15), "none": ("UNRESPONSIVE", 1, 5), "tie": ("REWARD", 9, 5)}


def clip(x, y, sigma):
    mask = np.ones(len(x), dtype=bool)
    for _ in range(3):
        if mask.sum() < 10:
            break
        s, i = np.polyfit(x[mask], y[mask], 1)
        r = y - s * x - i
        mask = np.abs(r) < sigma * r[mask].std()
    return mask


def test_fits_against_numpy(spark):
    rng = np.random.default_rng(22)
    data, want = [], {}
    for g in range(4):
        x = rng.random(60) * 100
        y = 1.5 * x + g + rng.normal(size=60) * (1 + 9 * (rng.random(60) < 0.2))
        data += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        want[g] = (np.polyfit(x, y, 1), clip(x, y, 1.5), x, y)
    data += [(9, 0, 1.0, 2.0), (9, 1, 1.0, 3.0)]
    df = spark.createDataFrame(data, "g int, i int, x double, y double")
    got = {r["g"]: r for r in fit.ols(df, "g", "x", "y").collect()}
    assert got[9]["slope"] is None
    kept = {}
    for r in fit.sigma_clip(df, "g", "x", "y", 1.5).collect():
        kept.setdefault(r["g"], {})[r["i"]] = r["kept"]
    robust = {r["g"]: r for r in fit.huber(df, "g", "x", "y").collect()}
    for g, ((s, i), mask, x, y) in want.items():
        assert np.isclose(got[g]["slope"], s) and np.isclose(got[g]["intercept"], i) and np.isclose(got[g]["rmse"], np.sqrt(np.mean((y - s * x - i) ** 2)))
        assert [kept[g][k] for k in range(60)] == mask.tolist()
        w = np.ones(60)
        for _ in range(9):
            a, b = np.polyfit(x, y, 1, w=np.sqrt(w))
            off = np.abs(y - a * x - b)
            w = np.where(off <= 1, 1, 1 / off)
        assert np.isclose(robust[g]["slope"], a, atol=1e-6)


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 7.0, 1.0), (1, 9.0, 3.0), (2, 4.0, 1.0), (3, 1.0, 1.0), (3, 2.0, 1.0)], "k int, v double, w double")
    assert rows(fit.weighted_median(df, ("k",), "v", "w")) == [(1, 3, 9.0), (2, 1, 4.0), (3, 2, 1.0)]


def test_edges_debounce_islands_gaps(spark):
    t = [0, 1, 5, 6, 20, 21, 40]
    df = spark.createDataFrame([("s", v, i, i in (2, 3, 5)) for i, v in enumerate(t)], "k string, t long, row long, up boolean")
    assert [r["row"] for r in islands.edges(df, ("k",), "t", "row", "up").orderBy("row").collect()] == [2, 4, 5, 6]
    assert [r["row"] for r in islands.debounced(df, ("k",), "t", "row", 3).orderBy("row").collect()] == [0, 2, 4, 6]
    assert rows(islands.largest_gap(df, "t", "row")) == [(19, 21, 40)]
    ts = df.withColumn("ts", F.timestamp_micros("t"))
    assert sorted(r["n"] for r in islands.islands(ts, ("k",), F.col("ts"), 4, F.count("*").alias("n")).collect()) == [1, 2, 4]
    assert islands.largest_gap(df.limit(1), "t", "row").collect()[0]["gap"] is None


def test_bins_and_yield(spark):
    df = spark.createDataFrame([("a", 25), ("b", 35), ("c", 95), ("a", 1)], "f string, t long")
    d = bins.dilated(df, "f", "t", 10, 1, 0, 9)
    assert rows(d) == sorted([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 4), ("c", 8), ("c", 9)])
    assert rows(bins.combinations(d, "f", 2)) == [("a", "b", 2), ("a", "b", 3)] and rows(bins.combinations(d, "f", 3)) == []
    r = spark.createDataFrame([(1, 100), (2, 200)], "trial long, t0 long")
    e = spark.createDataFrame([("u", 1, 104), ("u", 2, 105), ("v", 3, 900)], "by string, event long, t long")
    assert rows(bins.yields(r, e, "by", 5)) == [("u", 2, 0.5, 0.5, 0.25), ("v", 1, 0.0, 1.0, 0.0)]


def test_clock_rules(spark):
    df = spark.createDataFrame([("s", 0, 50, 7), ("s", 1, 40, 1000), ("s", 2, 90, 1000), ("u", 3, 30, 7), ("u", 4, 20, 7)], "s string, row long, t long, code int")
    want = {
        "zero_or_raw": [10, 0, 50, 30, 20], "zero_or_first": [10, 0, 50, 0, -10], "zero_or_min": [10, 0, 50, 10, 0],
        "first": [0, -10, 40, 0, -10], "min": [10, 0, 50, 10, 0],
    }
    for mode, zeroed in want.items():
        got = clock.zero_clock(df, mode, "s", "t", "row", F.col("code") == 1000)
        assert [r["t0"] for r in got.orderBy("row").collect()] == zeroed, mode
    with pytest.raises(ValueError):
        clock.zero_clock(df, "last", "s", "t", "row", F.lit(True))
    t = spark.range(1).select(clock.micros(F.lit("2024-03-31 02:30:00.123456").cast("timestamp_ntz")).alias("t")).first()["t"]
    assert t == 1_711_852_200_123_456
    x = spark.range(1).select(clock.unwarp(clock.warp(F.lit(7.0), 2.0, 1.0), 2.0, 1.0).alias("a"), clock.unwarp_divided(F.lit(15.0), 2.0, 1.0).alias("b")).first()
    assert (x["a"], x["b"]) == (7.0, 6.5)


def test_piecewise_warp_extends_its_ends(spark):
    knots = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 20.0), ("a", 20, 30.0), ("b", 5, 1.0)], "k string, x long, y double")
    points = spark.createDataFrame([("a", -5), ("a", 5), ("a", 10), ("a", 15), ("a", 30), ("b", 5), ("c", 1)], "k string, t long")
    got = clock.piecewise_warp(points, knots, "k", "t", "x", "y", 7).orderBy("k", "t").collect()
    assert [r["warped"] for r in got] == [-10.0, 10.0, 20.0, 25.0, 40.0, None, None]


def test_windows_and_scores(spark):
    trace = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "k string, idx long, z double")
    trials = spark.createDataFrame([("s", 1, "c", 0), ("s", 2, "c", 4), ("s", 3, "c", 8)], "k string, trial long, code string, idx0 long")
    w = erp.windows(trials, trace, ("k",), 2, 2)
    assert rows(w, "trial", "rel", "z") == [(2, -2, 2.0), (2, -1, 3.0), (2, 0, 4.0), (2, 1, 5.0), (3, -2, 6.0), (3, -1, 7.0), (3, 0, 8.0), (3, 1, 9.0)]
    assert erp.score(w).first()["score"] == 0.0
    m = {r["rel"]: (r["n"], r["mean"], r["sem"]) for r in erp.mean_sem(w).collect()}
    assert m[0] == (2, 6.0, pytest.approx(2 / 2**0.5))
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 10.0)], "k string, v double")
    assert rows(scores.zscore(flat, "k", "v"), "k", "z") == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)]
    assert rows(scores.normalize01(flat, "k", "v"), "k", "unit") == [("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 1.0)]


def test_two_stages(spark):
    a = spark.createDataFrame([(1, 0), (2, 1000), (3, 2000)], "trial long, t0 long")
    p = spark.createDataFrame([(10, 4.0), (12, 4.0), (1010, 2.0), (2010, 0.5)], "t long, z double")
    o = spark.createDataFrame([("f", 12, 9.0), ("f", 13, 0.0), ("g", 11, 8.0), ("f", 1009, 0.7), ("f", 1011, 0.1)], "feature string, t long, z double")
    got = {r["trial"]: r for r in detect.two_stage(a, p, o, 20, 20, 5).collect()}
    assert set(got) == {1, 2}
    assert got[1]["source"] == "both" and got[1]["time"] == pytest.approx(10 + 2 * 2 / 6) and got[1]["confidence"] == pytest.approx(13 / 15)
    assert got[2]["source"] == "primary" and got[2]["time"] == 1010 and got[2]["confidence"] == pytest.approx(0.4)


def test_array_operators(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(40, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "s long, c array<float>")
    x = x.astype(float)
    got = arrays.common_average(df, "c").orderBy("s").collect()
    assert np.allclose([r["common"] for r in got], np.median(x, axis=1)) and np.allclose([r["referenced"] for r in got], x - np.median(x, axis=1, keepdims=True))
    blocks = np.median([np.median(x[:, s : s + 32], axis=1) for s in (0, 16, 32)], axis=0)
    assert np.allclose([r["block_median"] for r in arrays.block_median(df, "c").orderBy("s").collect()], blocks)
    d = arrays.derivative(df.select("s", F.get("c", F.lit(0)).cast("double").alias("v")), "s", "v").orderBy("s").collect()
    assert np.allclose([r["step"] for r in d], np.diff(x[:, 0], prepend=x[0, 0]))
    top = arrays.top_channels(df, "c", 20, 3).orderBy("block", "rank").collect()
    power = (x * x).sum(axis=0)
    assert [r["channel"] for r in top] == [c for b in (0, 20) for c in (np.argsort(-power[b : b + 20])[:3] + b).tolist()]
    assert rows(arrays.bin_sum(df.select("s", F.lit(1.0).alias("v")), "s", "v", 16)) == [(0, 16.0), (1, 16.0)]


def test_interpolation_and_running_median(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, None), ("b", 0, None)], "k string, i long, v double")
    assert [r["filled"] for r in report.interpolated(df, ("k",), "i", "v").orderBy("k", "i").collect()] == [2.0, 2.0, 4.0, 6.0, 6.0, None]
    m = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 9, 3, 7])], "k string, i long, v double")
    assert [r["running"] for r in report.running_median(m, ("k",), ("i",), "v", 2).orderBy("i").collect()] == [5.0, 3.0, 5.0, 7.0]
    bands = spark.createDataFrame([(4.0,), (5.0,), (20.0,), (50.0,)], "r double").select(report.quality_band("r").alias("b"))
    assert [r["b"] for r in bands.collect()] == ["EXCELLENT", "GOOD", "OK", "POOR"]


def test_candidates(spark):
    from spindrift.operators import candidates as c

    x = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([0, 3, 1, 1, 5, 5, 2, 4])], "k string, i long, v double")
    assert rows(c.local_maxima(x, ("k",), "i", "v"), "i") == [(1,)]
    t = spark.createDataFrame([("a", 0), ("a", 4), ("a", 100), ("b", 7)], "k string, t long")
    assert rows(c.isolation(t, ("k",), ("t",), "t", 10.0)) == [("a", 0, 0.4), ("a", 4, 0.4), ("a", 100, 1.0), ("b", 7, 1.0)]
    s = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0), (3, 1.0), (3, 5.0), (3, 2.0)], "trial int, s double")
    assert rows(c.confidence(s, "trial", "s"), "trial", "confidence") == [(1, 1.0), (2, 0.5), (2, 0.5), (3, 0.0), (3, 0.25), (3, 1.0)]
    z = spark.createDataFrame([(1, "f", 2.0), (1, "g", 4.0), (1, "h", 9.0), (2, "f", -1.0)], "p int, f string, z double")
    assert rows(c.weighted_scores(z, ("p",), "f", "z", {"f": 1.0, "g": 0.5})) == [(1, 4.0, 3), (2, 0.0, 1)]
    assert rows(c.sweep(s, "s", [2.0, 3.0]).groupBy("threshold").count()) == [(2.0, 5), (3.0, 3)]
    assert rows(c.histogram(s, "s", 4, 0.0)) == [(0, 1), (1, 2), (2, 2), (3, 1)]
    share = spark.range(4000).select(c.split(F.col("id"), 1, 0.8).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert 0.77 < share < 0.83


def test_smoothing_mirrors_its_ends(spark):
    from spindrift.functions.kernels import gaussian
    from spindrift.operators.candidates import smoothed

    v = np.random.default_rng(27).random(12)
    df = spark.createDataFrame([("u", i + 3, float(x)) for i, x in enumerate(v)], "k string, b long, v double")
    got = smoothed(df, ("k",), "b", "v", 1.5, 3, 14).orderBy("bin").collect()
    assert np.allclose([r["smooth"] for r in got], gaussian(v, 1.5))
    with pytest.raises(ValueError):
        smoothed(df, ("k",), "b", "v", 9.0, 3, 14)
