import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import blocks, candidates, coincidence, detect, psth, scores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log(r, n, last):
    """Trials and rows of three units, some at equal times, over several blocks."""
    trials = [(i, r.randint(-last, last)) for i in range(n)]
    return trials, [(r.choice("abc"), r.choice([r.randint(-last, last), trials[r.randrange(n)][1]])) for _ in range(4 * n)]


def test_counts_by_bin(spark):
    r = random.Random(5)
    trials, rows = log(r, 60, 900)
    df = spark.createDataFrame(trials, "trial long, t0 long"), spark.createDataFrame([*rows, ("a", None), (None, 3)], "unit string, t long")
    for before, after, width, size in ((100, 100, 20, None), (-10, 95, 20, 50), (40, 300, 7, 1000), (0, 1, 1, 7)):
        want = Counter((u, (t - t0 + before) // width) for _, t0 in trials for u, t in [*rows, (None, 3)] if -before <= t - t0 < after)
        got = blocks.counts(*df, "unit", "t0", "t", before, after, width, size).collect()
        assert {(g["unit"], g["bin"]): g["n"] for g in got} == want and len(got) == len(want)


def test_counts_without_pairs(spark):
    """60,000 trials and as many spikes at one time make 3.6e9 pairs, which are counted and never made."""
    n = 60_000
    a, s = spark.range(n).select(F.col("id").alias("trial"), F.lit(500).cast("long").alias("t0")), spark.range(n).select((F.col("id") % 2).alias("unit"), F.lit(505).cast("long").alias("t"))
    found = psth.counts(a, s, 10, 10, 10)
    assert "Join" not in plan(found)
    assert sorted(tuple(x) for x in found.collect()) == [(0, 1, n * n // 2), (1, 1, n * n // 2)]


def crowd(spark, n):
    """n trials at one time, and n rows of two features just after it: 0.01 more in each row, the last at the largest."""
    a = spark.range(n).select(F.col("id").alias("trial"), F.lit(500).cast("long").alias("t0"))
    x = spark.range(n).select(F.col("id").alias("event"), (F.lit(501) + F.col("id") % 5).alias("t"), (F.col("id") * 0.01).alias("value"), (F.col("id") % 2).cast("string").alias("feature"))
    return a, x


def test_reliability_by_definition(spark):
    r = random.Random(7)
    trials, rows = log(r, 50, 700)
    trials += [trials[0], (trials[1][0], trials[1][1] + 333)]  # a trial twice, and one of two times
    latency = {"a": -12.5, "b": 60.0, "c": 7.0}
    got = psth.reliability(
        spark.createDataFrame(trials, "trial long, t0 long"), spark.createDataFrame([*rows, ("d", 1)], "unit string, t long"),
        spark.createDataFrame([*latency.items(), ("d", None)], "unit string, latency double"), 40, 64, 10,
    ).collect()
    want = {u: len({i for i, t0 in trials for v, t in rows if v == u and -40 <= t - t0 < 64 and abs(t - t0 - at) <= 10}) / len(trials) for u, at in latency.items()}
    assert {g["unit"]: g["reliability"] for g in got} == want | {"d": 0.0}


def test_reliability_without_pairs(spark):
    a, x = crowd(spark, 60_000)
    latency = spark.createDataFrame([("0", 2.0), ("1", 90.0)], "unit string, latency double")
    got = psth.reliability(a, x.select(F.col("feature").alias("unit"), "t"), latency, 10, 100, 1)
    assert {g["unit"]: g["reliability"] for g in got.collect()} == {"0": 1.0, "1": 0.0}


def key(v):
    """Null, then numbers, then NaN."""
    return (0, 0) if v is None else (2, 0) if np.isnan(v) else (1, v)


def test_best_of_windows_by_definition(spark):
    r = random.Random(8)
    trials, times = log(r, 60, 900)
    rows = [(f, t, r.choice([None, float("nan"), float("inf"), -0.0, *[r.randint(-3, 9) / 2 for _ in range(12)]])) for f, t in times]
    df = spark.createDataFrame(trials, "trial long, t0 long"), spark.createDataFrame(rows, "feature string, t long, value double")
    for before, after, closed, feature, size in ((30, 50, True, "feature", None), (30, 50, False, None, 70), (-5, 5, True, None, 3), (2, 400, False, "feature", 10**6)):
        want = {}
        for trial, t0 in trials:
            for f in "abc" if feature else " ":
                own = [(t, v) for g, t, v in rows if f in (g, " ") and -before <= t - t0 and (t - t0 < after or closed and t - t0 == after)]
                if own:
                    t, v = max(own, key=lambda x: (key(x[1]), -x[0]))
                    some = [v for _, v in own if v is not None]
                    want[trial, f] = (len(own), repr(v), t, repr(min(some, key=key) + 0.0) if some else "None")
        got = blocks.window_best(*df, before, after, closed, feature, size).collect()
        zero = lambda v: repr(v if v is None else v + 0.0)
        assert {(g["trial"], g["feature"] if feature else " "): (g["n"], zero(g["hi"]), g["t"], zero(g["lo"])) for g in got} == {k: (n, v.replace("-0.0", "0.0"), t, w) for k, (n, v, t, w) in want.items()}
        assert len(got) == len(want)


def test_window_hits_without_pairs(spark):
    a, x = crowd(spark, 60_000)
    found = scores.window_hits(a, x.select("t", "value"), 10, 10, 599.0)
    assert "Join" not in plan(found)
    assert [tuple(g) for g in found.groupBy("peak", "off", "hit").count().collect()] == [(599.99, 5, True, 60_000)]


def test_two_stages_without_pairs(spark):
    a, x = crowd(spark, 60_000)
    first = x.where("feature = '0'").select("t", F.col("value").alias("z"))
    found = detect.two_stage(a, first, x.where("feature = '1'").select("feature", "t", F.col("value").alias("z")), 10, 10, 3)
    assert [tuple(g) for g in found.groupBy("source", "t1").count().collect()] == [("both", 504, 60_000)]


def test_best_candidates_by_definition(spark):
    """The best row at six digits, as all pairs give it: near ties, nulls, NaN, infinities, equal and lone rows."""
    r = random.Random(9)
    trials, times = log(r, 70, 900)
    trials += [trials[0], (trials[1][0], trials[1][1] + 5)]
    for values in ([0.0, 1.0, 1.0 - 2e-7, 1.0 - 4.9e-7, 1.0 - 5.1e-7, None], [2.0, None], [float("nan"), 1.0, 3.0], [float("inf"), 1.0, -float("inf"), 2.0], [2.5]):
        rows = [(i, t, r.choice(values)) for i, (_, t) in enumerate(times)] + [(None, 17, values[0])]
        df = spark.createDataFrame(trials, "trial long, t0 long"), spark.createDataFrame(rows, "event long, t long, value double")
        pairs = candidates.window_confidence(*df, 9, 12).select("trial", "event", F.abs(F.col("t") - F.col("t0")).alias("off"), F.round("confidence", 6).alias("confidence"))
        want = {}
        for p in pairs.where("confidence IS NOT NULL").collect():
            best = (key(p["confidence"]), -(p["event"] if p["event"] is not None else 2**63 - 1), -p["off"])
            want[p["trial"]] = max(want.get(p["trial"], best), best)
        grid = [0.5, 1.0], [0.2, 0.7]
        got = candidates.weight_sweep(candidates.best_candidates(*df, 9, 12, 50), *grid)
        conf = {t: float("nan") if b[0][0] == 2 else b[0][1] for t, b in want.items()}
        for w in grid[0]:
            for m in grid[1]:
                held = [-want[t][2] for t, c in conf.items() if np.isnan(c) or c * w >= m]
                row = [(g["n"], g["mae"]) for g in got.collect() if (g["weight"], g["min_conf"]) == (w, m)]
                assert row == ([(len(held), sum(held) / len(held))] if held else []), (values, w, m)


def test_candidates_without_pairs(spark):
    a, x = crowd(spark, 60_000)
    found = candidates.best_candidates(a, x.select("event", "t", "value"), 10, 10)
    assert [tuple(g) for g in found.groupBy("event", "confidence", "off").count().collect()] == [(59_999, 1.0, 5, 60_000)]


def test_confidence_shuffles_no_pairs(spark):
    """The join of trials and rows is the last of the plan but for expressions."""
    a, x = crowd(spark, 100)
    found = candidates.window_confidence(a, x.select("event", "t", "value"), 10, 10)
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above and found.count() == 10_000


def test_nearest_by_definition(spark):
    r = random.Random(10)
    trials, rows = log(r, 60, 900)
    df = spark.createDataFrame(trials, "trial long, t0 long"), spark.createDataFrame([*rows, (None, 40)], "unit string, t long")
    for shift, tolerance, size in ((0, 10, None), (25, 60, 50), (-30, 5, 7)):
        want = {}
        for trial, t0 in trials:
            for u, t in [*rows, (None, 40)]:
                if -tolerance <= t - t0 - shift < tolerance:
                    want.setdefault((trial, u, t0), []).append((abs(t - t0 - shift), t))
        got = blocks.nearest(*df, "unit", shift, tolerance, size).collect()
        assert {(g["trial"], g["unit"], g["t0"]): (g["off"], g["t"]) for g in got} == {k: min(v) for k, v in want.items()} and len(got) == len(want)


def test_nearest_without_pairs(spark):
    a, x = crowd(spark, 60_000)
    found = blocks.nearest(a, x.select(F.col("feature").alias("unit"), "t"), "unit", 3, 10)
    assert "Join" not in plan(found)
    assert [tuple(g) for g in found.groupBy("t", "off").count().collect()] == [(503, 0, 120_000)]


def test_window_candidates_without_pairs(spark):
    """Trials of one time search their window once: 20,000 windows of 20,000 rows give each the same peaks."""
    n = 20_000
    a = spark.range(n).select(F.col("id").alias("trial"), F.lit(500).cast("long").alias("t0"))
    x = spark.range(n).select(F.lit("a").alias("feature"), F.col("id").alias("t"), F.when(F.col("id") == 700, 9.0).otherwise((F.col("id") % 7).cast("double")).alias("y"))
    found = detect.window_candidates(x, a, n, n)
    assert "Join" not in plan(found)
    each = found.groupBy("t", "y").count().collect()
    assert {g["count"] for g in each} == {n} and (700, 9.0) in {(g["t"], g["y"]) for g in each}


def test_events_over_blocks(spark):
    """Runs that reach over blocks of bins, and sets without a common bin, as the definition has them."""
    r = random.Random(11)
    bins = {f: sorted({b for b in range(-700, 900) if r.random() < p and not 100 < b < 380}) for f, p in (("a", 0.98), ("b", 0.6), ("c", 0.05))} | {"d": [5000]}
    sets = [["a", "b"], ["a", "c"], ["a", "b", "c"], ["a", "d"]]
    single = spark.createDataFrame([(f, b) for f, own in bins.items() for b in own], "feature string, bin long")
    for gap in (1, 2, 40):
        common = [(s, b) for s in sets for b in set.intersection(*[set(bins[f]) for f in s])]
        want = coincidence.events_of(spark.createDataFrame(common, "features array<string>, bin long"), 10, gap).collect()
        got = [coincidence.events_in(single, spark.createDataFrame([(s,) for s in sets if len(s) == k], "features array<string>"), 10, gap).collect() for k in (2, 3)]
        assert sorted(tuple(g) for part in got for g in part) == sorted(tuple(w) for w in want) and want


def test_bounds_and_yields_of_a_crowd(spark):
    """60,000 rewards that reach the same bins are one row; and their pairs with events are never made."""
    n = 60_000
    rewards = spark.range(n).select(F.col("id").alias("trial"), (F.lit(5000) + F.col("id") % 2 * 10**6).alias("t0"))
    single = spark.createDataFrame([(f, b) for f in "ab" for b in range(480, 520)] + [("c", 480), ("c", 10**6)], "feature string, bin long")
    sets = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "d"],)], "features array<string>")
    got = coincidence.bounds(single, sets, rewards, 10, 2, 50).collect()
    assert {tuple(g["features"]): g["bound"] for g in got} == {("a", "b"): 0.5, ("a", "c"): 0.0}
    events = spark.createDataFrame([(["a", "b"], t) for t in [4990, 5000, 5049, 5050] * 500], "features array<string>, t long")
    found = coincidence.yields(rewards, events, 50)
    assert [(g["features"], g["n"], g["hit_rate"], g["false_rate"]) for g in found.collect()] == [(["a", "b"], 2000, 0.5, 0.25)]
