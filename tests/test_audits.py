import random
from itertools import combinations

import numpy as np

from spindrift.functions import kernels
from spindrift.jobs import audits
from spindrift.operators import audit, coincidence, detect


def brute(peaks, rewards, width, dilation, gap, window, most, top):
    """All sets, scored one by one."""
    bins = {}
    for f, t in peaks:
        bins.setdefault(f, set()).update(range(t // width - dilation, t // width + dilation + 1))
    board = []
    for k in range(2, most + 1):
        for names in combinations(sorted(bins), k):
            both = sorted(set.intersection(*[bins[n] for n in names]))
            runs = []
            for b in both:
                if runs and b - runs[-1][-1] <= gap:
                    runs[-1].append(b)
                else:
                    runs.append([b])
            at = [sum(r) * width // len(r) for r in runs]
            if not at:
                continue
            hit = sum(any(abs(t - t0) < window for t in at) for _, t0 in rewards) / len(rewards)
            false = 1 - sum(any(abs(t - t0) < window for _, t0 in rewards) for t in at) / len(at)
            board.append((-hit * (1 - false), k, list(names), len(at)))
    return sorted(board)[:top], len(board)


def test_search_equals_all_sets(spark):
    """The same leaderboard as scoring all sets of up to four of 20 features, with most of them never listed."""
    r = random.Random(6)
    rewards = [(i, 5000 + i * 4000 + r.randint(0, 900)) for i in range(60)]
    good = {f"g{i}": 0.95 - 0.05 * i for i in range(5)}
    peaks = [(f, t0 + r.randint(-60, 60)) for f, p in good.items() for _, t0 in rewards if r.random() < p]
    peaks += [(f"n{i:02d}", r.randint(0, 250_000)) for i in range(15) for _ in range(70)]
    want, every = brute(peaks, rewards, 50, 2, 3, 150, 4, 10)
    board, listed = coincidence.search(spark.createDataFrame(peaks, "feature string, t long"), spark.createDataFrame(rewards, "trial long, t0 long"), 50, 2, 3, 150, 4, 10)
    got = board.collect()
    assert [(b["features"], b["n"]) for b in got] == [(names, n) for _, _, names, n in want]
    assert np.allclose([b["yield"] for b in got], [-y for y, *_ in want])
    assert sum(listed) < 0.6 * every


def test_runs_of_bins(spark):
    sets = spark.createDataFrame([(["a"], b) for b in (0, 1, 2, 5, 8, 9, 13, 15)] + [(["a", "b"], 4)], "features array<string>, bin long")
    got = sorted((r["features"], r["t"]) for r in coincidence.events_of(sets, 10, 2).collect())
    assert got == [(["a"], 10), (["a"], 50), (["a"], 85), (["a"], 140), (["a", "b"], 40)]


def test_search_of_little(spark):
    empty = spark.createDataFrame([], "feature string, t long"), spark.createDataFrame([], "trial long, t0 long")
    assert coincidence.search(*empty, 50, 2, 3, 150)[0].collect() == []
    one = spark.createDataFrame([("a", 100), ("a", 100)], "feature string, t long"), spark.createDataFrame([(1, 100)], "trial long, t0 long")
    assert coincidence.search(*one, 50, 2, 3, 150)[0].collect() == []


def audited(peaks, rewards, before, after):
    out = {}
    for f in {f for f, _ in peaks}:
        own = sorted({t for g, t in peaks if g == f})
        off = [min(abs(t - t0) for t in own if -before <= t - t0 <= after) for t0 in rewards if any(-before <= t - t0 <= after for t in own)]
        true = sum(any(-before <= t - t0 <= after for t0 in rewards) for t in own)
        hit, right = len(off) / len(rewards), true / len(own)
        out[f] = (len(own), hit, float(np.median(off)) if off else None, float(np.mean(off)) if off else None, 1 - right, 2 * hit * right / (hit + right) if hit + right else 0.0)
    return out


def near(a, b):
    return all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for x, y in zip(a, b))


MEASURES = ("n_peaks", "hit_rate", "median_error", "mean_error", "false_rate", "f1")


def test_feature_audit(spark):
    r = random.Random(2)
    rewards = [r.randint(0, 9000) for _ in range(80)] + [500, 500]
    peaks = [(f"f{i}", r.randint(-100, 9000)) for i in range(6) for _ in range(30 * i + 1)] + [("f1", 77), ("f1", 77), ("far", 99_999)]
    got = audit.feature_audit(spark.createDataFrame(peaks, "feature string, t long"), spark.createDataFrame(list(enumerate(rewards)), "trial long, t0 long"), 20, 60).collect()
    want = audited(peaks, rewards, 20, 60)
    assert {g["feature"] for g in got} == set(want)
    for g in got:
        assert near([g[m] for m in MEASURES], want[g["feature"]]), g


def test_feature_audit_query(spark, sf_dir):
    """The registered query over all channels, against the finder run on whole columns."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    peaks = [(c, int(p)) for c in range(x.shape[1]) for p in kernels.peaks(x[:, c], distance=6, prominence=0.2)]
    want = audited(peaks, [r["vec_id"] for r in rows if r["label"] == 0], audits.BEFORE, audits.AFTER)
    got = audits.feature_audit(spark, sf_dir).collect()
    assert {g["feature"] for g in got} == set(want) and len(want) == x.shape[1]
    for g in got:
        assert near([g[m] for m in MEASURES], want[g["feature"]]), g


def test_window_peaks(spark):
    trace = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate([0, 3, 1, 3, 9, 0])] + [("b", 2, 0.5)], "feature string, t long, y double")
    rewards = spark.createDataFrame([(1, 1), (2, 4), (3, 90)], "trial long, t0 long")
    got = {(g["feature"], g["trial"]): (g["t"], g["y"]) for g in audit.window_peaks(trace, rewards, 1, 2, 1.0).collect()}
    assert got == {("a", 1): (1, 3.0), ("a", 2): (4, 9.0)}


def maxima(v):
    """Middles of plateaus above both sides, the highest first within a twentieth of the window, at least at the median."""
    runs = []
    for i, x in enumerate(v):
        if runs and v[runs[-1][0]] == x:
            runs[-1].append(i)
        else:
            runs.append([i])
    tops = [(r[0] + r[-1]) // 2 for p, r, q in zip(runs, runs[1:], runs[2:]) if v[r[0]] > v[p[0]] and v[r[0]] > v[q[0]]]
    tops, kept = [i for i in tops if v[i] >= np.percentile(v, 50)], []
    for i in sorted(tops, key=lambda i: (v[i], i), reverse=True):
        if all(abs(i - k) >= max(1, len(v) // 20) for k in kept):
            kept.append(i)
    return sorted(kept) or [int(np.argmax(v))]


def test_multi_feature_by_definition(spark):
    r = random.Random(12)
    traces = [(f, t, float(r.randint(-30, 30)) / 10) for f in ("a", "b", "dip") for t in range(0, 3000, r.choice([7, 11]))]
    rewards = [(i, r.randint(-50, 3100)) for i in range(40)] + [(99, 10**6)]
    weights, want, every = {"a": 2.0, "b": 1.0, "dip": 1.0}, {}, set()
    for trial, t0 in rewards:
        scores = {}
        for f in weights:
            own = sorted((t, y) for g, t, y in traces if g == f and t0 - 40 <= t <= t0 + 300)
            if len(own) >= 2:
                v = [(-y if f == "dip" else y) for _, y in own]
                for i in maxima(v):
                    every.add((trial, f, *own[i]))
                    scores[own[i][0]] = scores.get(own[i][0], 0.0) + weights[f] / 4 * max(0.0, own[i][1])
        if len(scores) >= 2:
            ranked = sorted((-round(s, 9), t) for t, s in scores.items())
            span = ranked[-1][0] - ranked[0][0]
            want[trial] = (ranked[0][1], round(-ranked[0][0], 6), round((ranked[1][0] - ranked[0][0]) / span, 6) if span else None, len(scores))
    df = spark.createDataFrame(traces, "feature string, t long, y double"), spark.createDataFrame(rewards, "trial long, t0 long")
    found = detect.window_candidates(*df, 40, 300, ("dip",))
    assert {tuple(x) for x in found.collect()} == every
    got = {g["trial"]: (g["t"], round(g["score"], 6), g["lead"] if g["lead"] is None else round(g["lead"], 6), g["n_candidates"]) for g in detect.multi_feature(found, weights).collect()}
    assert got == want and len(want) > 30


def test_solenoid_peaks_query(spark, sf_dir):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()], dtype=np.float64)
    step = np.abs(np.diff(np.median(x, axis=1), prepend=np.median(x[0])))
    z = (step - step.mean()) / step.std()
    want = kernels.peaks(z, height=2.0, distance=8).tolist()
    assert sorted(r["sample"] for r in audits.solenoid_peaks(spark, sf_dir).collect()) == want and want
    assert audits.multi_feature_peaks(spark, sf_dir).count() > 0
