import random

import numpy as np

from spindrift.operators import droplets


def plateaus(v):
    """Middles of runs below both neighbouring runs."""
    runs = [[0, 0]]
    for i in range(1, len(v)):
        if v[i] == v[i - 1]:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a + z) // 2 for (_, p), (a, z), (q, _) in zip(runs, runs[1:], runs[2:]) if v[a] < v[p] and v[a] < v[q]]


def unit(x):
    x = np.array(x, float)
    p, q = np.percentile(x, 5), np.percentile(x, 95)
    low, high = (p, q) if q > p else (x.min(), x.max())
    return np.clip((x - low) / (high - low), 0, 1) if high > low else np.zeros(len(x))


def test_detect_by_definition(spark):
    r = random.Random(4)
    n, weights = 500, {"pc1": 0.5, "tpl": 0.3, "coord": 0.1, "isolation": 0.1}
    pc1 = [round(r.gauss(0, 1), 1) for _ in range(n)]
    pc1[100:104] = [-3.0] * 4
    score = [[r.choice([None, float("nan"), r.uniform(-1, 1)]) for _ in range(3)] for _ in range(n)]
    score[7] = [None, float("nan"), None]
    place = [[r.choice([None, 1.5]) for _ in range(3)] for _ in range(n)]
    trials = [(i, r.randint(-20, 24 * n)) for i in range(25)] + [(99, 10**6)]
    frames = spark.createDataFrame([(i, 20 * i, pc1[i]) for i in range(n)], "frame long, t long, pc1 double")
    rois = spark.createDataFrame([(i, k, score[i][k], place[i][k], 0.0) for i in range(n) for k in range(3)], "frame long, roi int, score double, x double, y double")
    best = {}
    for i in range(n):
        known = [(s, -k) for k, s in enumerate(score[i]) if s is not None and s == s]
        if known:
            s, k = max(known)
            best[i] = (s, place[i][-k])
    maxima = [i for i in best if i - 1 in best and i + 1 in best and best[i][0] > best[i - 1][0] and best[i][0] >= best[i + 1][0] and best[i][0] > 0]
    candidates = sorted(set(plateaus(pc1)) | set(maxima))
    for dark in (False, True):
        want = {}
        for trial, t0 in trials:
            own = [f for f in candidates if t0 + 40 <= 20 * f <= t0 + 900]
            if not own:
                continue
            away = [min([abs(f - g) for g in own if g != f] or [10**9]) for f in own]
            total = weights["pc1"] * unit([pc1[f] * (-1 if dark else 1) for f in own]) + weights["tpl"] * unit([best.get(f, (0.0,))[0] for f in own])
            total += weights["coord"] * np.array([best.get(f, (0, None))[1] is not None for f in own]) + weights["isolation"] * unit([min(1.0, a / 10) for a in away])
            k = int(np.argmax(np.round(total, 9)))
            if round(total[k], 9) >= 0.3:
                want[trial] = (own[k], 20 * own[k], round(float(total[k]), 6), len(own))
        df = spark.createDataFrame(trials, "trial long, t0 long")
        got = {g["trial"]: (g["frame"], g["t"], round(g["score"], 6), g["n_candidates"]) for g in droplets.detect(frames, rois, df, (40, 900), weights, dark=dark).collect()}
        assert got == want and len(want) > 10
    assert droplets.detect(frames.limit(0), rois.limit(0), df, (40, 900), weights).collect() == []


def test_plateaus_over_buckets(spark):
    v = [3, 1, 1, 1, 2, 2, 0, 0, 5, 5, 4, 4, 4, 4, 6, 1]
    df = spark.createDataFrame(list(enumerate(map(float, v))), "frame long, v double")
    for bucket in (1, 3, 100):
        assert sorted(r["frame"] for r in droplets.dips(df, "v", bucket).collect()) == plateaus(v) == [2, 6, 11]
