import random

import numpy as np
import pytest

from spindrift.jobs import clocks
from spindrift.operators import fit, sync, warp

S = 1_000_000


def test_sync_with_missing_and_strange_pulses(spark):
    """A planted offset and drift are found although a fifth of the pulses is missing and others are strange."""
    r, rewards, pulses, truth = random.Random(3), [], [], {}
    for session, (offset, drift) in enumerate([(812.4, 3e-5), (-1500.0, -2e-5), (0.25, 0.0)]):
        t = 0.0
        for i in range(120):
            t += r.uniform(4, 40)
            rewards.append((session, i, round(t * S)))
            truth[session, i] = round((t * (1 + drift) + offset) * S)
            if r.random() > 0.2:
                pulses.append((session, truth[session, i] + r.randint(-2000, 2000)))
        pulses += [(session, round(r.uniform(offset, t + offset) * S)) for _ in range(25)]
    rewards += [(9, 0, 5 * S), (9, 1, 900 * S)]  # no pulses at all
    a = spark.createDataFrame(rewards, "session long, trial long, t0 long")
    b = spark.createDataFrame(pulses, "session long, t long")
    found, lines = sync.aligned(a, b, ("session",), "trial", "t0", "t", S // 2, 2000 * S, S, 2 * S)
    got = {(x["session"], x["trial"]): x for x in found.collect()}
    assert len(got) == len(rewards)
    assert all(abs(got[k]["predicted"] - t) < 0.1 * S for k, t in truth.items())
    assert all(got[9, i]["predicted"] is None and got[9, i]["matched"] is None for i in (0, 1))
    assert {x["session"] for x in lines.collect()} == {0, 1, 2}
    assert sync.aligned(a.limit(0), b, ("session",), "trial", "t0", "t", S // 2, 2000 * S, S, 2 * S)[0].collect() == []


def test_regular_pulses_stay_bounded(spark):
    """Where all intervals are alike, a reward pairs with the pulses up to the widest offset only."""
    a = spark.createDataFrame([(0, i * 10 * S) for i in range(300)], "session long, t0 long")
    b = spark.createDataFrame([(0, i * 10 * S + 3 * S) for i in range(300)], "session long, t long")
    votes = sync.offset_votes(a, b, ("session",), "t0", "t", S // 2, 50 * S, S)
    assert votes.agg({"votes": "sum"}).first()[0] <= 300 * 11
    assert sync.best_offset(votes, ("session",)).first()["offset"] == 3 * S


def huber_loss(s, o, x, y, delta):
    r = np.abs(y - (s * x + o))
    return np.where(r <= delta, r * r / 2, delta * (r - delta / 2)).sum()


def test_boxed_lines_by_search(spark):
    """No point of a fine grid over the box is better, and a line that the box doesn't hold is the free one."""
    r = np.random.default_rng(1)
    groups = {"inside": (1.003, 4.0), "offset": (1.0, 55.0), "steep": (1.3, 1.0), "both": (0.7, -400.0)}
    rows = []
    for name, (s, o) in groups.items():
        x = r.uniform(0, 300, 80)
        y = s * x + o + r.normal(0, 0.3, 80)
        y[::9] += 40
        rows += [(name, float(a), float(b)) for a, b in zip(x, y)]
    rows += [("lone", 3.0, 9.0), ("flat", 2.0, 3.0), ("flat", 2.0, 5.0), ("odd", float("nan"), 1.0), ("odd", 1.0, None), ("odd", 2.0, 2.5)]
    df = spark.createDataFrame(rows, "unit string, x double, y double")
    got = {(g["unit"], g["box"]): g for g in fit.huber_boxed(df, ("unit",), "x", "y").collect()}
    for name in groups:
        x, y = (np.array([row[i] for row in rows if row[0] == name]) for i in (1, 2))
        for box, s0, s1, o0, o1 in fit.BOXES:
            g = got[name, box]
            assert s0 <= g["slope"] <= s1 and o0 <= g["intercept"] <= o1 and g["n"] == 80
            own = huber_loss(g["slope"], g["intercept"], x, y, 1.0)
            near = [(s, o) for s in np.clip(g["slope"] + np.linspace(-1e-3, 1e-3, 21), s0, s1) for o in np.clip(g["intercept"] + np.linspace(-0.3, 0.3, 21), o0, o1)]
            far = [(s, o) for s in np.linspace(s0, s1, 41) for o in np.linspace(o0, o1, 41)]
            assert own <= min(huber_loss(s, o, x, y, 1.0) for s, o in near + far) + 1e-6
            assert np.isclose(g["rmse"], np.sqrt(np.mean((y - g["slope"] * x - g["intercept"]) ** 2)))
    assert got["inside", "features"]["slope"] == pytest.approx(1.003, abs=1e-3)
    assert got["offset", "features"]["intercept"] == 10.0 and got["both", "video"]["slope"] in (0.95, 1.05)
    assert (got["lone", "sync"]["slope"], got["lone", "sync"]["intercept"], got["lone", "sync"]["rmse"]) == (1.0, 0.0, None)
    assert got["odd", "sync"]["n"] == 1 and got["flat", "sync"]["n"] == 2
    assert fit.huber_boxed(df.limit(0), ("unit",), "x", "y").collect() == []


def smooth(seed):
    """A trace of some waves, at uneven times."""
    r = np.random.default_rng(seed)
    f, p, a = r.uniform(0.002, 0.05, 12), r.uniform(0, 7, 12), r.uniform(0.3, 1, 12)
    return lambda t: (a[:, None] * np.sin(2 * np.pi * f[:, None] * t + p[:, None])).sum(axis=0)


@pytest.mark.parametrize("stretch, offset", [(1.013, 3.7), (0.96, -8.5), (1.0, 0.0), (1.02, 14.0)])
def test_warp_by_similarity(spark, stretch, offset):
    """A planted warp is found; beyond the box the result lies on its border and no point nearby is better."""
    r, g = np.random.default_rng(8), smooth(4)
    t1, t2 = np.sort(r.uniform(-50, 1300, 9000)), np.sort(r.uniform(0, 1100, 9000))
    a = spark.createDataFrame([(float(t), float(v)) for t, v in zip(t1, g(t1))] + [(5.0, None), (6.0, float("nan"))], "t double, v double")
    b = spark.createDataFrame([(float(t), float(v)) for t, v in zip(t2, g(stretch * t2 + offset))], "t double, v double")
    box = warp.Box(0.95, 1.05)
    got = warp.similar(a, b, "t", "v", box, (4.0, 1.0, 0.5), 21, 21)
    if abs(offset) <= 10:
        assert got["stretch"] == pytest.approx(stretch, abs=2e-4) and got["offset"] == pytest.approx(offset, abs=0.1)
    else:
        assert got["offset"] == 10.0

    def cost(s, o):  # on the finest cells
        def mean(t, v):
            c = np.floor(t / 0.5).astype(int)
            return {k: v[c == k].mean() for k in np.unique(c)}

        first, second = memo.setdefault("a", mean(t1, g(t1))), memo.setdefault("b", mean(t2, g(stretch * t2 + offset)))
        total = 0.0
        for k, w in second.items():
            place = (s * (k + 0.5) * 0.5 + o) / 0.5 - 0.5
            i = int(np.floor(place))
            if i in first and i + 1 in first:
                total += (first[i] + (place - i) * (first[i + 1] - first[i]) - w) ** 2
        return total

    memo = {}
    assert got["cost"] == pytest.approx(cost(got["stretch"], got["offset"]), rel=1e-6, abs=1e-9)
    for ds, do in ((1e-3, 0), (-1e-3, 0), (0, 0.2), (0, -0.2)):
        s, o = box.clipped(got["stretch"] + ds, got["offset"] + do)
        assert cost(s, o) >= got["cost"] - 1e-9


def test_warp_of_nothing(spark):
    empty = spark.createDataFrame([], "t double, v double")
    assert warp.similar(empty, empty, "t", "v")["n"] == 0


def test_trace_warp_query(spark):
    """The planted clock of the registered query, on the larger tables."""
    got = clocks.trace_warp(spark, "/root/testdata/sf0.01").first()
    assert got["stretch"] == pytest.approx(clocks.STRETCH, abs=1e-3) and got["offset_s"] == pytest.approx(clocks.OFFSET, abs=3600)
