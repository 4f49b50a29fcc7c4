"""Chunked features against whole ones in NumPy, filters and sources on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import kernels as k
from spindrift.operators import detect, filters, ranges, signals
from spindrift.sources import logs, recording


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(31)
    return np.cumsum(rng.normal(size=(3000, 6)), axis=0) * 0.1 + rng.normal(size=(3000, 6))


@pytest.fixture(scope="module")
def table(spark, wide):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "s long, c array<double>")


def matrix(df):
    return np.array([r["y"] for r in df.orderBy("sample").collect()])


def test_columns_are_filtered_side_by_side(wide):
    sos = k.butterworth_bandpass(4, 50, 200, 1000)
    assert np.allclose(k.filter_both_ways(sos, wide), np.stack([k.filter_both_ways(sos, v) for v in wide.T], axis=1))
    assert np.allclose(k.analytic(wide), np.stack([k.analytic(v) for v in wide.T], axis=1))
    for f in (lambda x: k.median_filter(x, 7), lambda x: k.moving_mean(x, 6)):
        assert np.allclose(f(wide), np.stack([f(v) for v in wide.T], axis=1))


def test_chunks_equal_the_whole(table, wide):
    chunks = signals.chunked(table, "s", "c", 500, 300).cache()
    sos = k.butterworth_bandpass(4, 50, 200, 1000)
    assert np.allclose(matrix(signals.over_chunks(chunks, lambda x: k.filter_both_ways(sos, x))), k.filter_both_ways(sos, wide), atol=1e-6)
    y = matrix(signals.multi_unit(chunks, 50, 200, 1000, 25, 3, step=4, referenced=True))
    want = k.envelope(wide - np.median(wide, axis=1, keepdims=True), sos, 25)
    assert np.allclose(y, np.stack([want[:, :3].mean(axis=1), want[:, 3:].mean(axis=1)], axis=1)[::4], atol=1e-5)
    noise = signals.noise_levels(chunks, 50, 200, 1000)
    first = k.filter_both_ways(sos, wide[:800] - np.median(wide[:800], axis=1, keepdims=True))
    assert np.allclose(noise, np.median(np.abs(first), axis=0) / 0.6745)
    d = matrix(signals.session_density(chunks, 50, 200, 1000, 10, 2.0, noise, 2.0))
    whole = k.crossings_density(k.filter_both_ways(sos, wide - np.median(wide, axis=1, keepdims=True)), np.array(noise), 10, 2.0, 2.0)
    assert d.shape == whole.shape and np.allclose(d, whole, atol=1e-6)
    assert signals.over_chunks(chunks.where("false"), lambda x: x).count() == 0


def test_components_are_projected(spark, table, wide):
    y = signals.over_chunks(signals.chunked(table, "s", "c", 1000, 0), lambda x: x)
    parts = signals.block_components(y, 4, 2)
    got = signals.session_z(signals.projected(y, parts, 4), ("block", "pc"))
    for block, own in ((0, wide[:, :4]), (1, wide[:, 4:])):
        centred = own - own.mean(axis=0)
        w = np.linalg.svd(centred, full_matrices=False)[2]
        for pc in (1, 2):
            rows = got.where(f"block = {block} and pc = {pc}").orderBy("sample").collect()
            want = centred @ (w[pc - 1] * np.sign(w[pc - 1][np.abs(w[pc - 1]).argmax()]))
            assert np.allclose([r["y"] for r in rows], want, atol=1e-8) and np.allclose([r["z"] for r in rows], want / want.std(), atol=1e-8)


def test_recording_to_features_needs_no_shuffle(spark, tmp_path):
    rng = np.random.default_rng(32)
    x = rng.integers(-500, 500, size=(2500, 8)).astype("<i2")
    path = f"{tmp_path}/r.bin"
    x.tofile(path)
    chunks = recording.read_recording(spark, path, 8, chunkSamples=700, overlap=300)
    sos = k.butterworth_bandpass(4, 50, 200, 1000)
    y = signals.over_chunks(chunks, lambda v: k.filter_both_ways(sos, v))
    assert "Exchange" not in y._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(matrix(y), k.filter_both_ways(sos, x.astype(float)), atol=1e-3)


def test_peaks_by_stack_equal_their_definition():
    rng = np.random.default_rng(33)
    for n in (5, 60, 400):
        x = np.round(rng.normal(size=n), 1)
        for p in k.peaks(x).tolist():
            higher = np.flatnonzero(x[:p] > x[p])
            left = x[higher[-1] + 1 if len(higher) else 0 : p + 1].min()
            higher = np.flatnonzero(x[p + 1 :] > x[p])
            right = x[p : p + 1 + higher[0] if len(higher) else n].min()
            assert k.prominence_of(x, p) == pytest.approx(x[p] - max(left, right))
    assert k.peaks_or_highest(np.array([1.0, 2.0, 3.0]), 50).tolist() == [2] and k.peaks_or_highest(np.zeros(0), 50).tolist() == []


def test_modulation(spark, table, wide):
    trials = spark.createDataFrame([(100,), (900,), (2000,)], "s0 long")
    got = {r["channel"]: r["rmi"] for r in signals.modulation(table, "s", "c", trials, 50, 40).collect()}
    p = wide**2
    pre = np.median([p[s - 50 : s].mean(axis=0) for s in (100, 900, 2000)], axis=0)
    post = np.median([p[s : s + 40].mean(axis=0) for s in (100, 900, 2000)], axis=0)
    assert np.allclose([got[c] for c in range(6)], np.log1p(post) - np.log1p(pre + 1e-9))
    t = signals.event_template(table, "s", "c", trials, 5, 7)
    assert np.allclose(t, np.mean([wide[s - 5 : s + 7].mean(axis=1) for s in (100, 900, 2000)], axis=0))


def test_following_and_numbered(spark):
    points = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("a", 3, 11), ("a", 4, 99), ("b", 5, 0)], "k string, p long, t0 long")
    trace = spark.createDataFrame([("a", 10, 7), ("a", 10, 6), ("a", 55, 8), ("c", 1, 9)], "k string, t long, v long")
    got = ranges.following(points, trace, ("k",), "t0", "t", "v", 20).orderBy("p").collect()
    assert [(r["p"], r["t"], r["v"]) for r in got] == [(1, 10, 6), (2, 10, 6), (3, 55, 8)]
    n = ranges.numbered(trace, ("k",), ("t", "v"), F.floor(F.col("t") / 20)).orderBy("v").collect()
    assert [(r["v"], r["idx"]) for r in n] == [(6, 1), (7, 2), (8, 3), (9, 1)]
    marks = spark.createDataFrame([("a", 1, 0), ("a", 2, 30)], "k string, trial long, from long")
    steps = spark.createDataFrame([("a", 0, -9.0), ("a", 29, -9.0), ("a", 30, -7.0), ("a", 90, -8.0), ("a", 91, 1.0), ("b", 1, -9.0)], "k string, t long, step double")
    falls = detect.steepest_fall(marks, steps, ("k",), -5, 20).orderBy("trial").collect()
    assert [(r["trial"], r["t"], r["fall"]) for r in falls] == [(1, 0, -9.0), (2, 90, -8.0)]


def test_filters(spark):
    df = spark.createDataFrame([("s", 300, 1, 1.0), ("s", 3, 2, float("nan")), ("u", 300, 3, None), ("v", 5, 4, float("inf"))], "s string, code int, t long, v double")
    assert {r["t"] for r in filters.first_code_present(df, ("s",), "code", (3, 300)).collect()} == {2, 3}
    assert [r["t"] for r in df.where(filters.finite("v")).collect()] == [1]
    assert {r["t"] for r in filters.after_start(df, ("s",), "t", F.col("code") == 300).collect()} == {2}
    names = spark.createDataFrame([("car_x",), ("rmi_y",), ("mua",)], "f string")
    assert {r["f"] for r in filters.named(names, "f", ("car_", "rmi_"), ("rmi_y",)).collect()} == {"car_x"}


def test_sources(spark, tmp_path):
    root = f"{tmp_path}/r"
    for path, text in {"g/one/log.csv": "1,2", "g/one/cam.csv": "x", "g/two/log.csv": "1,2"}.items():
        (tmp_path / "r" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / path).write_text(text)
    found = logs.sessions(spark, root, {"log": "^log.*csv$", "camera": "^cam.*csv$"}).collect()
    assert [(r["group"], r["setup"]) for r in found] == [("g", "one")] and found[0]["log"].endswith("log.csv")
    (tmp_path / "a.lf.meta").write_text("imSampRate=2499.9\nnSavedChans=385\n")
    np.zeros(385 * 4, dtype="<i2").tofile(f"{tmp_path}/a.lf.bin")
    np.zeros(5, dtype="<i2").tofile(f"{tmp_path}/b.ap.bin")
    sizes = logs.recording_sizes(spark, f"{tmp_path}/*.bin", 385)
    both = logs.optional_meta(spark, sizes, logs.meta(spark, f"{tmp_path}/*.meta"))
    got = {r["recording"].rsplit("/")[-1]: (r["n_samples"], r["m"], r["n"]) for r in both.select("*", logs.sampling_rate("recording", "fields").alias("m"), logs.sampling_rate("recording", "fields", "name_first").alias("n")).collect()}
    assert got == {"a.lf.bin": (4, 2499.9, 2500.0), "b.ap.bin": (0, 30000.0, 30000.0)}
    (tmp_path / "cluster_Extragood.tsv").write_text("cluster_id\tExtragood\n1\ty\n2\tn\n3\t Y \n")
    good = logs.extragood_units(spark, f"{tmp_path}/cluster_Extragood.tsv")
    assert sorted(r["unit"] for r in good.collect()) == [1, 3] and logs.extragood_units(spark, f"{tmp_path}/none.tsv").count() == 0
    units = spark.createDataFrame([(1,), (2,)], "unit int")
    assert {r["unit"]: r["extragood"] for r in logs.flagged(units, good).collect()} == {1: True, 2: False}
    np.save(f"{tmp_path}/t.npy", np.array([30, 60, 90]))
    np.save(f"{tmp_path}/c.npy", np.array([5, 6, 5]))
    times, clusters = recording.read_npy_longs(spark, f"{tmp_path}/t.npy", "time"), recording.read_npy_longs(spark, f"{tmp_path}/c.npy", "cluster")
    assert sorted((r["unit"], r["t"]) for r in logs.spike_times(times, clusters, 30.0).collect()) == [(5, 1.0), (5, 3.0), (6, 2.0)]
    with pytest.raises(ValueError):
        logs.spike_times(times.limit(2), clusters, 30.0)
    keys = spark.createDataFrame([("trace_mua",), ("time_mua",), ("old_one",)], "key string")
    assert {(r["kind"], r["feature"]) for r in logs.feature_names(keys, "key").collect()} == {("trace", "mua"), ("time", "mua"), ("trace", "old_one")}
    logs.write_csv(units, f"{tmp_path}/units")
    assert spark.read.csv(f"{tmp_path}/units", header=True).count() == 2
    for value in (1, 2):
        logs.write_diagnostics(spark.createDataFrame([(f"s{value}", value), ("s1", value)], "session string, v int"), f"{tmp_path}/d")
    assert sorted((r["session"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/d").collect()) == [("s1", 2), ("s2", 2)]
