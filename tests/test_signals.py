"""Array kernels against their definitions, and chunked runs against whole ones."""

import numpy as np
import pytest

from spindrift.functions import kernels as k
from spindrift.operators import signals


def response(sos, f, rate):
    z = np.exp(-2j * np.pi * f / rate)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z) for b0, b1, b2, a0, a1, a2 in sos])


@pytest.mark.parametrize(("order", "low", "high", "rate"), [(4, 1, 100, 2500), (4, 300, 3000, 30000), (2, 4, 8, 1000), (3, 30, 80, 1000), (4, 5, 8, 1000)])
def test_band_pass_design(order, low, high, rate):
    sos = k.butterworth_bandpass(order, low, high, rate)
    assert len(sos) == order
    for edge in (low, high):
        assert abs(response(sos, edge, rate)) == pytest.approx(0.5**0.5, rel=1e-6)
    middle = rate / np.pi * np.arctan(np.sqrt(np.tan(np.pi * low / rate) * np.tan(np.pi * high / rate)))
    assert abs(response(sos, middle, rate)) == pytest.approx(1, rel=1e-6)
    assert abs(response(sos, low / 4, rate)) < 0.3 ** (order - 1)
    for s in sos:
        assert max(abs(np.roots(s[3:]))) < 1
    with pytest.raises(ValueError):
        k.butterworth_bandpass(2, 10, 5, 100)


def test_filter_has_no_phase_and_keeps_the_band():
    t = np.arange(4000) / 1000
    sos = k.butterworth_bandpass(4, 30, 80, 1000)
    y = k.filter_both_ways(sos, np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 5 * t) + 7)
    assert np.allclose(y[500:-500], np.sin(2 * np.pi * 50 * t)[500:-500], atol=0.02)
    assert len(k.filter_both_ways(sos, np.zeros(0))) == 0 and len(k.filter_both_ways(sos, np.ones(3))) == 3


def test_envelope_and_coupling():
    t = np.arange(4000) / 1000
    slow, carrier = np.sin(2 * np.pi * 6 * t), np.sin(2 * np.pi * 60 * t)
    a = np.abs(k.analytic((1 + 0.5 * slow) * carrier))
    assert np.allclose(a[300:-300], (1 + 0.5 * slow)[300:-300], atol=0.05)
    strong = k.coupling(np.angle(k.analytic(slow)), 1 + 0.5 * slow, 500)
    none = k.coupling(np.angle(k.analytic(slow)), np.ones(4000), 500)
    assert strong[1000:-1000].min() > 5 * none[1000:-1000].max()


def test_windows_and_smoothers():
    rng = np.random.default_rng(24)
    x = rng.normal(size=200)
    pad = np.pad(x, 3)
    assert np.allclose(k.median_filter(x, 7), [np.median(pad[i : i + 7]) for i in range(200)])
    sym = np.pad(x, (2, 2), mode="symmetric")
    assert np.allclose(k.moving_mean(x, 5), [sym[i : i + 5].mean() for i in range(200)])
    assert np.allclose(k.gaussian(np.ones(50), 3), 1) and k.gaussian(x, 2).shape == x.shape
    t = np.hanning(16)
    n = k.template_match(np.concatenate([np.zeros(50), t * 3 + 5, np.zeros(50)]), t)
    assert n.max() == pytest.approx(1) and n.argmax() == 50 + 8 and np.abs(n).max() <= 1


def test_peaks():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 5, 4, 5, 0.0])
    assert k.peaks(x).tolist() == [1, 3, 6, 9, 11]
    assert k.peaks(x, height=2).tolist() == [3, 6, 9, 11]
    assert k.peaks(x, distance=3).tolist() == [3, 6, 11]
    assert k.peaks(x, prominence=2).tolist() == [3, 6, 9, 11]
    assert k.prominence_of(x, 9) == 5 and k.prominence_of(x, 1) == 1
    assert k.peaks(np.ones(5)).tolist() == [] and k.peaks(np.zeros(0)).tolist() == []


def test_chunked_equals_whole(spark):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(2, 3000))
    rows = [(c, i, float(x[c, i])) for c in range(2) for i in range(3000)]
    df = spark.createDataFrame(rows, "channel int, sample long, x double")
    sos = k.butterworth_bandpass(4, 50, 200, 1000)
    got = signals.band_pass(df, ("channel",), 50, 200, 1000, 500, 300).orderBy("channel", "sample").collect()
    want = np.concatenate([k.filter_both_ways(sos, v) for v in x])
    assert len(got) == 6000 and np.allclose([r["y"] for r in got], want, atol=1e-6)
    found = signals.find_peaks(df, ("channel",), 500, 100, height=1.0, distance=5).orderBy("channel", "sample").collect()
    whole = [(c, int(p)) for c in range(2) for p in k.peaks(x[c], height=1.0, distance=5)]
    assert len(set(whole) ^ {(r["channel"], r["sample"]) for r in found}) <= 0.01 * len(whole)


def test_components(spark):
    rng = np.random.default_rng(26)
    x = rng.normal(size=(300, 1)) @ rng.normal(size=(1, 6)) + 0.1 * rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "s long, c array<double>")
    got = signals.components(df, "c", 4, 2).collect()
    w = np.linalg.svd(x[:, :4] - x[:, :4].mean(axis=0))[2][0]
    first = [r["weight"] for r in sorted(got, key=lambda r: r["channel"]) if r["block"] == 0 and r["pc"] == 1]
    assert np.allclose(np.abs(first), np.abs(w), atol=1e-6) and max(first, key=abs) > 0
    assert {(r["block"], r["channel"]) for r in got} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5)}
