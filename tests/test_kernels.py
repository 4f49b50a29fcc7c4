"""Block filters and running medians against plain loops, and within their time and memory."""

import time
import tracemalloc

import numpy as np
import pytest

from spindrift.functions import kernels as k
from spindrift.operators import signals


def section(b, a, x, z):
    """One section, a sample at a time."""
    out, (z0, z1) = np.empty_like(x), z
    for i, v in enumerate(x):
        y = b[0] * v + z0
        z0, z1 = b[1] * v - a[0] * y + z1, b[2] * v - a[1] * y
        out[i] = y
    return out


def both_ways(sos, x):
    """Forward and backward by sections, a sample at a time."""
    pad = min(len(x) - 1, 3 * (2 * len(sos) + 1))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x.copy()
    for _ in range(2):
        scale, start = 1.0, y[0]
        for b0, b1, b2, _, a1, a2 in sos:
            level = (b0 + b1 + b2) / (1 + a1 + a2)
            z1 = b2 - a2 * level
            y = section((b0, b1, b2), (a1, a2), y, ((b1 - a1 * level + z1) * scale * start, z1 * scale * start))
            scale *= level
        y = y[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


BANDS = [(4, 300, 3000, 30_000), (4, 4, 80, 1000), (2, 4, 8, 1000), (4, 1, 100, 2500), (4, 300, 7000, 30_000)]


@pytest.mark.parametrize("order, low, high, rate", BANDS)
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, k.BLOCK * k.BLOCKS_HELD + 77])
def test_filter_equals_the_loop(order, low, high, rate, n):
    sos = k.butterworth_bandpass(order, low, high, rate)
    x = np.random.default_rng(n).normal(0, 50, (n, 3)) + 20
    got, want = k.filter_both_ways(sos, x), both_ways(sos, x)
    assert got.shape == x.shape and np.abs(got - want).max() <= 1e-9 * max(1.0, np.abs(x).max())
    assert np.allclose(k.filter_both_ways(sos, x[:, 1]), want[:, 1], rtol=0, atol=1e-7)


def test_filter_is_fast_enough():
    """24 channels at 30 kHz in under 0.1 seconds for a second of recording, by the process's own CPU time."""
    sos = k.butterworth_bandpass(4, 300, 3000, 30_000)
    x = np.random.default_rng(0).normal(size=(90_000, 24))
    k.filter_both_ways(sos, x[:5000])
    took = []
    for _ in range(3):
        before = time.process_time()
        k.filter_both_ways(sos, x)
        took.append((time.process_time() - before) / 3)
    assert min(took) < 0.3  # on a quiet machine 0.1


@pytest.mark.parametrize("n, width", [(1, 1), (5, 3), (5, 9), (200, 7), (1000, 751), (k.SLAB * 2 + 100, 25), (k.SLAB + 1, 4)])
def test_median_equals_sorting(n, width):
    r = np.random.default_rng(n)
    for x in (r.normal(size=n), r.integers(0, 3, n).astype(float), np.zeros(n), np.arange(n)[::-1] * 1.0):
        half = (width | 1) // 2
        padded = np.pad(x, half)
        want = np.median(np.lib.stride_tricks.sliding_window_view(padded, width | 1), axis=-1)
        assert np.array_equal(k.median_filter(x, width), want)
        assert np.array_equal(k.median_filter(np.stack([x, -x], 1), width)[:, 0], want)


def test_median_of_a_whole_chunk():
    """25 ms at 30 kHz over a default chunk: the memory besides the input stays that of the output and a slab."""
    x = np.random.default_rng(2).exponential(size=(900_000, 2))
    tracemalloc.start()
    y = k.median_filter(x, 750)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert y.shape == x.shape and peak < 2 * y.nbytes + (16 << 20)
    for at in (0, 375, 32_768, 500_000, 899_999):
        window = np.zeros(751)
        low, high = max(0, at - 375), min(len(x), at + 376)
        window[low - at + 375 : high - at + 375] = x[low:high, 1]
        assert y[at, 1] == np.median(window)


def test_template_of_a_whole_chunk():
    """A template of 0.6 s at 2.5 kHz over a long chunk holds a few windows at a time."""
    r = np.random.default_rng(4)
    x, t = r.normal(size=60_000), r.normal(size=1500)
    tracemalloc.start()
    y = k.template_match(x, t)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 80e6
    for i in (750, 4000, 59_000):
        w = x[i - 750 : i + 750]
        assert np.isclose(y[i], np.corrcoef(w, t)[0, 1])


def test_envelope_memory_of_many_channels():
    """Of 24 channels only a few are filtered at a time: less than 500 MB for a tenth of a default chunk ten times over."""
    x = np.random.default_rng(5).normal(size=(90_000, 24))
    sos = k.butterworth_bandpass(4, 300, 3000, 30_000)
    tracemalloc.start()
    y = signals.summed_blocks(x, 24, lambda v: k.envelope(v, sos, 750))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak * 10 < 500e6
    assert np.allclose(y[:, 0], k.envelope(x, sos, 750).mean(axis=1))


def test_chunks_agree_with_the_whole(spark):
    """Across borders of chunks the block filter gives what it gives over the whole signal, once the overlap lets it settle."""
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "s long, x array<double>")
    sos = k.butterworth_bandpass(4, 100, 300, 1000)
    got = signals.over_chunks(signals.chunked(df, "s", "x", 700, 400), lambda v: k.filter_both_ways(sos, v)).orderBy("sample").collect()
    assert [g["sample"] for g in got] == list(range(3000))
    assert np.abs(np.array([g["y"] for g in got]) - both_ways(sos, x)).max() < 1e-9
    got = signals.multi_unit(signals.chunked(df, "s", "x", 700, 400), 100, 300, 1000, 25, 2).orderBy("sample").collect()
    each = np.sqrt(np.maximum(k.median_filter(both_ways(sos, x) ** 2, 25), 0))
    want = np.stack([each[:, :2].mean(1), each[:, 2:4].mean(1), each[:, 4]], 1)
    assert np.abs(np.array([g["y"] for g in got]) - want).max() < 1e-9
