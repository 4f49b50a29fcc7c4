"""Registered queries of recordings against NumPy over the whole table, written out anew."""

import numpy as np
import pytest

from spindrift.functions import kernels as k
from spindrift.jobs import recording
from test_kernels import both_ways


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64), [r["vec_id"] for r in rows if r["label"] == 0]


def band(x, low, high, order=4):
    sos = k.butterworth_bandpass(order, low, high, recording.RATE)
    return np.stack([both_ways(sos, v) for v in x.T], axis=1)


def hilbert(x):
    """The analytic signal by keeping positive frequencies."""
    f = np.fft.fft(x, axis=0)
    n = len(x)
    f[1 : (n + 1) // 2] *= 2
    f[n // 2 + 1 :] = 0
    return np.fft.ifft(f, axis=0)


def median(x, width):
    half = width // 2
    p = np.concatenate([np.zeros((half, *x.shape[1:])), x, np.zeros((half, *x.shape[1:]))])
    return np.stack([np.median(p[i : i + width], axis=0) for i in range(len(x))])


def mean(x, width):
    left = width // 2
    p = np.concatenate([x[:left][::-1], x, x[len(x) - (width - 1 - left) :][::-1]])
    return np.stack([p[i : i + width].mean(axis=0) for i in range(len(x))])


def by_channel(df, column="channel"):
    rows = df.collect()
    out = {}
    for r in rows:
        out.setdefault(r[column], {})[r["sample"]] = r["y"]
    return np.array([[out[c][s] for c in sorted(out)] for s in sorted(out[min(out)])])


def z(x, middle=np.mean):
    sd = x.std()
    return (x - middle(x)) / (sd if sd > 0 else 1.0)


def test_filters_and_envelopes(spark, sf_dir, whole):
    x, _ = whole
    slow = band(x, 30, 80)
    assert np.allclose(by_channel(recording.band_pass(spark, sf_dir)), slow, atol=1e-9)
    assert np.allclose(by_channel(recording.hilbert_envelope(spark, sf_dir)), np.abs(hilbert(slow)), atol=1e-9)
    power = np.sqrt(median(band(x, 100, 300) ** 2, 25))
    assert np.allclose(by_channel(recording.mua_envelope(spark, sf_dir)), power, atol=1e-9)
    rows = recording.mua_trace(spark, sf_dir).orderBy("sample").collect()
    y = power.mean(axis=1)[::4]
    assert np.allclose([r["z"] for r in rows], z(y, np.median), atol=1e-7)
    rows = recording.lick_trace(spark, sf_dir).orderBy("sample").collect()
    y = median(np.abs(hilbert(band(x, 5, 8))).mean(axis=1), 201)[::4]
    assert np.allclose([r["z"] for r in rows], z(y), atol=1e-6)
    referenced = x - np.median(x, axis=1, keepdims=True)
    power = np.sqrt(median(band(referenced, 100, 300) ** 2, 25))
    want = np.stack([power[:, a : a + 20].mean(axis=1) for a in range(0, x.shape[1], 20)], axis=1)[::4]
    assert np.allclose(by_channel(recording.car_mua(spark, sf_dir), "block"), want, atol=1e-9)


def test_couplings_and_templates(spark, sf_dir, whole):
    x, rewards = whole
    c = np.abs(hilbert(band(x, 30, 80))) * np.exp(1j * np.angle(hilbert(band(x, 4, 8, 2))))
    want = np.abs(mean(c.real, 125) + 1j * mean(c.imag, 125))
    assert np.allclose(by_channel(recording.phase_amplitude_coupling(spark, sf_dir)), want, atol=1e-8)
    blocks = np.stack([want[:, a : a + 20].mean(axis=1) for a in range(0, x.shape[1], 20)], axis=1)[::100]
    assert np.allclose(by_channel(recording.pac_blocks(spark, sf_dir), "block"), blocks, atol=1e-8)
    common = x.mean(axis=1)
    inside = [common[s - 8 : s + 24] if s >= 8 else None for s in rewards]
    at = [[common[s + d] for s in rewards if 0 <= s + d < len(x)] for d in range(-8, 24)]
    t = np.array([np.mean(v) for v in at])
    assert len(inside) == len(rewards)
    t = t - t.mean()
    p = np.concatenate([np.zeros((16, x.shape[1])), x, np.zeros((15, x.shape[1]))])
    want = np.zeros(x.shape)
    for i in range(len(x)):
        w = p[i : i + 32] - p[i : i + 32].mean(axis=0)
        want[i] = np.clip((t @ w) / (np.sqrt((w * w).sum(axis=0)) * np.sqrt((t * t).sum())), -1, 1)
    assert np.allclose(by_channel(recording.ncc_template(spark, sf_dir)), want, atol=1e-8)


def leading(y, n, standardised):
    """Projections on the leading components, by singular values, up to their sign."""
    c = y - y.mean(axis=0)
    if standardised:
        c = c / c.std(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2]
    return c @ v[:n].T


def parts(df, value):
    out = {}
    for r in df.collect():
        out.setdefault((r["part"], r["pc"] if "pc" in r else 1), {})[r["sample"]] = r[value]
    return {key: np.array([v[s] for s in sorted(v)]) for key, v in out.items()}


def alike(got, want):
    """Equal up to the sign, where it isn't fixed."""
    return min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-5


def test_deflections(spark, sf_dir, whole):
    x, _ = whole
    y = band(x, 1, 100)
    got = parts(recording.lfp_deflections(spark, sf_dir), "z")
    groups = {"global": range(64), **{f"block_{a // 20}": range(a, min(a + 20, 64)) for a in range(0, 64, 20)}}
    assert {name for name, _ in got} == set(groups)
    for name, c in groups.items():
        own = y[:, list(c)]
        pc = leading(own, 1, True)[:, 0]
        pc = pc * np.sign(np.corrcoef(pc, np.median(own, axis=1))[0, 1])
        assert np.abs(got[name, 1] - z(median(pc, 51), np.median)).max() < 1e-5, name


def test_envelope_components(spark, sf_dir, whole):
    x, _ = whole
    for query, own in ((recording.ap_band_pcs, x), (recording.car_mua_pcs, x - np.median(x, axis=1, keepdims=True))):
        y = np.sqrt(np.maximum(mean(band(own, 100, 300) ** 2, 25), 0))[::2]
        got = parts(query(spark, sf_dir), "z")
        assert len(got) == 4 * 3
        for b in range(4):
            want = leading(y[:, 20 * b : 20 * b + 20], 3, False)
            assert all(alike(got[f"block_{b}", i + 1], z(want[:, i])) for i in range(3)), (query, b)


def test_modulated_components(spark, sf_dir, whole):
    x, rewards = whole
    power = (band(x, 30, 80) ** 2)[::2]
    at = [s // 2 for s in rewards if s // 2 - 4 >= 0 and s // 2 + 8 < len(power)]
    before = np.median([power[s - 4 : s].mean(axis=0) for s in at], axis=0)
    after = np.median([power[s : s + 8].mean(axis=0) for s in at], axis=0)
    rmi = np.log1p(after) - np.log1p(before + 1e-9)
    got = recording.reward_modulation_pcs(spark, sf_dir)
    named = {r["part"]: r["channels"] for r in got.select("part", "channels").distinct().collect()}
    found = parts(got, "z")
    for b in range(4):
        own = range(20 * b, min(20 * b + 20, 64))
        chosen = sorted(sorted(own, key=lambda c: (-rmi[c], c))[:5])
        n = min(5, len(own))
        assert named[f"block_{b}"] == ",".join(map(str, chosen)) and len(chosen) == n
        want = leading(power[:, chosen], 3, True)
        assert all(alike(found[f"block_{b}", i + 1], z(want[:, i])) for i in range(min(3, n))), b


def test_templates_by_code(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in recording.ncc_by_code(spark, sf_dir).where("channel % 21 = 0").collect():
        got.setdefault((r["code"], r["channel"]), {})[r["sample"]] = (r["y"], r["z"])
    codes = set()
    for code in range(3):
        at = [r["vec_id"] for r in rows if r["label"] == code and r["vec_id"] >= 4 and r["vec_id"] + 12 <= len(x)]
        if len(at) < 5:
            continue
        codes.add(str(code))
        for c in (0, 21, 42, 63):
            t = np.mean([x[s - 4 : s + 12, c] for s in at], axis=0)
            t = t - t.mean()
            p = np.concatenate([np.zeros(8), x[:, c], np.zeros(7)])
            w = np.stack([p[i : i + 16] - p[i : i + 16].mean() for i in range(len(x))])
            want = np.clip((w @ t) / (np.sqrt((w * w).sum(1)) * np.sqrt((t * t).sum())), -1, 1)
            own = got[str(code), c]
            assert np.allclose([own[i][0] for i in range(len(x))], want, atol=1e-9) and np.allclose([own[i][1] for i in range(len(x))], z(want), atol=1e-7)
    assert codes and {k for k, _ in got} == codes
