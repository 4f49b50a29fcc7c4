"""Array kernels on one channel or block at a time (NumPy): filters, envelopes, components, peaks."""

from __future__ import annotations

import numpy as np


def butterworth_bandpass(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth band-pass by the bilinear transform."""
    if not 0 < low < high < rate / 2:
        raise ValueError("need 0 < low < high < rate / 2")
    fs2 = 2 * rate
    w1, w2 = (fs2 * np.tan(np.pi * f / rate) for f in (low, high))
    width, middle = w2 - w1, np.sqrt(w1 * w2)
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(proto**2 - middle**2 + 0j)
    poles = np.concatenate([proto + root, proto - root])
    z = (fs2 + poles) / (fs2 - poles)
    gain = (width**order * fs2**order / np.prod(fs2 - poles)).real
    upper = sorted(z[z.imag > 1e-12], key=abs)
    real = sorted(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(p, np.conj(p)) for p in upper] + list(zip(real[::2], real[1::2], strict=False))
    sos = np.array([[1.0, 0.0, -1.0, 1.0, -(p + q).real, (p * q).real] for p, q in pairs])
    sos[0, :3] *= gain
    return sos


#: Samples that one matrix product filters, and blocks that are held at a time besides input and output.
BLOCK, BLOCKS_HELD = 64, 256


def block_form(sos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A cascade of sections over ``length`` samples at once: responses to the samples and to the state, the state's drive and its carry.

    With a block's samples x and the state z before it, the output is
    ``response @ x + seen @ z`` and the state after it ``carry @ z + drive @ x``.
    """
    n = 2 * len(sos)
    unit = np.eye(n + 1)
    step, v = np.zeros((n, n + 1)), unit[n]  # what each new state is made of; what the section's input is made of
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y = b0 * v + unit[2 * s]
        step[2 * s], step[2 * s + 1] = b1 * v - a1 * y + unit[2 * s + 1], b2 * v - a2 * y
        v = y
    carry, enters = step[:, :n], step[:, n]
    seen, drive = np.empty((length, n)), np.empty((n, length))
    row, column = v[:n], enters
    for i in range(length):
        seen[i], drive[:, length - 1 - i] = row, column
        row, column = row @ carry, carry @ column
    impulse = np.concatenate([[v[n]], seen[:-1] @ enters])
    lag = np.subtract.outer(np.arange(length), np.arange(length))
    return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), seen, drive, np.linalg.matrix_power(carry, length)


def _filtered(form: tuple, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The cascade along the first axis of a matrix, from a state (a column for each of x): matrix products for blocks, a step for each block's state."""
    response, seen, drive, carry = form
    length, out = len(response), np.empty_like(x)
    for at in range(0, len(x), length * BLOCKS_HELD):
        part = x[at : at + length * BLOCKS_HELD]
        short = -len(part) % length
        blocks = (np.concatenate([part, np.zeros((short, x.shape[1]))]) if short else part).reshape(-1, length, x.shape[1])
        driven, states = drive @ blocks, np.empty((len(blocks), *state.shape))
        for k in range(len(blocks)):
            states[k] = state
            state = carry @ state + driven[k]
        out[at : at + len(part)] = (response @ blocks + seen @ states).reshape(-1, x.shape[1])[: len(part)]
    return out


def _settled(sos: np.ndarray) -> np.ndarray:
    """The states of all sections that a constant input of 1 settles in."""
    states, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        level = (b0 + b1 + b2) / (1 + a1 + a2)
        z1 = b2 - a2 * level
        states += [(b1 - a1 * level + z1) * scale, z1 * scale]
        scale *= level
    return np.array(states)


def filter_both_ways(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward along the first axis, with odd extension at the ends and each section started in its steady state.

    The columns of a matrix are filtered side by side.
    """
    x = np.asarray(x, dtype=np.float64)
    if len(x) == 0:
        return x
    pad = min(len(x) - 1, 3 * (2 * len(sos) + 1))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    y = y.reshape(len(y), -1)
    form, settled = block_form(sos, BLOCK), _settled(sos)
    for _ in range(2):
        y = _filtered(form, y, np.outer(settled, y[0]))[::-1]
    return y[pad : len(y) - pad].reshape(x.shape)


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as imaginary part."""
    n = len(x)
    h = np.zeros(n)
    if n:
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=0) * (h if x.ndim == 1 else h[:, None]), axis=0) if n else x.astype(complex)


#: Samples whose running medians are found at a time.
SLAB = 1 << 15


def _window_medians(x: np.ndarray, width: int) -> np.ndarray:
    """Medians of all windows of odd width within x.

    Ranks are parted by their bits, highest first, each time zeros before
    ones in order. A window is a range all along, and the count of zeros in
    it tells on which side its middle rank goes on: a step a bit for all
    windows at once, whatever their width.
    """
    n = len(x)
    order = np.argsort(x, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    low = np.arange(n - width + 1, dtype=np.int32)
    high, k, middle = low + width, np.full(len(low), width // 2, np.int32), np.zeros(len(low), np.int32)
    zeros = np.zeros(n + 1, np.int32)
    for b in reversed(range(max(1, (n - 1).bit_length()))):
        one = (rank >> b & 1).astype(bool)
        np.cumsum(~one, out=zeros[1:])
        before, upto = zeros[low], zeros[high]
        inside = upto - before
        up = k >= inside
        low, high = np.where(up, zeros[n] + low - before, before), np.where(up, zeros[n] + high - upto, upto)
        k -= inside * up
        middle |= up.astype(np.int32) << b
        rank = np.concatenate([rank[~one], rank[one]])
    return x[order[middle]]


def median_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Running median of odd width, zeros beyond the ends; besides its result it holds a slab and a window of one column."""
    width |= 1
    half, x = width // 2, np.asarray(x, dtype=np.float64)
    flat = x.reshape(len(x), -1)
    out = np.empty_like(flat)
    for c in range(flat.shape[1]):
        for a in range(0, len(x), SLAB):
            b = min(a + SLAB, len(x))
            inner = flat[max(0, a - half) : b + half, c]
            out[a:b, c] = _window_medians(np.pad(inner, (max(0, half - a), max(0, b + half - len(x)))), width)
    return out.reshape(x.shape)


def moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Running mean, the signal mirrored at its ends."""
    left, x = width // 2, np.asarray(x, dtype=np.float64)
    padded = np.pad(x, ((left, width - 1 - left), *[(0, 0)] * (x.ndim - 1)), mode="symmetric")
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(padded, axis=0)])
    return (sums[width:] - sums[:-width]) / width


def gaussian(x: np.ndarray, sigma: float, cut: float = 4.0) -> np.ndarray:
    """Gaussian smoothing with the kernel cut at ``cut`` deviations, the signal mirrored at its ends."""
    r = int(cut * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(np.asarray(x, dtype=np.float64), r, mode="symmetric"), k / k.sum(), mode="valid")


def exponential(x: np.ndarray, tau: float, length: int) -> np.ndarray:
    """Causal exponential kernel, centred as a same-size convolution."""
    k = np.exp(-np.arange(length) / tau)
    return np.convolve(x, k, mode="same")


def envelope(x: np.ndarray, sos: np.ndarray, width: int) -> np.ndarray:
    """Band-passed power, its running median, rooted."""
    return np.sqrt(np.maximum(median_filter(filter_both_ways(sos, x) ** 2, width), 0))


def coupling(phase: np.ndarray, amplitude: np.ndarray, width: int) -> np.ndarray:
    """How strongly an amplitude follows a phase: magnitude of the averaged product."""
    z = amplitude * np.exp(1j * phase)
    return np.abs(moving_mean(z.real, width) + 1j * moving_mean(z.imag, width))


#: Numbers in the windows that are compared with a template at a time.
WINDOWED = 1 << 21


def template_match(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Sliding normalised cross-correlation, same size, clipped to -1..1, 0 where the signal is flat."""
    n = len(template)
    t = template - template.mean()
    norm = np.sqrt((t * t).sum())
    left = n // 2
    w = np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, dtype=np.float64), (left, n - 1 - left)), n)
    out, step = np.empty(len(w)), max(1, WINDOWED // n)
    for a in range(0, len(w), step):
        centred = w[a : a + step] - w[a : a + step].mean(axis=1, keepdims=True)
        energy = np.sqrt((centred * centred).sum(axis=1)) * norm
        out[a : a + step] = np.divide(centred @ t, energy, out=np.zeros(len(centred)), where=energy > 1e-12)
    return np.clip(out, -1, 1)


def principal(covariance: np.ndarray, n: int) -> np.ndarray:
    """The n leading components as rows; each one's largest weight is positive."""
    _, vectors = np.linalg.eigh(covariance)
    out = vectors[:, ::-1][:, :n].T
    return out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])[:, None]


def peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Indices of local maxima (a plateau's middle), thinned to the distance from the highest down, then by prominence."""
    x = np.asarray(x, dtype=np.float64)
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    found = (starts[top] + ends[top]) // 2
    if height is not None:
        found = found[x[found] >= height]
    if distance > 1 and len(found):
        keep = np.ones(len(found), dtype=bool)
        for i in np.argsort(x[found], kind="stable")[::-1].tolist():
            if keep[i]:
                near = slice(*np.searchsorted(found, [found[i] - distance + 1, found[i] + distance]))
                keep[near] = False
                keep[i] = True
        found = found[keep]
    if prominence is not None and len(found):
        found = found[prominences(x, found) >= prominence]
    return found


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far each peak rises over the higher of the lowest points towards higher ground on either side.

    One pass to each side: a stack holds falling values with the lowest point since each.
    """

    def lowest(values: list, wanted: set) -> dict:
        stack: list[list] = []  # value, lowest point since the value before it on the stack
        out = {}
        for i, v in enumerate(values):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            stack.append([v, low])
            if i in wanted:
                out[i] = low
        return out

    n = len(x)
    left = lowest(x.tolist(), set(at.tolist()))
    right = lowest(x[::-1].tolist(), {n - 1 - i for i in at.tolist()})
    return np.array([x[i] - max(left[i], right[n - 1 - i]) for i in at.tolist()])


def prominence_of(x: np.ndarray, p: int) -> float:
    return float(prominences(np.asarray(x, dtype=np.float64), np.array([p]))[0])


def peaks_or_highest(x: np.ndarray, percentile: float, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Peaks at or over a percentile of the values; where there are none, the place of the largest value."""
    x = np.asarray(x, dtype=np.float64)
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    found = peaks(x, height=float(np.percentile(x, percentile)), distance=distance, prominence=prominence)
    return found if len(found) else np.array([int(x.argmax())])


def crossings_density(x: np.ndarray, noise: np.ndarray, bin_samples: int, sigma_bins: float, deviations: float) -> np.ndarray:
    """Samples a bin beyond so many deviations of the noise, smoothed; a row for each bin."""
    over = (np.abs(x) > deviations * np.maximum(1e-3, noise)).astype(np.float64)
    if not len(over):
        return over
    sums = np.add.reduceat(over, np.arange(0, len(over), bin_samples), axis=0)
    return np.apply_along_axis(gaussian, 0, sums, sigma_bins)


def first_of(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each stretch [low, high) of rows (none empty), the row of least rank; ranks are 0..n-1, each once.

    Two overlapping powers of two cover a stretch; a power's minima are all that is held.
    """
    place = np.empty(len(rank), dtype=np.int64)
    place[rank] = np.arange(len(rank))
    length, best, out = high - low, rank, np.empty(len(low), dtype=np.int64)
    span = 1
    while len(best):
        now = np.flatnonzero((length >= span) & (length < 2 * span))
        out[now] = np.minimum(best[low[now]], best[high[now] - span])
        if not (length >= 2 * span).any():
            break
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    return place[out]
