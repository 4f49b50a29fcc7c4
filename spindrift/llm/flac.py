"""FLAC for 8-bit mono samples: frames with fixed or learned linear predictors and Rice residuals.

The stream format is the public one: the marker, a STREAMINFO block, a SEEKTABLE
block with one point for each frame, then frames with a CRC-8 of their header
and a CRC-16 of the whole. Payload bytes are unsigned, samples signed: a byte
is its sample plus 128.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np

BLOCK = 4096
RATE = 8000
_CRC8, _CRC16 = 0x07, 0x8005


@lru_cache
def _crc_table(poly: int, width: int) -> np.ndarray:
    """The checksum of each byte value alone."""
    t = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        t = ((t << 1) ^ np.where(t >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return t


class _Weights:
    """Checksums are linear: a byte's share depends on its value and on how many bytes follow it."""

    def __init__(self):
        self.rows = _crc_table(_CRC16, 16).astype(np.uint16)[None, :]

    def upto(self, n: int) -> np.ndarray:
        if len(self.rows) < n:
            table, rows, last = _crc_table(_CRC16, 16).astype(np.uint16), [], self.rows[-1]
            for _ in range(max(n, 2 * len(self.rows)) - len(self.rows)):
                last = (last << np.uint16(8)) ^ table[last >> np.uint16(8)]
                rows.append(last)
            self.rows = np.concatenate([self.rows, np.array(rows, dtype=np.uint16)])
        return self.rows


_weights = _Weights()


def crc16(data: bytes) -> int:
    x = np.frombuffer(data, dtype=np.uint8)
    if not len(x):
        return 0
    rows = _weights.upto(len(x))
    return int(np.bitwise_xor.reduce(rows[np.arange(len(x) - 1, -1, -1), x]))


def crc8(data: bytes) -> int:
    table, c = _crc_table(_CRC8, 8), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def _utf8_number(n: int) -> bytes:
    """A frame number, coded like a character of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    length = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(length - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - length) & 0xFF) | n, *reversed(tail)])


def _rice_bits(u: np.ndarray, k: int) -> int:
    return int((u >> k).sum()) + len(u) * (k + 1)


def _best_rice(u: np.ndarray) -> tuple[int, int]:
    """(bits, parameter): the mean's power of two or a neighbour."""
    mean = float(u.mean()) if len(u) else 0.0
    guess = max(0, int(np.log2(mean + 1e-9)) if mean > 0 else 0)
    return min((_rice_bits(u, k), k) for k in range(max(0, guess - 1), min(14, guess + 1) + 1))


def zigzag(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def learned_predictor(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised coefficients and their shift, from the autocorrelation (Levinson-Durbin)."""
    f = x.astype(np.float64) * np.hanning(len(x) + 2)[1:-1]
    r = np.array([f[: len(f) - i] @ f[i:] for i in range(order + 1)])
    if r[0] <= 0:
        return None
    a, error = np.zeros(order), r[0]
    for i in range(order):
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / error
        a[: i + 1] = np.append(a[:i] - k * a[:i][::-1], k)
        error *= 1 - k * k
        if error <= 0:
            return None
    top = np.abs(a).max()
    if top <= 0:
        return None
    shift = int(np.clip(precision - 2 - np.floor(np.log2(top)), 0, 15))
    q = np.round(a * (1 << shift)).astype(np.int64)
    return (q, shift) if np.abs(q).max() < 1 << (precision - 1) else None


def _lpc_residual(x: np.ndarray, q: np.ndarray, shift: int) -> np.ndarray:
    n, order = len(x), len(q)
    guess = sum(int(c) * x[order - 1 - i : n - 1 - i] for i, c in enumerate(q))
    return x[order:] - (guess >> shift)


def _fields(*pairs: tuple[int, int]) -> np.ndarray:
    """Bits of (value, width) fields, high bit first; negative values in two's complement."""
    return np.array([v >> i & 1 for v, w in pairs for i in range(w - 1, -1, -1)], dtype=np.uint8)


def _rice_code(u: np.ndarray, k: int, head: np.ndarray) -> bytes:
    """The head's bits, then each number's quotient in unary and its k low bits; whole bytes.

    Codes don't share bits, so what falls into the same byte may be added up.
    """
    ends = np.cumsum((u >> k) + (k + 1)) + len(head)
    stop = ends - (k + 1)
    out = np.zeros((int(ends[-1]) >> 3) + 4)
    first = np.packbits(head)
    out[: len(first)] = first
    window = ((u & ((1 << k) - 1)) | (1 << k)) << (24 - (k + 1) - (stop & 7))
    byte = stop >> 3
    for i in range(3):
        out += np.bincount(byte + i, weights=window >> (16 - 8 * i) & 255, minlength=len(out))
    return out[: -(-int(ends[-1]) // 8)].astype(np.uint8).tobytes()


def _subframe(x: np.ndarray, lpc_order: int) -> bytes:
    """The cheapest of: constant, a fixed predictor (that of the least absolute residual), a learned one, verbatim."""
    n = len(x)
    if (x == x[0]).all():
        return bytes([0, int(x[0]) & 255])
    residual, best, fixed = x, (int(np.abs(x).sum()), 0), x
    for order in range(1, min(4, n - 1) + 1):
        residual = np.diff(residual)
        if (total := int(np.abs(residual).sum())) < best[0]:
            best, fixed = (total, order), residual
    order, found, u = best[1], None, zigzag(fixed)
    bits, k = _best_rice(u)
    bits += 18 + 8 * order
    if lpc_order and n > 2 * lpc_order and (model := learned_predictor(x, lpc_order)):
        other = zigzag(_lpc_residual(x, *model))
        more, other_k = _best_rice(other)
        more += 27 + 20 * lpc_order
        if more < bits:
            bits, order, k, u, found = more, lpc_order, other_k, other, model
    if bits >= 8 + 8 * n:
        return b"\x02" + x.astype(np.int8).tobytes()
    warm = np.unpackbits(x[:order].astype(np.int8).view(np.uint8))
    if found:
        head = _fields((0b01000000 | (order - 1) << 1, 8))
        model = _fields((11, 4), (found[1], 5), *((int(c), 12) for c in found[0]))
    else:
        head, model = _fields((0b00010000 | order << 1, 8)), _fields()
    return _rice_code(u, k, np.concatenate([head, warm, model, _fields((0, 2), (0, 4), (k, 4))]))


def encode(payload: bytes, block: int = BLOCK, lpc_order: int = 0) -> bytes:
    """A whole stream. lpc_order: also try a learned predictor of that order in each frame."""
    x = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
    frames, points, at = [], [], 0
    for i, start in enumerate(range(0, len(x), block)):
        own = x[start : start + block]
        head = bytes([0xFF, 0xF8, 0b01110000, 0b00000010]) + _utf8_number(i) + (len(own) - 1).to_bytes(2, "big")
        head += bytes([crc8(head)])
        body = head + _subframe(own, lpc_order)
        frames.append(body + crc16(body).to_bytes(2, "big"))
        points.append(start.to_bytes(8, "big") + at.to_bytes(8, "big") + len(own).to_bytes(2, "big"))
        at += len(frames[-1])
    sizes = [len(f) for f in frames] or [0]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
    # a metadata block holds at most 2**24 bytes
    seek = b"".join(points[:: max(1, -(-len(points) // 900_000))])
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


class Damaged(ValueError):
    """A stream that isn't FLAC, or whose checksums don't hold."""


def _signed(bits: np.ndarray) -> int:
    v = 0
    for b in bits.tolist():
        v = v << 1 | b
    return v - (1 << len(bits)) if len(bits) and bits[0] else v


def _plain(bits: np.ndarray) -> int:
    v = 0
    for b in bits.tolist():
        v = v << 1 | b
    return v


def _rice_decode(bits: np.ndarray, raw: np.ndarray, at: int, n: int, k: int, ones: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """n codes from bit ``at`` on. ones: places of set bits; rank: how many lie before each place.

    raw is the bits as bytes, with some to spare. A code ends at the first set
    bit from its start plus k bits, so each set bit knows which one would end
    the next code; the chain is then followed.
    """
    if n == 0:
        return np.zeros(0, dtype=np.int64), at
    follow = rank[np.minimum(ones + (k + 1), len(bits))].tolist()
    j, chain = int(rank[at]), []
    append = chain.append
    try:
        for _ in range(n):
            append(j)
            j = follow[j]
        stops = ones[chain]
    except IndexError:
        raise Damaged("residual runs over the frame") from None
    starts = np.concatenate([[at], stops[:-1] + k + 1])
    if not k:
        return stops - starts, int(stops[-1]) + 1
    low = stops + 1
    byte = low >> 3
    window = raw[byte].astype(np.int64) << 16 | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2]
    low = window >> (24 - k - (low & 7)) & ((1 << k) - 1)
    return (stops - starts) << k | low, int(stops[-1]) + k + 1


def _residual(bits: np.ndarray, at: int, n: int, order: int) -> tuple[np.ndarray, int]:
    method, parts_log = _plain(bits[at : at + 2]), _plain(bits[at + 2 : at + 6])
    at += 6
    if method > 1:
        raise Damaged("unknown residual coding")
    width = 4 + method
    ones = np.flatnonzero(bits)
    rank = np.zeros(len(bits) + 1, dtype=np.int32)
    np.cumsum(bits, dtype=np.int32, out=rank[1:])
    raw = np.concatenate([np.packbits(bits), np.zeros(4, dtype=np.uint8)])
    out = []
    for p in range(1 << parts_log):
        count = (n >> parts_log) - (order if p == 0 else 0)
        k = _plain(bits[at : at + width])
        at += width
        if k == (1 << width) - 1:  # escaped: plain signed numbers
            w = _plain(bits[at : at + 5])
            at += 5
            u = np.array([_signed(bits[at + i * w : at + (i + 1) * w]) for i in range(count)], dtype=np.int64)
            at += count * w
            out.append(u)
            continue
        u, at = _rice_decode(bits, raw, at, count, k, ones, rank)
        out.append((u >> 1) ^ -(u & 1))
    return np.concatenate(out), at


def _samples(bits: np.ndarray, at: int, n: int, depth: int) -> tuple[np.ndarray, int]:
    kind, wasted = _plain(bits[at + 1 : at + 7]), 0
    has_wasted = bits[at + 7]
    at += 8
    if has_wasted:
        wasted = int(np.flatnonzero(bits[at:])[0]) + 1
        at += wasted
        depth -= wasted
    if kind == 0:
        x, at = np.full(n, _signed(bits[at : at + depth])), at + depth
    elif kind == 1:
        if depth == 8:
            x = np.packbits(bits[at : at + 8 * n]).view(np.int8).astype(np.int64)
        else:
            x = np.array([_signed(bits[at + i * depth : at + (i + 1) * depth]) for i in range(n)])
        at += n * depth
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        warm = [_signed(bits[at + i * depth : at + (i + 1) * depth]) for i in range(order)]
        at += order * depth
        if kind < 32:
            r, at = _residual(bits, at, n, order)
            x = _unfold(np.array(warm, dtype=np.int64), r, order)
        else:
            precision, shift = _plain(bits[at : at + 4]) + 1, _signed(bits[at + 4 : at + 9])
            at += 9
            q = [_signed(bits[at + i * precision : at + (i + 1) * precision]) for i in range(order)]
            r, at = _residual(bits, at + order * precision, n, order)
            out = list(warm)
            for v in r.tolist():
                out.append(v + (sum(c * out[-1 - i] for i, c in enumerate(q)) >> shift))
            x = np.array(out, dtype=np.int64)
    else:
        raise Damaged("reserved subframe")
    return x << wasted, at


def _unfold(warm: np.ndarray, r: np.ndarray, order: int) -> np.ndarray:
    """Undo ``order`` differences; each level's first value comes from the warm-up samples."""
    for level in range(order - 1, -1, -1):
        first = np.diff(warm, n=level)[0]
        r = np.concatenate([[first], first + np.cumsum(r)])
    return r


class _Stream:
    """The metadata of a mono 8-bit stream."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise Damaged("no FLAC stream")
        at, last, info, self.points = 4, False, b"", []
        while not last:
            if at + 4 > len(data):
                raise Damaged("metadata breaks off")
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            at += 4
            if kind == 0:
                info = data[at : at + size]
            elif kind == 3:
                points = [(int.from_bytes(data[p : p + 8], "big"), int.from_bytes(data[p + 8 : p + 16], "big")) for p in range(at, at + size, 18)]
                self.points = [p for p in points if p[0] != (1 << 64) - 1]
            at += size
        if at > len(data) or len(info) < 34:
            raise Damaged("metadata breaks off")
        packed = int.from_bytes(info[10:18], "big")
        self.first, self.block, self.digest = at, int.from_bytes(info[2:4], "big"), info[18:34]
        self.total = packed & (1 << 36) - 1
        if (packed >> 36 & 31) + 1 != 8 or (packed >> 41 & 7) + 1 != 1:
            raise Damaged("only mono 8-bit streams are read")

    def checked(self, blocks: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        pcm = b"".join(p for _, p in blocks)
        if len(pcm) != self.total:
            raise Damaged("samples are missing")
        if any(self.digest) and hashlib.md5((np.frombuffer(pcm, dtype=np.uint8) ^ 0x80).tobytes()).digest() != self.digest:
            raise Damaged("the samples' digest is wrong")
        return blocks


def _header(data: bytes, start: int) -> tuple[int, int]:
    """A frame's samples and where its subframe starts."""
    if data[start : start + 2] not in (b"\xff\xf8", b"\xff\xf9") or start + 16 > len(data) + 8:
        raise Damaged("no frame where one should be")
    code, rate, lead, at = data[start + 2] >> 4, data[start + 2] & 15, data[start + 4], start + 5
    at += 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if code in (6, 7):
        n, at = int.from_bytes(data[at : at + code - 5], "big") + 1, at + code - 5
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[start:at]) != data[at]:
        raise Damaged("a frame header's checksum is wrong")
    return n, at + 1


def _pcm(x: np.ndarray) -> bytes:
    return (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def _whole(read):
    """read, with every way in which a damaged stream can break off reported as Damaged."""

    @functools.wraps(read)
    def run(*given):
        try:
            return read(*given)
        except Damaged:
            raise
        except (IndexError, ValueError, OverflowError) as e:
            raise Damaged("the stream breaks off") from e

    return run


@_whole
def decode(data: bytes) -> list[tuple[int, bytes]]:
    """(first sample, PCM bytes) of every frame of a mono 8-bit stream; checksums must hold."""
    stream = _Stream(data)
    out, sample, at, starts = [], 0, stream.first, set()
    while at < len(data):
        start = at
        n, at = _header(data, start)
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=min(64 + 4 * stream.block, len(data) - at), offset=at))
        x, used = _samples(bits, 0, n, 8)
        at += -(-used // 8) + 2
        if crc16(data[start : at - 2]) != int.from_bytes(data[at - 2 : at], "big"):
            raise Damaged("a frame's checksum is wrong")
        out.append((sample, _pcm(x)))
        starts.add((sample, start - stream.first))
        sample += n
    if not starts.issuperset(stream.points):
        raise Damaged("a seek point is wrong")
    return stream.checked(out)


#: Bytes of frames that are decoded side by side.
SIDE_BY_SIDE = 1 << 20


@_whole
def decode_many(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """What ``decode`` returns, for each stream.

    Frames that a full seek table delimits and that have a fixed predictor
    and one Rice parameter are decoded side by side, a code of each at a time.
    """
    out: list = [None] * len(streams)
    own: list = [None] * len(streams)
    waiting, size = [], 0

    def flush():
        nonlocal size
        for (i, j, sample), x in zip([w[:3] for w in waiting], _side_by_side([w[3:] for w in waiting]), strict=True):
            out[i][j] = (sample, _pcm(x))
        waiting.clear()
        size = 0

    for i, data in enumerate(streams):
        stream = own[i] = _Stream(data)
        ends = [o for _, o in stream.points[1:]] + [len(data) - stream.first]
        frames, upto = [], 0
        for (sample, offset), end in zip(stream.points, ends, strict=True):
            start, end = stream.first + offset, stream.first + end
            n, at = _header(data, start)
            order = (data[at] >> 1) - 8
            k, aligned = (data[at + 1 + order] << 8 | data[at + 2 + order]) if 0 <= order <= 4 and at + 2 + order < end else -1, data[at] & 1
            if k < 0 or aligned or k >> 10 or (k >> 6 & 15) == 15:
                frames = []
                break
            if sample != upto:
                raise Damaged("a seek point is wrong")
            upto += n
            frames.append((sample, data, start, end, at, n, order, k >> 6 & 15))
        if not frames or upto != stream.total:
            out[i] = decode(data)
            continue
        out[i] = [None] * len(frames)
        for j, f in enumerate(frames):
            if crc16(data[f[2] : f[3] - 2]) != int.from_bytes(data[f[3] - 2 : f[3]], "big"):
                raise Damaged("a frame's checksum is wrong")
            waiting.append((i, j, *f))
            size += f[3] - f[2]
            if size >= SIDE_BY_SIDE:
                flush()
    flush()
    return [s.checked(blocks) for s, blocks in zip(own, out, strict=True)]


def _side_by_side(frames: list[tuple]) -> list[np.ndarray]:
    """Samples of frames (stream, start, end, subframe, samples, order, parameter)."""
    if not frames:
        return []
    raw = np.frombuffer(b"".join(d[at : end - 2] for d, _, end, at, *_ in frames) + bytes(4), dtype=np.uint8)
    bits = np.unpackbits(raw)
    ones = np.flatnonzero(bits)
    rank = np.zeros(len(bits) + 1, dtype=np.int64)
    np.cumsum(bits, out=rank[1:])
    lengths = np.array([end - 2 - at for _, _, end, at, *_ in frames])
    base = 8 * (np.cumsum(lengths) - lengths)
    n, order, k = (np.array([f[i] for f in frames]) for i in (4, 5, 6))
    begin = base + 8 + 8 * order + 10
    count = n - order
    by = np.argsort(-count, kind="stable")
    step, active = k[by] + 1, np.searchsorted(-count[by], -np.arange(count.max() + 1), side="left")
    j = rank[begin[by]]
    stops = np.zeros((int(count.max()), len(frames)), dtype=np.int64)
    top = len(ones) - 1
    for i in range(len(stops)):
        m = active[i]
        place = ones[np.minimum(j[:m], top)]
        stops[i, :m] = place
        j = rank[np.minimum(place + step[:m], len(bits))]
    stops = np.ascontiguousarray(stops.T)
    out = []
    for row, f in enumerate(by.tolist()):
        own, kf, nf = stops[row, : count[f]], int(k[f]), int(order[f])
        if len(own) and own[-1] + kf + 1 > base[f] + 8 * lengths[f]:
            raise Damaged("residual runs over the frame")
        u = own - np.concatenate([begin[f : f + 1], own[:-1] + kf + 1])
        if kf:
            low = own + 1
            byte = low >> 3
            window = raw[byte].astype(np.int64) << 16 | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2]
            u = u << kf | window >> (24 - kf - (low & 7)) & ((1 << kf) - 1)
        at = frames[f][3] + 1
        warm = np.frombuffer(frames[f][0][at : at + nf], dtype=np.int8).astype(np.int64)
        out.append((f, _unfold(warm, (u >> 1) ^ -(u & 1), nf)))
    return [x for _, x in sorted(out, key=lambda p: p[0])]


@_whole
def seeks(data: bytes, samples: list[int]) -> list[int]:
    """For each sample the offset in the stream of the last listed frame that starts at or before it; that frame's own number must agree.

    The stream is parsed once, and a frame checked once.
    """
    stream = _Stream(data)
    points = sorted(stream.points)
    starts = [p[0] for p in points]
    checked: dict[int, int] = {}
    out = []
    for sample in samples:
        i = bisect_right(starts, sample) - 1
        if i not in checked:
            checked[i] = _listed(data, stream, *points[i]) if i >= 0 else _listed(data, stream, 0, 0) if points else stream.first
        out.append(checked[i])
    return out


def _listed(data: bytes, stream: _Stream, first: int, offset: int) -> int:
    """Where a listed frame starts, if it is the one that the point names."""
    at = stream.first + offset
    _header(data, at)
    lead, number = data[at + 4], data[at + 4]
    if lead >= 0x80:
        more = 6 - (lead ^ 0xFF).bit_length() + 1
        number = lead & (0x3F >> more)
        for byte in data[at + 5 : at + 5 + more]:
            number = number << 6 | byte & 0x3F
    if first != (number if data[at + 1] & 1 else number * stream.block):
        raise Damaged("a seek point is wrong")
    return at


def seek(data: bytes, sample: int) -> int:
    return seeks(data, [sample])[0]
