import hashlib
import zlib

import numpy as np
import pytest

from spindrift.llm import flac, media


def signals():
    rng = np.random.default_rng(14)
    for n in (1, 2, 5, 64, 4096, 4097, 9000):
        for x in (rng.integers(0, 256, n), np.full(n, 7), 128 + 100 * np.sin(np.arange(n) / 9), np.cumsum(rng.integers(-2, 3, n)) % 256, rng.integers(97, 110, n), np.arange(n) % 256):
            yield x.astype(np.uint8).tobytes()


def test_round_trip_and_seeking():
    for x in signals():
        for order in (0, 6):
            s = flac.encode(x, lpc_order=order)
            blocks = flac.decode(s)
            assert b"".join(p for _, p in blocks) == x
            assert flac.decode_many([s, s]) == [blocks, blocks]
            for first, _ in blocks:
                assert s[flac.seek(s, first) :][:2] == b"\xff\xf8"
    assert flac.decode(flac.encode(b"")) == []


def test_learned_predictors_and_verbatim_are_used():
    rng = np.random.default_rng(15)
    x = np.zeros(4096)
    for i in range(2, len(x)):
        x[i] = 1.6 * x[i - 1] - 0.9 * x[i - 2] + rng.normal()
    tone = np.clip(128 + 8 * x, 0, 255).astype(np.uint8).tobytes()
    assert len(flac.encode(tone, lpc_order=8)) < len(flac.encode(tone))
    noise = rng.integers(0, 256, 4096).astype(np.uint8).tobytes()
    assert len(flac.encode(noise)) < 4096 + 120


def test_damage_is_noticed():
    s = flac.encode(b"some text that is stored as samples " * 200)
    for at in [*range(4, flac._Stream(s).first), *range(flac._Stream(s).first, len(s), 97)]:
        bad = bytearray(s)
        bad[at] ^= 0x10
        for read in (flac.decode, lambda d: flac.decode_many([d])):
            try:
                assert b"".join(p for _, p in (read(bytes(bad)) if read is flac.decode else read(bytes(bad))[0])) == b"some text that is stored as samples " * 200
            except flac.Damaged:
                pass
    with pytest.raises(flac.Damaged):
        flac.decode(b"RIFF")
    frame = bytearray(s)
    frame[-5] ^= 1
    with pytest.raises(flac.Damaged):
        flac.decode_many([bytes(frame)])


def test_seek_lands_on_the_frame_or_says_so():
    raw = b"some text that is stored as samples " * 400
    s = flac.encode(raw)
    for a, p in flac.decode(s):
        at = flac.seek(s, a + len(p) - 1)
        assert at == flac.seek(s, a) and flac._header(s, at)[0] == len(p)
    starts, at = {}, flac._Stream(s).first
    for a, _ in flac.decode(s):
        starts[flac.seek(s, a)] = a
    for byte in range(4, at):
        bad = bytearray(s)
        bad[byte] ^= 0x10
        try:
            assert starts[flac.seek(bytes(bad), 5000)] <= 5000, byte  # an earlier frame, if a later one's point was moved
        except flac.Damaged:
            pass


def test_long_streams_take_linear_time():
    """Reading and seeking everywhere in a text eight times as long takes about eight times as long."""
    import time

    took = {}
    for n in (1 << 20, 8 << 20):
        raw = (b"some words of a very long text, " * (n // 32 + 1))[:n]
        s = flac.encode(raw)
        before = time.process_time()
        blocks = flac.decode_many([s])[0]
        at = flac.seeks(s, [a for a, _ in blocks])
        took[n] = time.process_time() - before
        assert b"".join(p for _, p in blocks) == raw and len(set(at)) == len(blocks) and at == sorted(at)
    assert took[8 << 20] < 20 * took[1 << 20]


def test_checksums_are_the_bitwise_ones():
    def slow(data, poly, width):
        c = 0
        for b in data:
            c ^= b << (width - 8)
            for _ in range(8):
                c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
        return c

    rng = np.random.default_rng(16)
    for n in (0, 1, 2, 300, 5000):
        d = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert flac.crc16(d) == slow(d, 0x8005, 16) and flac.crc8(d) == slow(d, 0x07, 8)


def test_stored_odd_rows(documents, odd_rows):
    got = media.stored(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    texts = {i: (t or "").encode() for i, t, *_ in odd_rows}
    for r in got:
        raw = texts[r["doc_id"]]
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        s = flac.encode(p)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(s), hashlib.sha256(s).hexdigest(), media.feature(p))
    assert media.stored(documents([])).count() == 0


def test_blocks_of_media(documents, odd_rows):
    blocks = media.pcm_blocks(media.encoded(documents(odd_rows), lpc_order=4)).collect()
    texts = {i: (t or "").encode() for i, t, *_ in odd_rows}
    for i, raw in texts.items():
        own = sorted({(r["block"], r["first_sample"], r["n_samples"], bytes(r["pcm"])) for r in blocks if r["doc_id"] == i})
        assert b"".join(p for *_, p in own)[: len(raw)] == raw
        assert all(n == len(p) for _, _, n, p in own) and [a for _, a, _, _ in own] == [sum(n for _, _, n, _ in own[:k]) for k in range(len(own))]
