import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm import packing

T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return [*T.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_are_the_tokenizers():
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for s in ("", "a b", "İstanbul ſtop it's they'll 1234 a1b2,x <|endoftext|>x Ǆ é é µm ª, \x85b c a\x1cb \xa0 ...!? Straße,, ÀÉ. 日本語 x́", "Σας ΟΔΟΣ.", "don't, can't. ::;; a.b,c", "×÷ñ"):
        assert w.ids(s.encode()) == w.encode(s), s


def test_word_memory_is_bounded_and_keeps_frequent_words(monkeypatch):
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), corpus_pipeline.REMEMBERED)
    for i in range(300_000):
        w.ids(b"often w%x" % i)
    w.ids(b"x" * 100_000)
    held = [*w.items(), *w.former.items()]
    assert len(held) <= 150_000 and sum(sys.getsizeof(x) for pair in held for x in pair) < 16 << 20
    monkeypatch.setattr(w, "letters", lambda _: 1 / 0)
    assert w.ids(b"often") == w.encode("often")


def test_signs_that_end_a_word_and_known_words_spare_the_tokenizer(monkeypatch):
    w = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words = [*(f"Wörter{sign}" for sign in ("$$$", "***", "%%%", "&&&", "###", ".#!")), "'s$", "a1$", "$a$", "<b>$", "\u0301$", "ß*"]
    for s in words:
        assert w.ids(s.encode()) == w.encode(s), s
    w.ids(b"plain . ###")
    monkeypatch.setattr(w, "encode", lambda _: 1 / 0)
    assert w.ids("Straße$$$ other&&&".encode())
    monkeypatch.setattr(w, "letters", lambda _: 1 / 0)
    assert w.ids(b"plain. plain###") == b"".join(w[x] for x in (b"plain", b".", b"plain", b"###"))


def check(rows, got, capacity=2048):
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for i, own in texts.items():
        want = Counter()
        for t in own:
            x = ids(t)
            cuts = sorted({r["start"] for r in by[i] if r["doc_tokens"] == len(x) and r["start"] < len(x)}) + [len(x)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                want[a, b - a, zlib.crc32(np.array(x[a:b], dtype="<u4").tobytes()), len(x)] += 1
        assert want == Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by[i])
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in windows.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= capacity
    used = sum(r["length"] for r in got)
    full = sum(n if n & (n - 1) == 0 else capacity for n in (sum(x for _, x in own) for own in windows.values()))
    return full / max(used, 1) - 1


def test_packing_tables(spark, documents, odd_rows):
    check(odd_rows, packing.pack(documents(odd_rows)).collect())
    assert packing.pack(documents([])).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check(rows, packing.pack(docs).collect()) < 0.02


def test_differencing_is_near_equal():
    rng = np.random.default_rng(7)
    for k in (1, 2, 5, 17):
        lengths = rng.integers(1, 500, 40 * k).tolist()
        found = packing.difference(lengths, k)
        assert sorted(i for _, own in found for i in own) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in own) == total for total, own in found)
        totals = [total for total, _ in found]
        assert len(totals) == k and max(totals) - min(totals) <= 5
    assert packing.difference([], 3) == [] and packing.windows([], 10) == []
    assert len(packing.windows([6, 6, 6], 10)) == 3  # two windows would hold 18, but none of them two pieces
