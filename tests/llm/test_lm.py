import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import lm


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def expectation_maximisation(bins, words):
    """Plain numbers, one bin at a time; bins: (bucket, steps of the three estimates) to tokens."""
    weights = {}
    for b, *_ in bins:
        first = [0.05, 0.2, 0.35, 0.4] if b >= lm.BUCKETS else [0.05, 0.35, 0.6, 0.0] if b else [0.1, 0.9, 0.0, 0.0]
        weights[b] = first
    for _ in range(lm.ROUNDS):
        sums = {b: [0.001, 0.001, 0.0, 0.0] for b in weights}
        for (b, *q), n in sorted(bins.items()):
            p = [1 / (words + 1), *[0 if x < 0 else 2 ** (-x / 2) for x in q]]
            share = [w * x for w, x in zip(weights[b], p, strict=True)]
            for i in range(4):
                sums[b][i] += n * share[i] / sum(share)
        weights = {b: [x / sum(own) for x in own] for b, own in sums.items()}
    return weights


class Model:
    """Counts of every occurrence."""

    def __init__(self, texts):
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for text in texts:
            u = v = None
            for w in tokens(text):
                self.one[w] += 1
                self.two[v, w] += 1
                self.three[u, v, w] += 1
                u, v = v, w
        self.n = sum(self.one.values())

    def estimates(self, text):
        """Each word with its bucket and three estimates."""
        u = v = None
        for w in tokens(text):
            c = self.one[v]
            wide = c if v is None else self.two[u, v]
            b = lm.BUCKETS + int(math.log2(wide)) + 1 if wide else int(math.log2(c)) + 1 if c else 0
            yield w, b, (self.one[w] / self.n if self.n else 0, self.two[v, w] / c if c else 0, self.three[u, v, w] / wide if wide else 0)
            u, v = v, w


def brute(rows):
    model = Model([t for i, t in rows if fold(i)])
    rest = Model([t for i, t in rows if fold(i) > 1])
    v = len(model.one)
    bins = Counter()
    for i, text in rows:
        if fold(i) == 1:
            for _, b, p in rest.estimates(text):
                bins[(b, *[round(-2 * math.log2(x)) if x else -1 for x in p])] += 1
    weights = expectation_maximisation(bins, v)
    unmet = lm.learn(np.zeros(0, dtype=int), np.zeros((3, 0)), np.zeros(0), v)
    out = {}
    for i, text in rows:
        base = score = known = 0
        for w, b, p in model.estimates(text):
            c = model.one[w]
            base += math.log10((c + 0.1) / (model.n + 0.1 * (v + 1)))
            known += c > 0
            own = weights.get(b, unmet[b]) if model.n else [1, 0, 0, 0]
            score += math.log10(sum(x * y for x, y in zip(own, (1 / (v + 1), *p), strict=True)))
        out[i] = (fold(i) == 0, len(tokens(text)), known, model.n, base, score)
    return out


def agree(rows, got):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        h, n, k, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_scores_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lm.score(docs).collect()
    agree([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows_and_ranges(documents, odd_rows, monkeypatch):
    agree([(i, t) for i, t, *_ in odd_rows], lm.score(documents(odd_rows)).collect())
    monkeypatch.setattr(lm, "RANGE_KEYS", 50)
    agree([(i, t) for i, t, *_ in odd_rows], lm.score(documents(odd_rows)).collect())
    assert lm.score(documents([])).count() == 0
    only_held = [(i, "some text") for i in range(200) if fold(i) == 0][:3]
    got = lm.score(documents(only_held)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in got)
    agree(only_held, got)


def test_weights_are_learned_and_planes_invert():
    rng = np.random.default_rng(6)
    b, q = np.array([3, 3]), np.array([[10, 10], [2, -1], [-1, -1]])  # nine of ten tokens have a bigram estimate of a half
    w = lm.learn(b, q, np.array([90, 10]), 1000)
    assert w[3, 2] > 0.8 and np.allclose(w.sum(axis=1), 1)
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (np.cumsum(lm._numbers(lm._planes(np.diff(x, prepend=np.uint64(0)))), dtype=np.uint64) == x).all()


def test_blocks_may_be_split_between_scans(spark, tmp_path, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} w{i}", "en") for i in range(500)]
    path = f"{tmp_path}/docs"
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.option("parquet.block.size", 1024).option("parquet.page.size", 256).parquet(path)
    docs = spark.read.parquet(path)
    whole = sorted(map(tuple, lm.score(docs).collect()))
    size, real = "spark.sql.files.maxPartitionBytes", lm.staged
    before = spark.conf.get(size)

    def staged(df, name):
        out = real(df, name)
        spark.conf.set(size, "700")
        return out

    monkeypatch.setattr(lm, "staged", staged)
    try:
        for at in ("400", before):
            spark.conf.set(size, at)
            got = sorted(map(tuple, lm.score(docs).collect()))
            assert [r[:5] for r in got] == [r[:5] for r in whole]
            assert all(abs(a - b) < 1e-6 for r, w in zip(got, whole, strict=True) for a, b in zip(r[5:], w[5:], strict=True))
    finally:
        spark.conf.set(size, before)


def test_blocks_of_long_texts_give_the_same_scores(documents, monkeypatch):
    """Whatever rows a text's block takes by its length, counts and scores are the same; texts of a block stay within its bytes."""
    assert all(most * rows == 128 << 20 for most, rows in lm.LOTS)
    texts = [f"some words {i % 7} of text {i % 13} " * (1 + 5 * (i % 11)) for i in range(300)]
    docs = lm.from_files(documents(list(enumerate(texts))))
    want = {r["doc_id"]: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "LOTS", ((200, 64), (800, 16), (1200, 4)))
    sizes = {}
    for r in lm.blocked(docs).collect():
        sizes.setdefault(r["block"], []).append(len(r["text"]))
    assert all(sum(v) <= 12800 or len(v) == 1 for v in sizes.values())
    for r in lm.score(docs).collect():
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (w["n_tokens"], w["n_known"], w["train_tokens"], w["held_out"])
        assert abs(r["score"] - w["score"]) < 1e-6 * abs(w["score"]) and abs(r["base_score"] - w["base_score"]) < 1e-9 * abs(w["base_score"])
