import zlib

import numpy as np

from spindrift.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)


def test_margins_equal_the_wide_product():
    rng = np.random.default_rng(8)
    batch = [b"", b"a", "Été À LA plage".encode(), b"the " * 5000, bytes(range(32, 127)) * 3]
    w, bias = rng.normal(size=(langid.DIMS, 3)).astype(np.float32), rng.normal(size=3)
    want = langid.frequencies(batch).astype(np.float64) @ w + bias
    assert np.allclose(langid.margins(batch, w, bias), want, atol=1e-4)


def test_long_texts_are_read_whole(monkeypatch):
    text = [b"abc " * 700 + b"xyz " * 900, b"end"]
    want = langid.frequencies(text)
    monkeypatch.setattr(langid, "SLICE", 64)
    assert np.allclose(langid.frequencies(text), want, atol=1e-6)


def test_machine_separates():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 > 0, 1.0, -1.0)
    w = langid.machine(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(odd_rows)
    texts = {i: t for i, t, *_ in odd_rows}
    for r in got:
        no_letter = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == no_letter and (not no_letter or r["score"] == 0)
    nothing = documents([(1, "text without a language", None), (2, None, None)])
    assert {r["lang_pred"] for r in langid.predict(nothing, langid.fit(nothing)).collect()} == {"und"}
    empty = documents([])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    one = documents([(i, "nur eine sprache", "de") for i in range(9)])
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(one, langid.fit(one)).collect()} == {("de", 1.0)}


def test_families():
    assert langid.family_of("de") == langid.family_of("en-GB") == "germanic" and langid.family_of("fr") == "romance" and langid.family_of("tlh") == "tlh"
