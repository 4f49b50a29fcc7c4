import re
from collections import Counter

import duckdb
import pytest

from spindrift.llm import quality
from spindrift.llm.sql import ORACLE_SQL


def base(text):
    """The base counts by their definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def counted(rows):
    return sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)


ODD = [
    "a b c a b c", "a b c\na b c\na b c", "a a a a", "x y z   q", "one\n\n one\none\r\none", "#*$%&|<>", "<b>\x0bbold\x0c</b>", "\x00 \x00 \x00 \x00",
    "\U0001f600 " * 60, "the " * 49 + "end", "word " * 200, " ".join(f"the w{i} of" for i in range(40)), "a\n" * 5000,
]


def test_base_by_definition(documents, odd_rows):
    rows = [*odd_rows, *[(100 + i, t, "en", "a") for i, t in enumerate(ODD)]]
    got = quality.rated(documents(rows)).collect()
    assert counted(got) == sorted((str(i), *base(t)) for i, t, *_ in rows)
    assert all(not (r["kept"] and (r["base_failed"] or r["broken"])) for r in got)
    assert quality.rated(documents([])).collect() == []


def test_equals_duckdb(spark, documents, odd_rows, tmp_path):
    fixtures = ["/root/testdata/sf0.001/documents.parquet", f"{tmp_path}/odd"]
    documents([*odd_rows, *[(100 + i, t, "en", "a") for i, t in enumerate(ODD)]]).write.parquet(fixtures[1])
    for path in fixtures:
        got = quality.rated(spark.read.parquet(path))
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}{'/*.parquet' if 'odd' in path else ''}'")
        want = c.execute(ORACLE_SQL["op13_quality_rules"])
        assert [x[0] for x in want.description] == got.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


PHRASES = [f"the house{x} of stone{x}" for x in (f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))]


def test_rules_bind_one_by_one(documents):
    clean = " ".join(PHRASES)
    assert [r["kept"] for r in quality.rated(documents([(1, clean)])).collect()] == [True]
    broken = {
        "chars.mean": clean.replace("house", "h" * 60), "symbols.share": clean.replace("stone", "stone#"), "lettered_share": clean.replace("stone", "123 45 "),
        "capital_share": clean.replace("house", "HOUSE").replace("stone", "STONE"), "stop.n": clean.replace("the ", "zze ").replace(" of ", " zof "),
        "dup_line_share": clean + "\nthe same line stands" * 8, "bullet_share": "\n".join(f"- {x}" for x in PHRASES), "ellipsis_share": "\n".join(f"{x}..." for x in PHRASES),
    }
    got = {r["doc_id"]: r for r in quality.rated(documents(list(enumerate(broken.values())))).collect()}
    for i, name in enumerate(broken):
        assert name in got[i]["broken"].split(",") and not got[i]["kept"], name


def test_passing_keeps_columns(documents, odd_rows):
    clean = " ".join(PHRASES)
    docs = documents([*odd_rows, (7, clean), (7, clean), (None, clean)])
    kept = quality.passing(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["7", "7", "None"]


@pytest.mark.parametrize("label, kept", [(1, True), (0, False)])
def test_labelled_documents(spark, label, kept):
    """Documents of good quality stay and others go, but for texts of under 50 words."""
    at = "/root/testdata/sf0.01/"
    rated = quality.rated(spark.read.parquet(at + "documents.parquet")).where("n_words >= 50")
    got = rated.join(spark.read.parquet(at + "labels.parquet").where(f"quality = {label}"), "doc_id").collect()
    assert len(got) > 10 and sum(r["kept"] == kept for r in got) >= 0.98 * len(got)
