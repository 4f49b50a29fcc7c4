import re

from spindrift.llm import licenses

PHRASES = {"mit": "mit license".split(), "apache": "apache license".split(), "gpl": "general public license".split()}


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    hits = [(i, label) for label, p in PHRASES.items() for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def rows_of(got):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got)


def test_base_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = licenses.scan(docs).collect()
    assert rows_of(got) == sorted((False, r["doc_id"], *base(r["text"])) for r in docs.collect())
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)


ODD = [
    "MIT License mit license", "mit", "License", "apache license apache", "general public license general public", "mit-license!", "MİT License", "mité license",
    "mit license " * 300, "the general public general public license", "mıt license Apache\x00License", "mit license license mit license",
]


def test_odd_rows(documents, odd_rows):
    rows = [*odd_rows, *[(100 + i, t, "en", "a") for i, t in enumerate(ODD)], (100, ODD[0], "en", "b")]
    got = licenses.scan(documents(rows)).collect()
    assert rows_of(got) == sorted((i is None, i, *base(t)) for i, t, *_ in rows)
    assert licenses.scan(documents([])).count() == 0


def test_diagonals_find_changed_passages(documents):
    permission = licenses.TEMPLATES[1][1]
    cut = permission.split()
    texts = {
        1: f"intro {permission} outro", 2: "x " + " ".join(cut[:9] + ["kindly"] + cut[9:]), 3: " ".join(cut[:6] + cut[8:]),
        4: " ".join(cut[:4]), 5: " ".join(reversed(cut)), 6: "Licensed under CC BY-NC 4.0.", 7: "Licensed under CC BY 4.0", 8: "person obtaining fee",
    }
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in licenses.scan(documents([(i, t) for i, t in texts.items()])).collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "mit" and got[3][0] == "mit" and 0.8 < got[2][1] <= 1 and 0.8 < got[3][1] < 1
    assert got[4] == got[5] == got[8] == ("", 0.0) and got[6] == ("cc-by-nc", 1.0) and got[7] == ("cc-by", 1.0)


def test_plan_is_native(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (licenses.hits(docs), licenses.scan(docs)):
        assert not re.search("Python|Pandas|Arrow|MapIn", df._jdf.queryExecution().executedPlan().toString())


def test_repeats_of_one_place_are_no_license(documents):
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents([(1, "source code " * 12, "en", "a"), (2, "the gnu lesser general public license", "en", "a")])).collect()}
    assert got == {1: "", 2: "gpl,lgpl"}


def test_whole_texts(documents):
    """Each long text is found with every fifteenth word changed, and none of its halves in another order."""
    long = [(i, label, text.split()) for i, (label, text) in enumerate(licenses.TEMPLATES) if len(text.split()) > 40]
    changed = [(i, "before it " + " ".join("other" if at % 15 == 7 else x for at, x in enumerate(w)) + " after it") for i, _, w in long]
    mixed = [(1000 + i, " ".join(w[::2] + w[1::2])) for i, _, w in long]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(documents(changed + mixed)).collect()}
    assert all(label in got[i] for i, label, _ in long) and len(long) >= 6
    assert all(got[1000 + i] == [""] for i, _, _ in long)
