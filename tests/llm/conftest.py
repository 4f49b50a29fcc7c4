import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, size long, pattern string, row string, range int, h long, block long, pos int, template int, "
    "id long, same string, key string, n long, media string, label int, taken long, score double, part int"
)
EXTRA = len(SCHEMA.split(",")) - 5


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table, with further columns whose names operators use inside, from (doc_id, text, lang, source)."""

    def make(rows):
        full = [(*(r + ("en", "src0")[len(r) - 2 :])[:4], 0, *[None] * EXTRA) for r in map(tuple, rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, a null id and text beyond ASCII."""
    long = " ".join(f"word{i % 977} stands{i % 31}" for i in range(60_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, long, "en", "a"), (5, "same text here now", "en", "b"),
        (5, "same text here now", "en", "b"), (6, "same text here now", None, "b"), (None, "no id at all", "de", "c"), (7, "x" * 70_000, "fr", "c"),
        (8, "Ünïcode ſtraße   日本語 \U0001f600 é", "de", "d"), (9, "12345 !!! ###", "fr", "d"), (-10, "negative id", "es", "a"),
    ]
