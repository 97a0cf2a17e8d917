import pytest

from hearsay.llm.tables import importable

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, row INT, size STRING, score STRING, range INT, " \
         "k STRING, m STRING, drop STRING, rows STRING"


def _documents():
    base = "the quick brown fox jumps over the lazy dog and runs on through the green wood to the old mill by the river where "
    long = " ".join(f"word{i % 700} of page{i}" for i in range(30_000))
    texts = [
        None, "", "   \n\t ", "one", "one two three four", base * 3, base * 3, (base * 3).replace("lazy", "sleepy"),
        "mail me at jo.doe@mail.example.org or +1 (784) 555-9263, later (784) 555-9263 again", long, long + " tail",
        "4111 1111 1111 1111 and 10.0.0.1 but 999.1.1.1", "ü" * 500, "ж аб вг " * 60, "a\x00b \x00", "😀 " * 80,
    ]
    langs = [None, "en", "en", "en", "en", "en", "en", "en", "en", "en", "en", "de", "de", "ru", "ru", None]
    rows = [(i, t, langs[i], ["s1", "s2", None][i % 3], None, "x", i, "y", "z", 1, "k", "m", "d", "r") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "text of a row without a key " * 10, "en", "s1", 1, "x", 1, "y", "z", 1, "k", "m", "d", "r")]


@pytest.fixture(scope="session")
def odd_rows():
    return _documents()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    importable(spark)
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    importable(spark)
    return spark.createDataFrame([], SCHEMA)
