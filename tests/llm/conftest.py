import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs, with the table's columns and one that clashes with inner names."""

    def make(rows, source="s0", lang="en"):
        full = [(i, t, lang, source(i) if callable(source) else source, None if t is None else len(t), 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key long")

    return make


#: Nulls, empty and blank texts, repeated rows, equal ids with other texts, a very long text.
ODD = [(None, "alpha beta gamma delta epsilon zeta"), (None, None), (1, None), (2, ""), (3, " \n\t\r\n "), (4, "alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon zeta"), (4, "another text of the same id with words enough to count"), (5, "Ünïcode ÉTÉ 日本語 🎉 words here"), (6, "x " * 60000), (7, "Alpha Beta gamma delta epsilon zeta")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
