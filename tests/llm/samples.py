"""Fixtures shared by the tests of this folder."""

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table: rows of (doc_id, text) with the other columns filled in, or of all five columns."""

    def make(rows):
        full = [r if len(r) == 5 else (*r, "en", f"src{i % 3}", len(r[1]) if r[1] is not None else None)
                for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


#: Rows that every operator must take: nulls anywhere, empty and long texts, repeated rows, odd characters.
ODD = [
    (900001, None, None, None, None), (None, "a text without an id", "en", None, None), (900002, "", "en", "src1", 0),
    (900003, "   \n\t ", "en", "src1", 6), (900004, "word " * 30_000, "en", "src2", 150_000), (900005, "same row twice here now", "en", "s", 23),
    (900005, "same row twice here now", "en", "s", 23), (900006, "x" * 50_000, "en", "s", 50_000),
    (900007, "naïve 漢字 emoji 😀 é  z", "fr", "s", 20), (-8, "negative id", "en", "s", 11),
    (None, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)
