import pytest

#: Texts that every operator must bear: none, empty, blank, one word, repeats, long, odd characters.
ODD = [
    None, "", " \t\n", "a", "one two", "one two three four five", "x " * 3000, "y" * 5000,
    "\x00   \U0001f600 é ퟿ İ ſ Σς", "\n\n\n", "a\n\na\n b ", "same same same same same same same",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, repeated rows and ids, null ids, null languages, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [(3, "one two", None), (3, "one two", None), (None, "one two", "en"), (None, None, None)]
    rows = [(*r, 7, "z", 1.5, "q") for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n_words int, shard string, size double, digest string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
