import pytest

#: A table that has what operators must bear: nulls, empty and long texts, ties, repeated rows, and
#: columns with names that operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, _fp string, size int, digest string"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "k", "f", 3, "d")


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(f"word{k % 700}" for k in range(30_000))
    line = "one two three four five six seven eight nine ten"
    rows = [
        row(1, f"{line}\nsomething else here that is new"),
        row(2, f"Another start of it all\n{line.upper()}!\nend"),
        row(3, None),
        row(4, ""),
        row(5, " \n\t "),
        row(None, "a text without id " * 5, None, None),
        row(None, "a text without id " * 5, None, None),
        row(7, long, "de", "b"),
        row(7, long, "de", "b"),
        row(8, "The same text, twice over", None, "b"),
        row(9, "the SAME text, twice over", "fr", None),
        row(10, "Ünïcödé 日本語 text mit Wörtern ***", "de", "c"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
