import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang[, source]]) rows."""
    def make(*rows):
        full = [(*row, *("en", "s")[len(row) - 2:]) for row in rows]
        return spark.createDataFrame([(*row, len(row[1] or "")) for row in full], DOCUMENTS)
    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty texts, repeated rows, a very long text, and columns with names that operators use."""
    from pyspark.sql import functions as F

    made = documents(
        (1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (3, ""), (None, "the cat sat on the mat"),
        (None, None), (4, "ok"), (5, " \t\n "), (6, "the long text of words " * 30_000), (7, "naïve café 😀 ẞ\nΣΑΣ", None, None))
    for name in ("words", "M", "fp", "host", "hashes", "condemned", "id", "root", "part", "length", "rank", "uid", "held_out", "key"):
        made = made.withColumn(name, F.lit("extra"))
    return made


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)
