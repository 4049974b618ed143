import pytest

#: Nulls in every column, empty and one-word texts, a very long one, ties and repeated rows, and
#: extra columns whose names clash with those the operators add.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one", "en", "a", 3),
    (4, "same text here that is long enough to be a shingle or two", "en", "b", 57),
    (5, "same text here that is long enough to be a shingle or two", "en", "b", 57),
    (5, "same text here that is long enough to be a shingle or two", "en", "b", 57),
    (6, "word " * 60_000, "en", "c", 300_000),
    (7, "é" * 50_000, "fr", "c", 50_000),
    (8, " \n\t ", "de", None, 4),
    (9, "\U0001f600 token = 'abcdef123456' 1.2.3.4 a@b.co +1 (222) 333-4444", "en", "d", 60),
    (10, "9" * 30_000, "en", "d", 30_000),
    (None, "same text here that is long enough to be a shingle or two", "en", "b", 57),
    (None, "nobody's token = 'fedcba654321' here", None, "e", 36),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("score", "held_out", "label", "row_id", "size", "digest", "kept", "train", "component_id")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
