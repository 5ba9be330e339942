import pytest

LONG = "the quick brown fox and the lazy dog of a small town " * 4000
PROSE = "the cat and the dog went to the town with a friend of the family and it was good for all that came by the river in the sun "
DOCS = [
    (1, PROSE * 3, "en", "a"), (2, PROSE * 3, "en", "b"), (3, "", "en", "a"), (4, None, None, None), (None, "nobody has this text at all", "fr", "a"),
    (5, "BUY!! NOW!! " * 60, "en", "a"), (6, "a\tb\x0bc\n\n\na\tb\x0bc", "de", ""), (7, LONG, "en", "a"), (8, "naïve café ñandú 日本語 \U0001f600 a@b.co +1 (555) 123-4567", "es", "c"),
    (8, "naïve café ñandú 日本語 \U0001f600 a@b.co +1 (555) 123-4567", "es", "c"), (None, None, "en", "a"), (9, " ", "en", "a"), (10, "x", "en", "z"),
]
CLASHING = ["t", "i", "k", "fp", "p", "row", "w", "n", "score", "kept", "key", "words", "component_id", "_measured0", "place", "again", "part", "ids"]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in DOCS]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()
