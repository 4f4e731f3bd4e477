import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = (
    "The harbour lay quiet before dawn. Small boats rocked against the stones.\n"
    "A keeper walked along the wall with a lamp. He counted every rope twice.\n"
    "Later the market opened and people came down from the hills. They brought cheese and wool.\n"
    "Nobody spoke about the storm that had passed. The sea looked as if nothing had happened."
)


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, a long text, marks and other scripts."""
    long_text = " ".join(f"word{i % 977} item{i % 89}." + ("\n" if i % 12 == 0 else "") for i in range(30_000))
    return [
        (1, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (5, " \t\n\x0b\x0c\r ", "fr", "a", 7),
        (None, PROSE + "\nOne more line follows here.", "en", "a", 1),
        (None, None, None, None, None),
        (6, long_text, "de", "b", len(long_text)),
        (7, "one two", "en", "b", 7),
        (8, "ÀÉ straße 日本語 𓀀 ▁x\u00a0y\x00z", "fr", "b", 3),
        (9, "Home | About | Contact | Help | Log in to site\n" * 30, "en", "b", 9),
        (-1, "one TWO", "en", "b", 7),
    ]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names are like those that operators use, also in another case."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["key", "block", "fp", "row", "words", "lines", "n", "shard", "mark", "gone", "x", "host", "kept", "n_words", "cell", "size"]
        return df.select("*", *[F.lit("clash").alias(n) for n in names], F.lit(1).alias("TEXT "))

    return add
