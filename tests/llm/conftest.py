import pytest

from rungkit.llm.common import ship_package

AWKWARD = [
    (1, "The quick brown fox  jumps\nover the lazy dog, it's 2024!!", "en", "a"),
    (2, "The quick brown fox  jumps\nover the lazy dog, it's 2024!!", "en", "a"),     # a copy
    (2, "The quick brown fox  jumps\nover the lazy dog, it's 2024!!", "en", "a"),     # a repeated row
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "fr", "b"),
    (None, "no id here but words", "en", "b"),
    (6, "émoji 😀 <|endoftext|> d'été  ", "fr", None),
    (7, "word " * 3000 + "end", "en", "a"),
    (8, "x", "de", "c"),
    (9, "one two", None, "c"),
]


@pytest.fixture(scope="session")
def ready(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def awkward(ready):
    """Nulls, empty and long texts, copies, repeated rows, and extra columns
    whose names the operators use themselves."""
    df = ready.createDataFrame(AWKWARD, "doc_id bigint, text string, lang string, source string")
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("x").alias(c) for c in (
        "c0", "c1", "key", "score", "digest", "fp", "component", "n_tokens", "node", "label", "rate", "kept",
        "text_hash", "features", "row", "u", "v")])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
