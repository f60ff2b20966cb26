import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox jumps over the lazy dog\n" * 6_000

#: NULLs in every column, empty and very long texts, repeated rows, a repeated id with another text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\x0b\n\r ", "en", "a", 6),
    (4, LONG, "en", "a", len(LONG)),
    (4, LONG, "en", "a", len(LONG)),
    (5, "one line of words that is there twice\nOne LINE of words that is there twice \nshort", "en", None, 1),
    (5, "another text of this id\none line of words that is there twice", "en", "b", 1),
    (6, "x\n\n\ny", None, "b", 5),
    (None, "one line of words that is there twice", "en", "b", 1),
    (None, None, None, None, None),
    (7, "größe ÄÖ 漢字 😀 é ▁   end", "de", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns that clash with names used inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in ("doc", "id", "line", "lines", "words", "n", "w", "score", "ids", "row", "print", "fold", "_doc", "__doc", "_lines", "__lines", "_lost", "__lost")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
