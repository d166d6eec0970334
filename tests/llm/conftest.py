from __future__ import annotations

import public_tokenizers
import pytest

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, tokens string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, repeated, tied and very long rows, with columns that clash with those of results."""
    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", None),
        (2, None, "en", "a"),
        (3, "", None, "a"),
        (4, " \n\t ", "en", None),
        (5, words, "en", "b"),
        (6, words + " end", "en", "b"),
        (None, "A text without an id, but with some words in it.", "en", "b"),
        (7, "same text twice", "en", "a"),
        (7, "same text twice", "en", "a"),
        (8, "Ünïcödé «é» 日本語 text 😀 with marks!! <|endoftext|> and İ Σ ß.", None, None),
        (9, "1234 5678 !!!", "de", None),
        (10, "x" * 300_000, "de", None),
    ]
    return spark.createDataFrame([(i, t, g, s, None, "no", "no", "no", "no") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
