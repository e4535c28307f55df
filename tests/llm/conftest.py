import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like operators' own."""
    long = "Word after word goes on. " * 20_000
    rows = [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, "   \n\t ", "en", "a"),
        (4, long, "en", "b"),
        (5, "x" * 50_000, None, "b"),
        (None, "no id here", "en", None),
        (6, "the same row twice over and over", "en", "a"),
        (6, "the same row twice over and over", "en", "a"),
        (7, "é ß 日本語 \U0001f600 <|endoftext|> a\u0000b", "xx", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    for name in ("score", "key", "n", "value", "shard", "hilbert", "bpe", "toxicity", "n_tokens", "item_id", "component"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return edge_docs.limit(0)
