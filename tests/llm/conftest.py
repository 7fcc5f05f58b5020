import random

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, long, repeated and unusual texts."""
    r = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them again " * 6
    return [
        None, "", " ", "\n\t ", "a", "Word", "don't they're 's x'S", "naïve 日本語 한국어 😀😀", "<|endoftext|> a<|endoftext|><|endoftext|>b", "z" * 5000, "ab " * 3000,
        base, base, base + " one more word", "x" + base, "NUL\0in\0side", "".join(r.choice("ab '\n\tslrevd1é😀 !") for _ in range(3000)), "123 456 !!! ???",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with a null id, a repeated row and columns whose names clash with the operators' own."""
    rows = [(k, t, "x", "y", 1.0, "en" if k % 2 else None) for k, t in enumerate(odd_texts)]
    rows += [(None, "a text of a null id", "x", "y", 1.0, None), rows[11]]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, key string, n double, lang string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, toxic int")
