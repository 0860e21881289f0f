"""Documents with every odd case: nulls, empty and very long texts, repeats, clashing columns."""

import pytest

CLASHING = "id row key print keys hash n u copies digest place gone size score text_2 kind first batch"

LONG = " ".join(f"w{i % 977} and{i % 31}" for i in range(30_000))


def rows_of_documents():
    texts = [
        "Call +1 (555) 010-9999 or mail a.b@c.example.org from 10.0.0.1.\nReleased under the MIT License.",
        "The quick brown fox jumps over the lazy dog near the old river bank today.\nA shared line of text.",
        "The quick brown fox jumps over the lazy dog near the old river bank today.\nA shared line of text.",
        "",
        None,
        LONG,
        "x",
        "é ß 漢字 \U0001f600 Ünï 4111111111111111 999.1.1.1 cc by nc",
        "idiot idiot trash clown",
    ]
    out = [(i, t, ("en", None, "fr")[i % 3], ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    out.append((1, texts[1], "en", "b", 5))  # a repeated row
    out.append((None, texts[1], "en", "b", 5))
    out.append((None, None, None, None, None))
    return out


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with clashing extra columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows_of_documents(), DOCUMENTS).repartition(3)
    return docs.select("*", *(F.lit("?").alias(c) for c in CLASHING.split()))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
