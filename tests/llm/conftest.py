import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds documents from texts or (doc_id, text, lang, source) rows."""

    def build(*rows):
        full = [(i, r, "en", "a") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)

    return build


@pytest.fixture
def hard(documents):
    """Nulls in every column, empty and long texts, repeated rows, and names that clash."""
    from pyspark.sql import functions as F

    prose = " ".join(f"word{i % 97} and the other{i % 89}" for i in range(30_000))
    rows = documents(
        (1, "plain words of a small text here", "en", "a"),
        (1, "plain words of a small text here", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "a text without any id at all in it", "de", "b"),
        (None, None, None, None),
        (4, prose, "en", "b"),
        (5, "plain words of a small text here", "fr", None),
        (6, "... 123 !!!", "", ""),
    )
    for name in ("size", "key", "tie", "epochs", "target", "shard", "slot", "fp", "root", "term", "rest", "words", "score", "hits", "id", "weight", "y"):
        rows = rows.withColumn(name, F.lit(name))
    return rows
