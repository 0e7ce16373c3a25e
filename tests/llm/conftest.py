"""Small tables with odd rows, and plain helpers."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, equal and null ids, and columns of odd names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon", "en", "a"),
        (1, "Alpha beta gamma delta epsilon", "en", "a"),
        (2, "Alpha beta gamma delta epsilon", "en", None),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, " \t\r\n\x0b\x0c ", "en", "b"),
        (None, "no id here", "fr", "b"),
        (None, None, "fr", "b"),
        (6, LONG, "en", "a"),
        (6, "same id, other text", "en", "a"),
        (7, "été 日本語 \U0001f642 nbsp   sep", "fr", "c"),
        (8, "x", "en", "c"),
    ]
    extra = [(*r, 7, "clash", 1.5, [1], i) for i, r in enumerate(rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, spans array<int>, row long"
    return spark.createDataFrame(extra, kinds)


@pytest.fixture
def written(spark, tmp_path):
    """Write a frame as a table and read it again."""

    def write(df, parts: int = 3):
        path = str(tmp_path / f"table-{len(list(tmp_path.iterdir()))}")
        df.repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
