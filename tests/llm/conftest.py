"""Documents for the tests, with everything that may go wrong in one table."""

from __future__ import annotations

import pytest

from corpus_frames import FOLDER, ODD, frame


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a NULL text, a NULL key, a repeated row, and a key with two texts."""
    rows = [(n, text) for n, text in enumerate(ODD)]
    rows += [(100, None), (None, "word"), (None, None), (3, "word"), (3, "other words"), (101, "la " * 20_000)]
    return frame(spark, rows, size="7", spans="clash", component_id="clash", hits="clash", slot="clash", part="clash")


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
