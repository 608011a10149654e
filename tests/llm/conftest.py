import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def prose():
    """Reproducible texts of invented words."""

    def make(seed, words, vocabulary=400):
        draw = np.random.default_rng(seed)
        return " ".join(f"w{i}x{i * i % 97}" for i in draw.integers(0, vocabulary, words))

    return make


@pytest.fixture
def awkward(prose):
    """Rows every operator has to take: nulls, empty and long texts, ties and repeated rows."""
    long_text = prose(1, 6000, 5000)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, long_text),
        (4, long_text),
        (None, prose(2, 40)),
        (5, prose(2, 40)),
        (6, "a"),
        (7, "x" * 5000),
        (8, "Ä́ ▁ 日本語 🙂 \x00 end."),
    ]

