from __future__ import annotations

import random

import pytest

#: Extra columns whose names clash with those the operators use inside.
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, key long, t string, run string, node string, "
    "bucket string, `__id` long, component string, n int, plain string, piece string, row_id string, licence string"
)


def _extra(doc_id, text):
    return (doc_id, text, "en", "src0", 1, 1, "x", "x", "x", "x", 1, "x", 1, "x", "x", "x", "x")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([_extra(*r) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, repeated rows, one id for two texts, copies, near copies and a very long text."""
    rng = random.Random(6)

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, long = prose(120), prose(30_000)
    near = base.split()
    near[7], near[70] = "changed", "altered"
    return [
        (1, None),
        (2, ""),
        (3, "  \n\t "),
        (4, "one"),
        (5, "one two"),
        (6, base),
        (6, base),
        (7, base.upper()),
        (8, " ".join(near)),
        (9, prose(80)),
        (9, prose(90)),
        (None, base),
        (None, None),
        (10, long),
        (11, long + " " + base),
        (12, "naïve café œuvre ▁ don't  stop!\r\n漢字かな\x00end"),
        (13, "aaaa" * 200),
    ]
