from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents; extra columns have names that operators use themselves."""

    def make(rows, extra: bool = False):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("score", "size", "copies", "node", "comp", "label", "rank", "id", "gone", "block", "span", "kept", "predicted"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


WORDS = [f"w{i}" for i in range(4000)]


def passage(seed: int, n: int) -> str:
    """``n`` words that another seed does not give in this order."""
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % 4000] for i in range(n))
