from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words, determined by the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or longer tuples, with columns that clash with the operators' own."""

    def build(rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "'x' AS _key", "1 AS score", "'y' AS size", "2 AS node", "'z' AS seed", "'q' AS rank")

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = prose(5, 40_000)
    return make(
        [
            (1, "One two three four five six seven", "en", "a"),
            (1, "One two three four five six seven", "en", "a"),
            (2, None, "en", "a"),
            (3, "", None, None),
            (None, "some text with a null id here", "de", "b"),
            (None, None, None, None),
            (4, long, "en", "b"),
            (5, long.upper(), "fr", "b"),
            (6, " \t\n ", "en", "c"),
            (7, "12345 !!! 678", "en", "c"),
            (8, "ÀÉ îö ñ 日本語 😀 text", "fr", "\U0001f600"),
        ]
    )
