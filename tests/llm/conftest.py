from __future__ import annotations

import random

import pytest

#: Column names that the operators use inside; extra columns with them must not disturb.
CLASHES = ("row", "fp", "size", "copies", "rank", "carried", "bucket", "label", "k", "f", "found", "q", "host",
           "verdict", "keep_id", "root", "node", "n", "score", "weight", "target", "copy", "seg", "pos", "digest")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_SYLLABLES = {"en": ["the", "ing", "tion", "and", "er", "wh"], "de": ["sch", "ung", "ein", "heit", "ü", "ver"],
              "fr": ["eau", "ment", "é", "oi", "que", "eux"]}


def prose(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choices(_SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def messy_rows() -> list[tuple]:
    """Documents with nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(7)
    rows = [(i, t := prose(rng, lang, rng.randint(5, 120)), lang, f"s{i % 4}", len(t))
            for i in range(120) for lang in [rng.choice(list(_SYLLABLES))]]
    long = prose(rng, "en", 60_000)
    rows += [(120, None, "en", "s0", None), (121, "", "en", "s1", 0), (122, "   \n\t", None, None, 5),
             (123, "12 34 --", "de", "s2", 8), (124, long, "en", "s3", len(long)), (None, rows[0][1], "en", "s0", 9),
             (None, None, None, None, None), rows[3], rows[3], rows[3],
             (125, rows[5][1], "fr", None, 7), (126, rows[5][1] + " x", "fr", "s1", 7), (127, "word", "en", "s9", 4),
             (128, "nul\x00 é \U0001F600 ▁ <0x41>  two", "en", "s0", 20), (2 ** 60 + 1, "Released under the MIT License.", "en", "s1", 31)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(spark, messy):
    """The same documents with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return messy.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
