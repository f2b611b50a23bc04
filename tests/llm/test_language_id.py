from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.llm import language_id as L
from tests.llm.conftest import messy_rows, prose, rows_of


def plain_trigrams(text):
    padded = "".join(c if c.isalpha() else " " for c in f"  {text.lower()}  ")
    return [padded[i:i + 3] for i in range(len(padded) - 2)
            if "  " not in padded[i:i + 3]]


def test_trigrams_match_plain_code(monkeypatch):
    texts = ["Ab c", "", "é!x", "a", "İx ßß\n\U00020000", "one two three four"]
    for block in (3, 1 << 20):
        monkeypatch.setattr(L, "_CHARS", block)
        packed, owner = (np.concatenate(x) for x in zip(*L.trigram_blocks(texts)))
        for i, text in enumerate(texts):
            mine = sorted((int(g) >> 42, int(g) >> 21 & 0x1FFFFF, int(g) & 0x1FFFFF) for g in packed[owner == i])
            assert mine == sorted(tuple(map(ord, t)) for t in plain_trigrams(text)), text


def test_prediction_against_exact_sets(messy, clashing):
    """The same decisions as with exact n-gram sets in place of the Bloom filter; the held-out fold is not read."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for doc_id, text, lang, _, _ in messy_rows():
        if doc_id is not None and not held(doc_id) and lang is not None:
            own = counts.setdefault(lang, {})
            for t in plain_trigrams(text or ""):
                own[t] = own.get(t, 0) + 1
    sets = {lang: {t for t, n in c.items() if n >= L.MIN_SHARE * sum(c.values())} for lang, c in counts.items()}
    found = rows_of(L.identify(clashing))
    assert found == rows_of(L.identify(messy)) and len(found) == len(messy_rows())
    by_id = {r["doc_id"]: r for r in L.identify(messy).collect()}
    right = total = 0
    for doc_id, text, lang, _, _ in messy_rows():
        if doc_id is None:
            continue
        row = by_id[doc_id]
        assert row["held_out"] == held(doc_id) and 0 <= row["score"] <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        grams = plain_trigrams(text)
        share = {x: sum(t in s for t in grams) / max(1, len(grams)) for x, s in sets.items()}
        best = max(share.values())
        assert abs(row["score"] - best) < 0.02
        assert share[row["lang_pred"]] > best - 0.02
        if held(doc_id) and lang is not None and len(text) > 30:
            total += 1
            right += row["lang_pred"] == lang
    assert total > 10 and right / total > 0.9


def test_false_positives_are_corrected(spark):
    """A crowded filter still gives shares close to the exact ones."""
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3)) for _ in range(800)]
    rows = spark.createDataFrame([("aa", " ".join(words[:400])), ("bb", " ".join(words[400:]))], "lang string, text string")
    model = L.train(rows, min_share=1e-9, slots=1 << 12)
    assert model.false_rates.max() > 0.1
    strange = " ".join(chr(0x400 + a) + chr(0x400 + b) + chr(0x400 + c) for a, b, c in rng.integers(0, 30, (3000, 3)))
    assert L.coverage([strange], model).max() < 0.05


def test_many_languages(spark):
    rows = [(f"l{i:03d}", " ".join(chr(0x4E00 + 40 * i + j) * 3 for j in range(30))) for i in range(70)]
    model = L.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.masks.shape[0] == 2
    assert L.decide([t for _, t in rows], model)[0] == [x for x, _ in rows]


def test_empty_and_untrained(spark, no_docs, messy):
    assert L.identify(no_docs).collect() == [] and L.keep_identified(no_docs).collect() == []
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {"und"}


def test_pipeline_filter_keeps_columns_and_clean_rows(clashing):
    kept = L.keep_identified(clashing)
    assert kept.columns == clashing.columns
    ids = {r["doc_id"] for r in kept.collect()}
    # the text of 5 is labelled with two languages
    assert {121, 122, 123}.isdisjoint(ids) and set(range(120)) - {5} <= ids


def test_unclear_documents_go_and_large_scripts_stay(spark):
    """A tie of two languages and an unknown script go; a script of thousands of characters is judged by its own coverage."""
    rng = random.Random(12)
    chars = [chr(0x4E00 + i) for i in range(3000)]
    weights = [(i + 2) ** -1.3 for i in range(3000)]
    zh = ["".join(rng.choices(chars, weights, k=200)) for _ in range(120)]
    en = [prose(rng, "en", 40) for _ in range(120)]
    same = [prose(rng, "de", 40) for _ in range(120)]
    rows = [(i, t, "zh") for i, t in enumerate(zh)] + [(200 + i, t, "en") for i, t in enumerate(en)]
    rows += [(400 + i, t, lang) for i, t in enumerate(same) for lang in ("aa", "bb")]  # two languages, one set of texts
    rows += [(1000, "Ελληνικά γράμματα μόνο", None), (1001, "12 34", None), (1002, None, None), (1003, en[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_documents(docs)
    assert dict(zip(model.languages, model.mass))["zh"] < 0.5
    kept = {r["doc_id"] for r in L.keep_identified(docs).collect()}
    assert len([i for i in kept if i < 200]) > 110 and len([i for i in kept if 200 <= i < 400]) == 120
    assert not [i for i in kept if 400 <= i < 1000] and kept & {1000, 1001, 1002, 1003} == {1003}


def test_trigrams_held_by_a_task_are_bounded(monkeypatch):
    """Counts of many languages are passed on before they grow, and add up to the same."""
    rng = random.Random(2)
    frame = pd.DataFrame({"lang": [f"l{i % 30}" for i in range(300)], "text": [prose(rng, "fr", 20) for _ in range(300)]})
    whole = pd.concat(L._count_trigrams(iter([frame]))).groupby(["lang", "gram"])["n"].sum()
    monkeypatch.setattr(L, "_HELD_GRAMS", 500)
    parts = list(L._count_trigrams(iter([frame])))
    assert len(parts) >= 30 and pd.concat(parts).groupby(["lang", "gram"])["n"].sum().equals(whole)
