"""License scan and piece sampling."""

from __future__ import annotations

import collections
import random
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import license_scan as L
from ledgerlens.llm import piece_sampling as P
from tests.llm.conftest import messy_rows, prose, rows_of


# --- license scan -----------------------------------------------------------

def plain_matches(scanner, text):
    """Every window of the grid, compared exactly."""
    words = L.words_of(text or "")
    shingles = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    out = []
    for name, own in zip(scanner.names, scanner.shingles):
        group, best = scanner.classes[len(own)], None
        for a in range(0, len(shingles), group.stride):
            share = len(own & set(shingles[a:a + group.width])) / len(own)
            if share >= 0.8 - 1e-12 and (best is None or share > best[0]):
                best = share, a, min(a + group.width, len(shingles)) + 4 - a
        if best:
            out.append((name, *best))
    return out


def licensed_rows():
    rng, rows = random.Random(9), []
    for i in range(150):
        text = prose(rng, "en", rng.randint(0, 200)).split(" ")
        for _ in range(rng.randint(0, 2)):
            notice = rng.choice(L.TEMPLATES)[1].upper().split()
            for _ in range(rng.randint(0, 4)):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(text))
            text = text[:at] + notice + text[at:]
        rows.append((i, " ".join(text)))
    rows += [(200, None), (201, ""), (202, "Released under the MIT"), (None, "Released under the MIT License."),
             (2 ** 60 + 1, "Released under the MIT License."), rows[5], rows[5],
             (203, "Released under the MIT License. " * 3000)]
    return rows


def test_matches_equal_brute_force(spark):
    docs = spark.createDataFrame(licensed_rows(), "doc_id long, text string").withColumn("license", F.lit("x"))
    scanner = L.Scanner(L.TEMPLATES)
    expected = [(i, *m) for i, text in licensed_rows() for m in plain_matches(scanner, text)]
    assert rows_of(L.find_licenses(docs)) == sorted(expected, key=repr) and len(expected) > 80
    assert L.find_licenses(docs.limit(0)).collect() == []


def test_band_settings_guarantee_retrieval():
    for n in (1, 3, 8, 50, 200):
        group = L.SizeClass(n, 0.8, 2, 0.9999)
        assert group.width >= n + group.stride - 1 and group.need / n >= 0.8 - 1e-9
        assert 1 - (1 - group.lowest ** 2) ** group.bands >= 0.9999


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        L.Scanner([("x", "only four words here")])


def test_every_notice_line_of_the_documents_is_found(spark):
    """The five notice lines that the given documents hold, counted by their words in a row."""
    lines = {"GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "All rights reserved": "All rights reserved.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
             "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = {(r["doc_id"], name) for r in docs.collect() for name, line in lines.items() if line in (r["text"] or "")}
    found = {(r["doc_id"], r["license"]) for r in L.find_licenses(docs).collect()}
    assert expected <= found and {name for _, name in expected} == set(lines)


def test_short_notices_are_runs_of_words(spark):
    texts = ["x ALL rights,\nreserved", "all rights are reserved", "overall rights reserved", "all rights reservedé", "All rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(L.find_licenses(docs)) == [(0, "All rights reserved", 1.0, 1, 3), (4, "All rights reserved", 1.0, 0, 3)]


def test_whole_license_texts_are_found(spark):
    """Whole texts inside a document, of the licenses that are usual."""
    wanted = ["Apache-2.0 text", "CC0-1.0 text", "GPL-2 text", "GPL-3 text", "LGPL-2.1 text", "LGPL-3 text", "MPL-2.0 text",
              "LGPL notice", "AGPL notice", "MPL-2.0 notice", "EPL-2.0 notice", "Unlicense", "CC-BY-SA-4.0"]
    notice = dict(L.TEMPLATES)
    rows = [(i, f"some words before it {notice[name].lower()} and some behind") for i, name in enumerate(wanted)]
    found = {(r["doc_id"], r["license"]): r["containment"] for r in L.find_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i, name] == 1 for i, name in enumerate(wanted))


# --- piece sampling ---------------------------------------------------------

VOCABULARY = P.load_vocabulary(P.model_path())
TRIE, DECODE = P.Trie(VOCABULARY), P.Decoder(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4), st.integers(-2 ** 63, 2 ** 63 - 1))
def test_round_trip_of_any_text(texts, key):
    texts = [t.encode("utf-8", "replace").decode() for t in texts] + ["▁ a▁  <0x41>\n\t", "  ", " x "]
    ids = P.encode_batch(texts, np.full(len(texts), key), VOCABULARY, TRIE)
    assert [DECODE(i) for i in ids] == texts
    alone = P.encode_batch(texts[:1], np.full(1, key), VOCABULARY, TRIE)
    assert alone[0].tolist() == ids[0].tolist()


@pytest.mark.parametrize("long", [128, 1])
def test_draws_follow_the_lattice(monkeypatch, long):
    """Frequencies over many keys against all segmentations listed one by one; also as a long word."""
    monkeypatch.setattr(P, "_LONG", long)
    word, number = "▁thing", {VOCABULARY.pieces[i]: i for i in np.flatnonzero(VOCABULARY.normal)}

    def cuts(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in number:
                for rest, weight in cuts(end):
                    yield (number[word[at:end]], *rest), weight + VOCABULARY.weight[number[word[at:end]]]

    every = dict(cuts(0))
    total = np.logaddexp.reduce(list(every.values()))
    n = 40_000 if long > 1 else 4_000
    drawn = collections.Counter(tuple(x.tolist()) for x in P.encode_batch(["thing"] * n, np.arange(n), VOCABULARY, TRIE))
    assert set(drawn) <= set(every) and len(drawn) >= 3
    for pieces, weight in every.items():
        p = np.exp(weight - total)
        assert abs(drawn[pieces] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_documents(spark, messy, clashing, no_docs):
    encoded = P.encode_documents(clashing)
    rows = encoded.collect()
    assert len(rows) == len(messy_rows())
    assert all(r["lossless"] is (None if r["ids"] is None else True) for r in rows)
    assert sorted(r["n_pieces"] for r in rows) == sorted(len(r["ids"] or ()) for r in rows)
    back = P.decoded_column(F.col("ids"), VOCABULARY)
    joined = encoded.select("doc_id", back.alias("text"))
    assert rows_of(joined) == rows_of(messy.select("doc_id", "text"))
    again = P.encode_documents(messy.repartition(3))
    assert rows_of(again) == rows_of(encoded)
    assert P.encode_documents(no_docs).collect() == []


def test_temperature_flattens_draws():
    hot = P.load_vocabulary(P.model_path(), temperature=4.0)
    texts, keys = ["something interesting happened there"] * 300, np.arange(300)
    count = lambda v: len({tuple(x.tolist()) for x in P.encode_batch(texts, keys, v, P.Trie(v))})
    assert count(hot) > count(VOCABULARY)


UNSPACED = {
    "letters": lambda rng, n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=range(26, 0, -1), k=n)),
    "cjk": lambda rng, n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
    "mixed": lambda rng, n: "".join(rng.choices(["th", "e", "▁", "é", "\U0001F600", "\n", "==", "0"], k=n // 2)),
    "spaces": lambda rng, n: " " * n, "one": lambda rng, n: "a" * n}


@pytest.mark.parametrize("kind", UNSPACED)
def test_long_words_have_the_sums_of_the_lattice(monkeypatch, kind):
    """Stretches and segments joined by their starts give the forward sums of one lattice over the whole word."""
    monkeypatch.setattr(P, "_SEGMENT", 700)
    monkeypatch.setattr(P, "_STRETCH", 64)
    text = UNSPACED[kind](random.Random(3), 2000)
    word = P.LongWord(" " + text, VOCABULARY, TRIE)
    monkeypatch.setattr(P, "_LONG", 1 << 60)
    lattice = P.Lattice([" " + text], VOCABULARY, TRIE)
    assert word.total == pytest.approx(lattice.total, abs=1e-6)
    tokens = word.sample(77)
    assert DECODE(tokens) == text and tokens.tolist() == P.LongWord(" " + text, VOCABULARY, TRIE).sample(77).tolist()
    assert tokens.tolist() != word.sample(78).tolist() or kind == "cjk"


def test_long_words_do_not_depend_on_the_batch():
    rng = random.Random(6)
    texts = ["short text", UNSPACED["letters"](rng, 5000) + " and " + UNSPACED["cjk"](rng, 3000), "x " * 50]
    together = P.encode_batch(texts, np.arange(3), VOCABULARY, TRIE)
    sampler = P.Sampler(VOCABULARY, TRIE)
    sampler(["and other words x"], np.arange(1))
    alone = [sampler([t], np.array([i]))[0] for i, t in enumerate(texts)]
    assert [a.tolist() for a in alone] == [b.tolist() for b in together] and [DECODE(i) for i in together] == texts


def test_kept_lattices_start_over(monkeypatch):
    rng, texts = random.Random(8), []
    for _ in range(6):
        texts.append([prose(rng, "en", 30) for _ in range(3)])
    whole = [P.encode_batch(t, np.arange(3), VOCABULARY, TRIE) for t in texts]
    monkeypatch.setattr(P, "_KEPT_CHARS", 200)
    sampler = P.Sampler(VOCABULARY, TRIE)
    assert [[x.tolist() for x in sampler(t, np.arange(3))] for t in texts] == [[x.tolist() for x in w] for w in whole]


@pytest.mark.parametrize("kind", ["letters", "cjk"])
def test_text_without_spaces_keeps_up(kind):
    """A million characters without a space take at most twice the time per byte of spaced text, in little memory."""
    rng = random.Random(1)
    unspaced = UNSPACED[kind](rng, 1_000_000 if kind == "letters" else 340_000)
    spaced = " ".join(UNSPACED["letters"](rng, rng.randint(2, 12)) for _ in range(130_000))
    sampler = P.Sampler(VOCABULARY, TRIE)
    sampler(["warm up " + spaced[:9000], unspaced[:9000]], np.arange(2))

    def rate(text):
        best = 1e9
        for _ in range(2):
            fresh, start = P.Sampler(VOCABULARY, TRIE), time.process_time()
            fresh([text], np.arange(1))
            best = min(best, time.process_time() - start)
        return best / len(text.encode())

    assert rate(unspaced) < 2 * rate(spaced)
    tracemalloc.start()
    P.Sampler(VOCABULARY, TRIE)([unspaced], np.arange(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_common_words_are_not_forgotten(monkeypatch):
    """A common word is learned when it is met and once for good; a rare one anew in every period."""
    learned, lattice = collections.Counter(), P.Lattice

    def noted(words, *rest):
        learned.update(words)
        return lattice(words, *rest)

    monkeypatch.setattr(P, "Lattice", noted)
    monkeypatch.setattr(P, "_KEPT_CHARS", 200)
    rng, sampler = random.Random(4), P.Sampler(VOCABULARY, TRIE)
    for i in range(12):
        rare = " ".join(UNSPACED["letters"](rng, 12) for _ in range(15))
        text = "common " * 5 + "seldom " * (i % 3 == 1) + rare
        assert DECODE(sampler([text], np.array([i]))[0]) == text
    assert learned[" common"] == 2 and learned[" seldom"] > 2
