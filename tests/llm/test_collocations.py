from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ledgerlens.llm import collocations as C
from tests.llm.conftest import messy_rows

DOCS = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, longest=4):
    """All phrases of up to ``longest`` words per language, and words in all."""
    found, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text or "")):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                found.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return found, words


def plain(rows, min_count, top, cover=80):
    found, words = plain_counts(rows)
    often = {p: a for p, a in found.items() if a >= min_count}
    kept = []
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        cuts = [(2_000_000 * a // (found[lang, w[:k]] + found[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        around = [b for (l2, v), b in often.items() if l2 == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= cover * a for b in around):
            kept.append((lang, -score, -a, " ".join(w).encode(), found[lang, w[:k]], found[lang, w[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, words[lang], -score))
    return out


def corpus():
    """Phrases of all lengths, some rare in all shards but one, tabs, pieces, odd white space, nulls, copies."""
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma", "delta", "eps", "zeta", "nul\x00", "é", "nb sp", "a-b"]
    rows = []
    for i in range(260):
        text = [rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", "\r\n", " "]) for _ in range(rng.randint(0, 25))]
        if i % 3 == 0:
            text.append("new york city hall ")
        if i % 40 == 0:
            text.append("rare deep pair " * 9)
        if i % 5 == 0:
            text.append("a a a a a a; ")
        rows.append((i, "".join(text), rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(300, None, "en"), (301, "", None), (302, " \t\n.,", "fr"), (None, "new york city hall", "en")]
    rows += [rows[3]] * 40
    return rows


@pytest.mark.parametrize("min_count,shards", [(6, 3), (30, 4), (9, 1)])
def test_same_as_brute_force(spark, min_count, shards):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = C.collocations(docs, min_count=min_count, shards=shards, top=40).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain(rows, min_count, 40))


def test_lengths_interleave(spark):
    """With every phrase frequent in every shard, longer ones start before shorter ones are complete."""
    rows = [(i, "one two three four five", "en") for i in range(900)]
    counted = C.count_phrases(spark.createDataFrame(rows, DOCS).repartition(6), shards=3)
    assert counted.steps == 6  # four lengths one after the other would take twelve
    assert {(r["phrase"], r["a"]) for r in counted.phrases.where("len > 2").collect()} == {
        ("one two three", 900), ("two three four", 900), ("three four five", 900),
        ("one two three four", 900), ("two three four five", 900)}


def test_messy_clashing_and_empty(spark, clashing, no_docs):
    assert C.collocations(no_docs).collect() == []
    found = C.collocations(clashing, min_count=4, top=25).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain([(r[0], r[1], r[2]) for r in messy_rows()], 4, 25))


def test_long_texts_are_counted_part_by_part(monkeypatch):
    """Texts that are cut into many parts and rows give the counts of the whole."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["ab", "cd", "ef", "gh.", "ij"]) for _ in range(3000))
    texts = [("en", long), ("fr", "ab cd ef"), ("en", "ef ab"), ("en", "x" * 900), ("fr", long), ("en", "")]
    monkeypatch.setattr(C, "_BYTES", 64)
    monkeypatch.setattr(C, "_WORDS", 50)
    rows = pa.RecordBatch.from_pydict({"lang": [x for x, _ in texts], "text": [x for _, x in texts],
                                       "shard": pa.array([i % 2 for i in range(len(texts))], pa.int32())})
    made = pa.Table.from_batches(C._coded(0)(iter([rows]))).to_pylist()
    names = {r["id"]: (r["lang"], r["word"]) for r in made if r["shard"] == -1}
    full = np.full(1 << 10, 255, np.uint8)  # a full filter holds nothing back
    found = Counter()
    for shard in (0, 1):
        parts = [np.frombuffer(r["ids"], np.int64) for r in made if r["shard"] == shard]
        assert len(parts) > (20 if shard == 0 else 0)
        for batch in C.counted_rows(np.concatenate(parts), C.Active(True, full, full, 4)):
            for r in batch.to_pylist():
                words = [names[r[c]] for c in "abcd" if r[c]]
                found[words[0][0], tuple(w for _, w in words)] += r["n"]
    assert found == plain_counts([(0, t, lang) for lang, t in texts])[0]


def test_words_that_share_a_number_are_numbered_anew(spark, monkeypatch):
    rows = [(i, "one two three", "en") for i in range(40)]
    taken = []

    def coded_with(salt, real=C._coded):
        taken.append(salt)
        body = real(salt)

        def run(batches):
            for batch in body(batches):
                if salt == 0:  # every word has the same number
                    at = batch.schema.get_field_index("id")
                    batch = batch.set_column(at, "id", pa.array([None if x is None else 5 for x in batch.column("id").to_pylist()], pa.int64()))
                yield batch

        return run

    monkeypatch.setattr(C, "_coded", coded_with)
    found = C.collocations(spark.createDataFrame(rows, DOCS)).collect()
    assert taken == [0, 1] and [(r["phrase"], r["a"]) for r in found] == [("one two three", 40)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_few_and_many_candidates_give_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "BROADCAST_ROWS", rows)
    corpus_ = corpus()
    found = C.collocations(spark.createDataFrame(corpus_, DOCS), min_count=12, top=30).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain(corpus_, 12, 30))


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, n)) + (0,) * (4 - n) for n in (1, 2, 3, 4) for _ in range(50)]
    made = C.filter_of(spark.createDataFrame(rows, "a long, b long, c long, d long"), 1 << 16)
    columns = [np.array(c) for c in zip(*rows)]
    assert C.held(made, C.phrase_hashes(columns)).all()
    others = C.phrase_hashes([rng.integers(1, 2 ** 62, 500), *[np.zeros(500, np.int64)] * 3])
    assert C.held(made, others).sum() < 5
    assert not C.filter_of(spark.createDataFrame([], "a long, b long, c long, d long"), 1 << 16).any()


def test_scores_are_exact_beyond_64_bits(spark):
    a = 2 ** 62 + 1
    rows = [("en", 1, "x", a + 1), ("en", 1, "y", a + 2), ("en", 2, "x y", a)]
    counted = C.Counted(spark.createDataFrame(rows, "lang string, len int, phrase string, a long"), None, 0)
    found = C.scored(counted).first()
    assert found["score"] == 2_000_000 * a // (2 * a + 3)


def test_rare_pairs_are_never_counted(spark, monkeypatch):
    """Of frequent words in mostly rare pairs, only the pairs that reach the threshold are counted."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(words, 20)) + ". fixed pair", "en") for i in range(120)]
    kept = {}

    def recorded(df, name, real=C.stored):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(C, "stored", recorded)
    found = C.collocations(spark.createDataFrame(rows, DOCS).repartition(3), top=30).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain(rows, 30, 30)) != []
    longer = [df.where("b <> 0").count() for name, df in kept.items() if name.startswith("phrases-counts-")]
    assert 3 <= sum(longer) < 50


def test_pairs_are_tallied_exactly_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "_BLOCK", 8)  # many blocks
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(-6, 7, 200), 0).astype(np.int64) for _ in range(40)]
    runs = [np.concatenate(texts[i:i + 8]) for i in range(0, 40, 8)]
    seen = Counter((int(a), int(b)) for t in texts for a, b in zip(t, t[1:]) if a and b)
    assert min(seen.values()) < 45 < max(seen.values())
    docs = spark.createDataFrame([(bytearray(t.tobytes()),) for t in runs], "ids binary").repartition(3)
    found = {r["h"] for r in C.frequent_pairs(docs, 45).collect()}
    often = [p for p, n in seen.items() if n >= 45]
    assert found == set(C.phrase_hashes([np.array(c) for c in zip(*often)]).view(np.int64).tolist())
    assert C.frequent_pairs(docs.where("false"), 45).count() == 0


def test_rows_of_coded_texts_stay_short():
    """Texts as numbers come in rows of about a megabyte, so that no batch of them fills a worker."""
    texts = ["one two three. four five six"] * 60_000
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts), pa.array([i % 3 for i in range(len(texts))], pa.int32())],
                                       ["lang", "text", "shard"])
    sizes, words = [], 0
    for out in C._coded(0)(iter([batch])):
        for ids in out.column("ids").to_pylist():
            if ids is not None:
                sizes.append(len(ids))
                words += int((np.frombuffer(ids, np.int64) != C._STOP).sum())
    assert words == 6 * len(texts) and max(sizes) <= 9 * C._ROW_WORDS <= 9 << 17


def test_filters_are_looked_up_by_parts(monkeypatch):
    hashes = C.mix64(np.arange(1, 1001, dtype=np.uint64))
    marks = np.frombuffer(np.random.default_rng(1).bytes(1 << 10), np.uint8)
    whole = C.held(marks, hashes)
    monkeypatch.setattr(C, "_LOOKED_UP", 7)
    assert 0 < whole.sum() < 1000 and (C.held(marks, hashes) == whole).all()


def test_steps_are_read_by_one_scan(spark):
    """The plan over many steps is as short as over one, and gives the rows of the steps asked for only."""
    table = C.Steps(spark, "some")
    for step in range(12):
        table.add(step, spark.range(step).withColumn("t", F.lit(step)))
    few, many = table.read([11]), table.read(range(1, 12))
    assert Counter(r["t"] for r in many.collect()) == {t: t for t in range(1, 12)}
    assert few.count() == 11 and table.read([0]).count() == 0

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan")  # noqa: SLF001

    assert scans(many) == scans(few) == 1


@pytest.mark.parametrize("step", [0, 1, 4])
def test_words_and_phrases_reach_the_threshold_together(spark, step):
    """From its parts' steps on a phrase counts; words need no parts; what was supported before is not found again."""
    counts, every = C.Steps(spark, "c"), C.Steps(spark, "e")
    shape, known = "a long, b long, c long, d long, n long, t int", "a long, b long, c long, d long, since int, reach int"
    for t in range(step + 1):
        rows = [(5, 0, 0, 0, 9, t), (6, 0, 0, 0, 1, t), (1, 2, 0, 0, 9, t), (1, 2, 3, 0, 9, t), (1, 2, 4, 0, 9, t), (7, 8, 0, 0, 9, t)]
        counts.add(t, spark.createDataFrame(rows, shape))
        before = [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (7, 0, 0, 0, 0, 0)] if t == 0 else [
            (1, 2, 0, 0, 1, 3), (2, 3, 0, 0, 1, 2)] if t == 3 else []
        every.add(t, spark.createDataFrame(before, known))
    found = {tuple(r) for r in C._reached(counts, every, 9, 3, 3, step).collect()}
    assert found == {0: {(5, 0, 0, 0, 0)}, 1: {(5, 0, 0, 0, 0), (1, 2, 0, 0, 1)}, 4: {(1, 2, 3, 0, 4)}}[step]
