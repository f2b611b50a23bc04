from __future__ import annotations

import os
import random
import subprocess
import sys
import tracemalloc

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as C
from ledgerlens.llm import language_id, mixing, piece_sampling, quality, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, C.stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "language_id":
            assert sizes[-1] == language_id.identify(before).where("lang_pred <> 'und' and score >= 0.3").count()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert sizes[-1] == quality.score_documents(before, labels).where("keep").count()
        if name == "simhash_dedup":
            assert sizes[-1] == simhash_dedup.simhash_components(before).select("component_id").distinct().count()
        if name == "mixing":
            assert sizes[-1] == mixing.mix_documents(before).agg({"copies": "sum"}).first()[0]
    assert sizes[0] > sizes[2] > sizes[3] and sizes[4] > sizes[3]
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == sizes[-1] and all(r["lossless"] for r in last)
    whole = C.run(spark, SF).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, last))


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Language training and the documents' fingerprints get 1,000 texts at a time, and the session's setting stays."""
    def counted(frames):
        for frame in frames:
            assert len(frame) <= 1000
            yield from count(iter([frame]))

    def hashed(text, words, seed):
        @F.pandas_udf("long")
        def bounded(texts: pd.Series) -> pd.Series:
            assert len(texts) <= 1000
            return pd.Series([one(t, words, seed) for t in texts], dtype="int64")
        return bounded(text)

    count, one = language_id._count_trigrams, simhash_dedup.fingerprint
    monkeypatch.setattr(language_id, "_count_trigrams", counted)
    monkeypatch.setattr(simhash_dedup, "fingerprint_column", hashed)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "concat('some words ', id % 9) as text", "'en' as lang")
    assert language_id.train(docs).languages == ("en",)
    assert 0 < simhash_dedup.keep_one_of_each(docs).count() <= 9
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_filters_hold_few_texts_and_leave_no_features(spark, monkeypatch):
    """The language filter gets 1,000 texts at a time too, and features are gone once the documents are chosen."""
    def bounded(texts, *rest):
        assert len(texts) <= 1000
        return identified(texts, *rest)

    def kept_features(docs, *kept):
        tables.append(with_features(docs, *kept))
        return tables[-1]

    identified, with_features, tables = language_id.identified, quality.with_features, []
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "concat('some words ', id % 9) as text", "'en' as lang",
                                                 "'s' as source", "12L as n_chars")
    monkeypatch.setattr(language_id, "identified", bounded)
    assert language_id.keep_identified(docs).count() == 2500
    monkeypatch.setattr(quality, "with_features", kept_features)
    labels = spark.range(0, 40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    kept = quality.keep_good(docs, labels)
    folder = tables[0].inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert not os.path.exists(folder)
    assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").count() == 0


def test_rest_imports_without_this_package():
    """The entry module works when the subpackage and the pipeline cannot be found."""
    code = ("import sys, importlib.abc\n"
            "class Hide(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('ledgerlens.llm'):\n"
            "            raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Hide())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\n"
            "assert e.oracle_sql()\n")
    root = os.path.dirname(os.path.abspath(C.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})


def test_encoding_gets_few_texts_and_holds_few_lattices(spark, monkeypatch):
    """The encoding stage gets 1,000 texts at a time, and a worker's lattices stay small however many words it meets."""
    def bounded(vocabulary):
        def run(frames):
            for frame in frames:
                assert len(frame) <= 1000
                yield from encode(vocabulary)(iter([frame]))
        return run

    encode = piece_sampling._encode
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", "concat('some words ', id % 9) as text")
    whole = piece_sampling.encode_documents(docs).collect()
    monkeypatch.setattr(piece_sampling, "_encode", bounded)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = C.encoding_stage(spark, docs, SF)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, whole)) and len(whole) == 2500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

    vocabulary = piece_sampling.load_vocabulary(piece_sampling.model_path())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(1000)) for _ in range(200)]
    frame = pd.DataFrame({"doc_id": [str(i) for i in range(200)], "text": texts, "key": range(200)})
    body = encode(vocabulary)(iter([frame]))
    rows = len(next(body))  # the trie is made
    tracemalloc.start()
    try:
        for part in body:
            assert part["lossless"].all()
            rows += len(part)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 200
    assert peak < 150e6, peak
