from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality as Q
from tests.llm.conftest import messy_rows, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, "en", rng.randint(20, 80)).capitalize() + "."
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.split())
        rows.append((i, text, "en", "forum" if not good and rng.random() < 0.6 else "news", len(text)))
        if i % 3:
            labels.append((i, int(good), 0))
    truth = {r[0]: "##" not in r[1] and "$$$" not in r[1] and "!!" not in r[1] for r in rows}
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, LABELS), truth)


def test_unlabelled_documents_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    found = {r["doc_id"]: r for r in Q.score_documents(docs, labels).collect()}
    unseen = [i for i in truth if i % 3 == 0]
    assert np.mean([found[i]["keep"] == truth[i] for i in unseen]) > 0.97
    assert all(0 <= found[i][c] <= 1 for i in found for c in ("text_score", "meta_score", "score"))


def test_views_exchange_pseudo_labels():
    """A view that is sure teaches the other: with few labels the weaker view learns from the pool."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 800)
    strong = (y * 2 - 1)[:, None] * 2.0 + rng.normal(size=(800, 1))
    weak = np.concatenate((((y * 2 - 1)[:, None] * 0.7 + rng.normal(size=(800, 12))), rng.normal(size=(800, 20))), axis=1)
    label = np.where(np.arange(800) < 60, y.astype(float), np.nan)
    fold = np.arange(800) % 4 == 0
    args = (strong.astype(np.float32), weak.astype(np.float32)), label, fold
    alone, taught = Q.co_train(*args, rounds=0), Q.co_train(*args, rounds=4)
    assert taught.exchanged[1] > 50 and alone.exchanged == (0, 0)
    right = lambda m: np.mean((Q.logits(weak, m.meta) > 0)[60:] == y[60:])
    assert right(taught) > right(alone)


def test_logistic_fit_has_zero_gradient():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1, -2, 0, 0.5, 0]))).astype(float)
    w = Q.fit_logistic(x, y, 1.0)
    p = 1 / (1 + np.exp(-Q.logits(x, w)))
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_text_features_do_not_depend_on_neighbours():
    texts = [r[1] or "" for r in messy_rows()][:40]
    whole = Q.text_view(texts)
    assert whole == pytest.approx(np.concatenate([Q.text_view([t]) for t in texts]), abs=1e-6)


def test_messy_rows_and_missing_labels(spark, messy, clashing, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, None), (3, 0, 1)], LABELS)
    assert Q.score_documents(clashing, labels).count() == len(messy_rows())
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["keep"]) for r in Q.score_documents(messy, none).collect()} == {(0.5, True)}
    kept = Q.keep_good(clashing, none)
    assert kept.columns == clashing.columns and kept.count() == len(messy_rows())
    assert Q.score_documents(no_docs, labels).collect() == [] and Q.keep_good(no_docs, none).collect() == []
    assert Q.score_documents(messy.withColumn("lang", F.lit(None).cast("string")), labels).count() == len(messy_rows())


def short_corpus(spark, ids, bad):
    rng, rows = random.Random(5), []
    for i in ids:
        text = prose(rng, "en", 8)
        rows.append((i, text.replace(" ", "### ") + "$$$" if i in bad else text, "en", "forum" if i in bad else "news", len(text)))
    return rows, "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_pool_takes_part(spark):
    """The exchange grows with the unlabelled table: more than 2,000 pseudo-labels per view on 9,000 rows."""
    bad = set(range(0, 9200, 3))
    rows, schema = short_corpus(spark, range(9200), bad)
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in range(200)], LABELS)
    model = Q.fit_documents(spark.createDataFrame(rows, schema), labels)
    assert min(model.exchanged) > 2000 and sum(model.exchanged) <= 2 * 9000
    few = Q.fit_documents(spark.createDataFrame(rows[:1100], schema), labels)
    assert 0 < max(few.exchanged) <= 900


def by_hash(spark, n):
    return [r[0] for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]


def test_rare_class_reaches_the_fit(spark):
    """Bad labels whose ids hash last are sampled all the same, and absent documents use up no place."""
    order = by_hash(spark, 5000)
    bad = set(order[-40:])
    rows, schema = short_corpus(spark, range(5000), bad)
    labels = [(i, int(i not in bad), 0) for i in range(5000)] + [(i, 1, 0) for i in range(10_000, 15_000)]
    found = Q.score_documents(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, LABELS)).collect()
    kept = {r["doc_id"] for r in found if r["keep"]}
    assert len(bad - kept) >= 38 and len(kept) > 4900


def test_repeated_id_takes_one_place(spark):
    order = by_hash(spark, 300)
    bad = set(order[1::2])
    rows, schema = short_corpus(spark, range(300), bad)
    rows += [rows[order[0]]] * 9000
    labels = [(i, int(i not in bad), 0) for i in range(200)]
    model = Q.fit_documents(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, LABELS))
    assert model is not None


def test_two_bad_labels_are_enough(spark):
    rows, schema = short_corpus(spark, range(300), {3, 4})
    labels = [(i, int(i not in (3, 4)), 0) for i in range(300)]
    assert Q.fit_documents(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, LABELS)) is not None


def test_pooled_fit_equals_one_process_fit(spark, monkeypatch):
    """Sums made by many tasks and added up over a tree give the weights of a fit in one process."""
    bad = set(range(0, 3000, 3))
    rows, schema = short_corpus(spark, range(3000), bad)
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in range(120)], LABELS)
    monkeypatch.setattr(Q, "_FAN_IN", 3)  # several levels of the tree
    docs = spark.createDataFrame(rows, schema).repartition(20)
    found = Q.fit_documents(docs, labels)

    frame = docs.toPandas()
    views = Q._unpacked(pd.Series(Q._packed(frame["text"], frame["lang"], frame["source"], frame["n_chars"])))
    order = {i: k for k, i in enumerate(by_hash(spark, 120))}
    frame["label"] = [float(i not in bad) if i < 120 else np.nan for i in frame["doc_id"]]
    sample = frame[frame["doc_id"] < 120].copy()
    sample["place"] = sample["doc_id"].map(order)
    sample = sample.sort_values(["label", "place"])
    at, rest = sample.index.to_numpy(), frame.index[frame["doc_id"] >= 120].to_numpy()
    held = sample.groupby("label").cumcount().to_numpy() % 4 == 1
    y = sample["label"].to_numpy()
    block = views[0][rest], views[1][rest]
    alone = Q.co_train_with((views[0][at], views[1][at]), y, held, lambda part: part(block),
                            float(np.log(y.sum() / (1 - y).sum())))
    assert found.exchanged == alone.exchanged and min(alone.exchanged) > 500
    assert found.text == pytest.approx(alone.text, abs=1e-3) and found.meta == pytest.approx(alone.meta, abs=1e-3)
    one, two = Q.combine(*block, found)[2], Q.combine(*block, alone)[2]
    assert np.abs(one - two).max() < 1e-4


def test_views_share_no_feature():
    """Length belongs to the metadata view: a text said ten times as often has about the same text features."""
    text = "one two three four five six seven eight nine ten "
    once, many = Q.text_view([text * 400, text * 4000])
    assert np.abs(once[:-1] - many[:-1]).max() < 0.01  # the last one compares distinct words with all words
    assert Q.text_view([text]).shape[1] == Q._GRAMS + Q._SHAPE


def test_pool_sums_join_parts_of_the_pool():
    """Many small parts are added up by fewer tasks, so that few sums are passed on; a few parts stay as they are."""
    class Pool:
        def __init__(self):
            self.dealt = []

        sparkSession = sparkContext = property(lambda self: self)
        defaultParallelism = 6

        def coalesce(self, n):
            self.dealt.append(("coalesce", n))
            return self

        def repartition(self, n):
            self.dealt.append(("repartition", n))
            return self

        def mapInPandas(self, function, schema):
            return self

        def collect(self):
            return []

    dealt = {}
    for tasks in (10, 40, 100):
        pool = Pool()
        Q.pool_sums(pool, tasks)(lambda views: np.zeros(3))
        dealt[tasks] = pool.dealt
    assert dealt == {10: [], 40: [("coalesce", 16)], 100: [("coalesce", 25), ("repartition", 2)]}


def test_pool_sums_of_many_parts(spark):
    rows = [(bytes(np.full(Q._TEXT_WIDTH + Q._META_WIDTH, i % 3, np.float16).tobytes()),) for i in range(300)]
    pool = spark.createDataFrame(rows, "features binary").repartition(80)
    sums = Q.pool_sums(pool, 80)(lambda views: np.array([len(views[0]), views[0][:, 0].sum()], np.float64))
    assert sums.tolist() == [300.0, 300.0]
