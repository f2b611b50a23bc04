from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing as M
from tests.llm.conftest import messy_rows, rows_of


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * left / total >= cap * sizes[s]}
        if not full:
            return target | {s: weight[s] * left / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
        left, open_ = left - sum(target[s] for s in full), open_ - full
    return target


def test_targets_and_sizes(messy):
    rows = M.mix_documents(messy).collect()
    assert len(rows) == len(messy_rows())
    sizes = {}
    for r in messy_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").replace("\x00", "0").split())
    expected = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for source, target in expected.items():
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6


def test_sql_twin(messy):
    con = duckdb.connect()
    con.register("documents", messy.toArrow())
    expected = sorted(con.execute(M.SQL).fetchall(), key=repr)
    assert rows_of(M.mix_documents(messy).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")) == expected


def test_reruns_agree_and_clashing_columns_survive(clashing):
    first = rows_of(M.mix_documents(clashing))
    assert rows_of(M.mix_documents(clashing.repartition(5))) == first
    corpus = M.mixed_corpus(clashing)
    assert corpus.columns == clashing.columns
    copies = sum(r["copies"] for r in M.mix_documents(clashing).collect())
    assert corpus.count() == copies


def test_empty_table(no_docs):
    assert M.mix_documents(no_docs).collect() == [] and M.mixed_corpus(no_docs).collect() == []


def test_unequal_weights_follow_inclusion_probabilities(spark):
    """Among many documents of one weight the share that is taken is their expected copies."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"),
                                    F.lit("a").alias("source"), (1 + F.col("id") % 3).cast("double").alias("w"))
    taken = {w: 0 for w in (1, 2, 3)}
    for r in M.mix_documents(docs, share=0.5, weight_col="w").collect():
        taken[1 + r["doc_id"] % 3] += r["copies"]
    assert {w: n / 2000 for w, n in taken.items()} == pytest.approx({1: 0.25, 2: 0.5, 3: 0.75}, abs=0.04)
    assert sum(taken.values()) == 3000


def test_weights_above_the_cap_make_up_elsewhere(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", 100.0 if i == 0 else 1.0) for i in range(50)],
                                 "doc_id long, text string, source string, w double")
    rows = M.mix_documents(docs, share=1.0, weight_col="w").collect()
    assert {r["doc_id"]: r["copies"] for r in rows}[0] == 2
    assert sum(r["taken"] for r in rows) == 500
