from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm import merkle_manifest as M
from tests.llm.conftest import DOCS, messy_rows, rows_of


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(enc(doc_id), enc(source), enc(lang), enc(n_chars), enc(text))


def tree(hashes):
    """Root and, per leaf, its list of (siblings before, siblings after), bottom-up."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i:i + 8] for i in range(0, len(hashes), 8)]
        for leaf, node in enumerate(at):
            run = runs[node // 8]
            paths[leaf].append(("".join(run[:node % 8]), "".join(run[node % 8 + 1:])))
        hashes, at = [sha(*run) for run in runs], [node // 8 for node in at]
    return hashes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        doc_id, text = row[0], row[1]
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if hit else text
        groups[row[2]].append((doc_id, leaf_of(row, text), leaf_of(row, lowered)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees[name] = tree([leaf for _, leaf, _ in groups[name]])
    if not names:
        return []
    root, above = tree([trees[name][0] for name in names])
    out = []
    for name, beyond in zip(names, above):
        subroot, paths = trees[name]
        for (doc_id, leaf, bent), path in zip(groups[name], paths):
            end = bent
            for left, right in path + beyond:
                end = sha(left, end, right)
            proof = sha(*[left + right for left, right in path + beyond])
            out.append((doc_id, leaf, subroot, root, proof, end, end == root))
    return sorted(out, key=repr)


def test_messy_documents(spark, clashing):
    assert rows_of(M.manifest(clashing)) == plain(messy_rows())


def test_empty_single_and_many_groups(spark, no_docs):
    assert M.manifest(no_docs).collect() == []
    one = [(7, "Only ONE", "en", None, 8)]
    assert rows_of(M.manifest(spark.createDataFrame(one, DOCS))) == plain(one)
    many = [(i, f"Text {i}", f"l{i % 70}" if i % 70 else None, "s", i) for i in range(220)]
    found = rows_of(M.manifest(spark.createDataFrame(many, DOCS)))
    assert found == plain(many) and {r[6] for r in found} == {True, False}


def test_one_group_over_several_stretches_and_hot_rows(spark):
    """More leaves than a window stretch, a third of them equal rows with a null id."""
    rows = [(None, "Same", "en", "s", 4)] * 700 + [(i, f"Text {i}", "en", "s", i) for i in range(1400)]
    found = M.manifest(spark.createDataFrame(rows, DOCS).repartition(7))
    assert rows_of(found) == plain(rows)


def test_windows_cover_bounded_stretches(spark, messy):
    """Every window is partitioned by group and stretch: no task holds a whole group."""
    nodes = messy.select(F.lit(0).alias("g"), F.lit(200).alias("size"), F.col("doc_id").alias("i"), F.col("text").alias("h"))
    plan = M.with_siblings(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "stretch" in plan.split("Window")[1]
    assert "SinglePartition" not in plan
