from __future__ import annotations

import time
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import simhash_dedup as S
from tests.llm.conftest import messy_rows, rows_of


def plain_fingerprint(text, words=4, seed=42):
    """The definition, word by word."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    fps = [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups.setdefault(find(i), []).append(r[0])
    return [(r[0], f"{fp:016x}", min(groups.get(find(i), []), default=None)) for i, (r, fp) in enumerate(zip(rows, fps))]


def test_components_match_brute_force(messy, clashing):
    expected = sorted(plain_components(messy_rows()), key=repr)
    assert rows_of(S.simhash_components(messy)) == expected
    assert rows_of(S.simhash_components(clashing)) == expected


def test_one_document_of_each_component_stays(clashing):
    kept = S.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    found = plain_components(messy_rows())
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(c) for c in {c for *_, c in found})


def test_empty_table(no_docs):
    assert S.simhash_components(no_docs).collect() == []
    assert S.keep_one_of_each(no_docs).collect() == []


def test_null_ids_only(spark, messy):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "a B")], "doc_id long, text string")
    assert rows_of(S.simhash_components(rows).select("component_id")) == [(None,)] * 3
    assert S.keep_one_of_each(rows).count() == 1


def plain_links(values, radius):
    return {(i, j) for i in range(len(values)) for j in range(len(values))
            if i != j and int(np.bitwise_count(values[i] ^ values[j])) <= radius}


@settings(max_examples=15, deadline=None)
@given(st.integers(2, 150), st.integers(0, 7), st.integers(0, 2 ** 32 - 1))
def test_bit_sliced_links_are_exact(n, radius, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2 ** 64, 3, dtype=np.uint64)
    values = base[rng.integers(0, 3, n)]
    for _ in range(6):
        values = np.where(rng.random(n) < 0.5, values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), values)
    found = {(a, b) for i, j in S.links_between(values, values, radius) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert found == plain_links(values, radius)
    group = np.sort(rng.integers(0, 4, n))
    pairs = {(a, b) for i, j in S.links_in_small_groups(values, group, int(np.bincount(group).max()), radius)
             for a, b in zip(i.tolist(), j.tolist())}
    assert pairs == {(i, j) for i, j in plain_links(values, radius) if i < j and group[i] == group[j]}


def test_cut_buckets_lose_no_link(spark):
    """A bucket far above the chunk size is compared in pairs of chunks."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2 ** 62))
    values = sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 62, 5)) for _ in range(300)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = _roots(values)
    for chunk in (64, 1 << 20):
        edges = S.link_forest(fps, 4, chunk)
        members = {r["node"]: r["root"] for r in S.components(edges).collect()}
        assert {v: members.get(v, v) for v in values} == expected


def _roots(values):
    array = np.array(values, np.int64).view(np.uint64)
    parent = np.arange(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4)
        parent = S.forest(parent, np.full(len(near), i), near)
    return {v: values[p] for v, p in zip(values, parent)}


def test_every_linked_pair_shares_a_bucket():
    bounds = S.block_bounds(4)
    assert sum(w for _, w in bounds) == 64 and bounds[0][0] == 0 and len(bounds) == 6


def test_many_null_ids_do_not_meet_each_other(spark):
    """8,000 rows with a null id take about the time of 8,000 ids, and one row per component stays."""
    def timed(ids):
        rows = [(i, " ".join(f"w{k}x{j}" for j in range(8))) for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        start = time.perf_counter()
        n = S.keep_one_of_each(df).count()
        return n, time.perf_counter() - start

    timed(range(500))
    distinct, plain = timed(range(8000))
    nulls, slow = timed([None] * 8000)
    assert distinct == nulls and slow < 2 * plain + 5


def test_documents_meet_words_of_winners(spark, monkeypatch):
    """64 documents in a row share one row of the table of winners; the documents that stay are the same."""
    sizes, stored = {}, S.stored

    def noted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(S, "stored", noted)
    rows = [(i, f"text number {i % 700} of some {i % 700 * 7919} more {i % 700 * 104729} words") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    kept = sorted(r.doc_id for r in S.keep_one_of_each(docs).collect())
    assert kept == sorted({component for _, _, component in plain_components(rows)})
    assert sizes["simhash-winners"] <= 1000 // 64 + 1 < len(kept)
