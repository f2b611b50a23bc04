"""Exact top-k inner products over norm-sorted vectors.

Vectors are dealt into blocks by descending length.  Every query starts with a
threshold from the longest vectors; blocks whose length cannot reach any
threshold of a query group are never sent to it.  Inside a block an SVD
rotation puts most of the length into the first components: the partial
inner product plus the Cauchy-Schwarz bound of both residuals rules pairs out,
and only pairs that may still reach the threshold get their exact product.
Results are exact; rotation and bounds decide only how much is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._util import stored
from ledgerlens.llm.vectors import TopK, dimension, packed, unpack, usable

K = 10
SCALE = 1024.0
BLOCK_ROWS = 2048
#: Queries that one task holds while blocks stream past.
GROUP_QUERIES = 8192
#: Longest vectors that give the first thresholds, and vectors that the rotation is fitted on.
SEED_ROWS = 1024
SAMPLE_ROWS = 4096
HEAD_SHARE = 0.5


#: Longs that scores are held within; the one below stands for no score.
_LOWEST, _HIGHEST = -(1 << 63) + 1, (1 << 63) - 1


def exact_scores(queries: np.ndarray, block: np.ndarray, huge: bool = False) -> np.ndarray:
    """Integer inner products of whole-number matrices: doubles while these are exact, else longs."""
    if not huge:
        return queries @ block.T
    wide = np.vectorize(int, otypes=[object])
    # beyond doubles: Python integers, held within the range of a long
    score = wide(queries) @ wide(block).T
    return np.clip(score, _LOWEST, _HIGHEST).astype(np.int64)


def _exact_pairs(queries: np.ndarray, block: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        r, c = row[at:at + (1 << 16)], col[at:at + (1 << 16)]
        out[at:at + (1 << 16)] = np.einsum("ij,ij->i", queries[r], block[c])
    return out


class Searcher:
    """Queries of one group with their running results."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, bar: np.ndarray, rotation: np.ndarray, k: int, huge: bool = False):
        self.ids, self.matrix, self.seed, self.rotation = ids, matrix, bar, rotation
        self.norm = np.linalg.norm(matrix, axis=1)
        self.head = max(1, round(matrix.shape[1] * HEAD_SHARE))
        turned = matrix @ rotation
        self.front, self.rest = turned[:, :self.head], np.linalg.norm(turned[:, self.head:], axis=1)
        self.top = TopK(len(ids), k, np.int64 if huge else np.float64)
        self.huge = huge

    def offer(self, ids: np.ndarray, block: np.ndarray) -> None:
        """One block of candidates, longest first."""
        bar = np.maximum(self.seed, self.top.bar())
        length = np.linalg.norm(block, axis=1)
        with np.errstate(over="ignore", invalid="ignore"):  # lengths beyond doubles rule nothing out
            slack = 1e-9 * (1 + self.norm * length.max(initial=0))
            live = np.flatnonzero(~(self.norm * length.max(initial=0) + slack < bar))
            if not len(live):
                return
            turned = block @ self.rotation
            rest = np.linalg.norm(turned[:, self.head:], axis=1)
            bound = self.front[live] @ turned[:, :self.head].T + self.rest[live][:, None] * rest[None, :]
            may = ~(bound + slack[live][:, None] < bar[live][:, None])
        may &= ids[None, :] != self.ids[live][:, None]
        some = may.any(axis=1)
        live, may = live[some], may[some]
        if not len(live):
            return
        if not self.huge and may.mean() < 0.05:
            score = np.full(may.shape, -np.inf)
            row, col = np.nonzero(may)
            score[row, col] = _exact_pairs(self.matrix[live], block, row, col)
        else:
            score = np.where(may, exact_scores(self.matrix[live], block, self.huge), self.top.none)
        self.top.add(live, score, ids)


def _blocks(rows: int, dim: int):
    """Sorted rows to blocks (max_norm, ids, matrix); a row that repeats its predecessor is dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            ids, blobs = frame["vec_id"].to_numpy(np.int64), frame["v"].tolist()
            keep = []
            for i, pair in enumerate(zip(ids.tolist(), blobs)):
                if pair != last:
                    keep.append(i)
                last = pair
            norm = frame["norm"].to_numpy()[keep]
            ids, blobs = ids[keep], [blobs[i] for i in keep]
            out = [(float(norm[a]), ids[a:a + rows].tobytes(), b"".join(blobs[a:a + rows]))
                   for a in range(0, len(ids), rows)]
            yield pd.DataFrame(out, columns=["max_norm", "ids", "matrix"])

    return run


def _search(rotation: np.ndarray, k: int, dim: int, huge: bool):
    """Rows sorted by (g, h, queries first, longest block first) to candidates of each query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, waiting, searcher = None, [], None

        def results() -> pd.DataFrame:
            row, ids, score = searcher.top.found()
            return pd.DataFrame({"query_id": searcher.ids[row], "vec_id": ids, "score": [int(s) for s in score]})

        for frame in frames:
            for g, h, kind, bar, ids, matrix in frame[["g", "h", "kind", "bar", "ids", "matrix"]].itertuples(
                    index=False, name=None):
                if (g, h) != group:
                    if searcher is not None:
                        yield results()
                    group, waiting, searcher = (g, h), [], None
                ids = np.frombuffer(ids, ">i8" if kind == 0 else "<i8").astype(np.int64)
                matrix = np.frombuffer(matrix, np.float64).reshape(len(ids), dim)
                if kind == 0:
                    waiting.append((ids, matrix, np.full(len(ids), bar)))
                    continue
                if searcher is None:
                    if not waiting:
                        continue
                    searcher = Searcher(*(np.concatenate(x) for x in zip(*waiting)), rotation, k, huge)
                searcher.offer(ids, matrix)
        if searcher is not None:
            yield results()

    return run


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of a bounded sample (the rows with the smallest id hashes)."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()
    if sample.empty or dim == 0:
        return np.eye(dim)
    matrix = unpack(sample["v"], dim)
    return np.linalg.svd(matrix / max(1.0, np.abs(matrix).max()), full_matrices=True)[2].T


def top_inner_products(rows: DataFrame, is_query: Column, k: int = K, scale: float | None = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query.

    ``rows(vec_id, vector)``; components become floor(scale * x) first, so
    scores are whole numbers, exact whatever their size and then
    held within a long (a lower or higher score counts as its end).  Vectors that are null or
    hold a null or non-finite component, and rows without ``vec_id``, take no
    part; shorter vectors count as filled up with zeros.  A query is never its
    own candidate (rows of its id); ties go to the smaller id.  A repeated row
    counts once; an id with several vectors asks with the first in byte order
    and is a candidate with each.  Empty tables give no rows.
    """
    spark = rows.sparkSession
    clean = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    dim = max(1, dimension(clean, "vector"))
    vectors = stored(packed(clean.select("vec_id", "vector"), dim, scale), "mips-vectors")
    if vectors.where(is_query).isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # no sum of products is longer than the product of lengths: below 2**53 doubles hold them all
    longest = vectors.agg(F.max("norm")).first()[0]
    huge = not longest * longest < 2.0 ** 53
    rotation = _rotation(vectors, dim)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    seeds = vectors.orderBy(F.desc("norm"), "vec_id").limit(SEED_ROWS).toPandas()
    seed_ids, seed_matrix = seeds["vec_id"].to_numpy(np.int64), unpack(seeds["v"], dim)
    every, seed_index = np.unique(seed_ids, return_index=True)  # repeated rows must not raise a threshold

    def ready(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, matrix = frame["vec_id"].to_numpy(np.int64), unpack(frame["v"], dim)
            score = exact_scores(matrix, seed_matrix[seed_index], huge).astype(np.float64)
            score[every[None, :] == ids[:, None]] = -np.inf
            bar = np.sort(score, axis=1)[:, -k] if len(every) >= k else np.full(len(ids), -np.inf)
            if huge:  # scores below the range of a long count as its lower end
                bar = np.where(bar <= float(_LOWEST), -np.inf, bar)
            norm = np.linalg.norm(matrix, axis=1)
            # the length a candidate needs; a negative threshold rules nothing out
            reach = np.where((bar > 0) & (norm > 0) & np.isfinite(norm), bar / np.maximum(norm, 1e-300), 0.0)
            yield pd.DataFrame({"vec_id": ids, "v": frame["v"], "bar": bar, "reach": reach})

    asked = stored(queries.mapInPandas(ready, "vec_id long, v binary, bar double, reach double"), "mips-queries")
    groups = max(1, math.ceil(asked.count() / GROUP_QUERIES))
    grouped = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    # one number per GROUP_QUERIES queries: the shortest length any of them needs
    reach = {r["g"]: r["reach"] for r in grouped.groupBy("g").agg(
        (F.min("reach") * (1 - 1e-9)).alias("reach")).collect()}

    blocks = stored(
        vectors.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id", "v")
        .mapInPandas(_blocks(BLOCK_ROWS, dim), "max_norm double, ids binary, matrix binary"), "mips-blocks")
    # a query travels once per lane; groups of queries are parallel by themselves, so many of them need few lanes
    lanes = max(1, min(blocks.count(), math.ceil(4 * spark.sparkContext.defaultParallelism / groups)))
    lane = F.pmod(F.xxhash64("max_norm", "ids"), F.lit(lanes)).cast("int")
    needs = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(r).alias("reach")) for g, r in sorted(reach.items())])
    sent = blocks.withColumn("h", lane).select(
        F.explode(F.filter(needs, lambda x: x["reach"] <= F.col("max_norm"))).alias("to"),
        "h", "max_norm", "ids", "matrix").select(
        F.col("to.g").alias("g"), "h", F.lit(1).alias("kind"), F.col("max_norm").alias("bar"), "ids", "matrix")
    there = grouped.select(
        "g", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("h"), F.lit(0).alias("kind"), "bar",
        F.unhex(F.lpad(F.hex("vec_id"), 16, "0")).alias("ids"), F.col("v").alias("matrix"))
    found = (there.unionByName(sent).repartition("g", "h").sortWithinPartitions("g", "h", "kind", F.desc("bar"))
             .mapInPandas(_search(rotation, k, dim, huge), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


#: DuckDB twin over the embeddings table (queries: every 100th id, 10 results, scale 1024).
SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
