"""Approximate nearest neighbours by cosine over shifted Hilbert curves.

Several random projections map the vectors into small cubes; each cube is
shifted at random and walked by a Hilbert curve.  Per curve the rows are range
partitioned by key and get positions; a query looks at the rows whose position
is within a window around its own.  The windows of all curves are merged and
reranked by the exact cosine.  The window width is measured, not guessed: it is
the smallest that covers ``TARGET`` of the true neighbours of a bounded sample
of queries, so it follows the data (data without structure needs wide windows).

Equal vectors are collapsed before indexing and come back with their smallest
ids, so a vector that a third of the rows hold costs one index entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._util import U64, stored
from ledgerlens.llm.vectors import TopK, dimension, packed, unpack, usable

K = 5
CURVES = 8
PROJECTED = 6
BITS = 10
SAMPLE_ROWS = 4096
TUNING_QUERIES = 200
TARGET = 0.97
MIN_WINDOW = 256
SEGMENT_ROWS = 2048
#: Queries that are compared at once with the held vectors of a segment.
HELD_QUERIES = 1024
SEED = 20


# --- curves -----------------------------------------------------------------

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points on the Hilbert curve (transpose form, then interleaved)."""
    x = cells.astype(np.uint64).copy()
    n, dims = x.shape
    level = 1 << (bits - 1)
    while level > 1:
        low = U64(level - 1)
        for i in range(dims):
            high = (x[:, i] & U64(level)) != 0
            swap = np.where(high, U64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn, level = np.zeros(n, np.uint64), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[:, dims - 1] & U64(level)) != 0, U64(level - 1), U64(0))
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << U64(1)) | ((x[:, i] >> U64(bit)) & U64(1))
    return key.astype(np.int64)


class Curves:
    """Projections, quantile grids and shifts of all curves."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(dims, width)
        self.bits, self.planes, self.grids = bits, [], []
        for _ in range(curves):
            plane = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
            self.planes.append(plane)
            self.grids.append(np.sort(sample @ plane, axis=0))
        self.shifts = rng.random((curves, dims)) * 0.5

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        """One key per curve and unit vector: quantile of each projection, shifted, on the curve."""
        out = []
        for plane, grid, shift in zip(self.planes, self.grids, self.shifts):
            place = unit @ plane
            share = np.stack([np.searchsorted(grid[:, j], place[:, j]) / max(1, len(grid))
                              for j in range(place.shape[1])], axis=1)
            cells = np.minimum((share + shift) / 1.5 * (1 << self.bits), (1 << self.bits) - 1)
            out.append(hilbert_keys(cells.astype(np.int64), self.bits))
        return out


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


# --- index ------------------------------------------------------------------

def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``rep, v, ids``: each vector once, with its ``k + 1`` smallest ids (rep: the smallest).

    The rank limit is applied before the shuffle too, so a vector held by very
    many rows sends ``k + 1`` rows per task.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.select("v", "vec_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "v", "ids")


def _placed(reps: DataFrame, curves: Curves, dim: int) -> DataFrame:
    """``curve, pos, rep, v``: every vector with its position on every curve."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for curve, key in enumerate(curves.keys(_unit(unpack(frame["v"], dim)))):
                yield pd.DataFrame({"curve": curve, "key": key, "rep": frame["rep"], "v": frame["v"]})

    keyed = reps.select("rep", "v").mapInPandas(run, "curve int, key long, rep long, v binary")
    ordered = stored(
        keyed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
        .select("curve", "rep", "v", F.monotonically_increasing_id().alias("at")), "ann-order")
    # the number holds the partition in its upper bits and the row in the lower 33
    part = F.shiftright("at", 33)
    parts = ordered.groupBy("curve", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(parts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
                                 .alias("shift")), "ann-starts")  # one row per partition and curve
    return ordered.withColumn("part", part).join(starts, ["curve", "part"]).select(
        "curve", (F.col("at") + F.col("shift")).alias("pos"), "rep", "v")


# --- window width -----------------------------------------------------------

def _true_neighbours(reps: DataFrame, sample: pd.DataFrame, dim: int, k: int) -> DataFrame:
    """``a, b``: sample vectors and their exact ``k`` nearest others (all rows are compared)."""
    ids, matrix = sample["rep"].to_numpy(np.int64), unpack(sample["v"], dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = TopK(len(ids), k)
        for frame in frames:
            others = frame["rep"].to_numpy(np.int64)
            score = cosines(matrix, unpack(frame["v"], dim))
            score[ids[:, None] == others[None, :]] = -np.inf
            top.add(np.arange(len(ids)), score, others)
        row, other, score = top.found()
        yield pd.DataFrame({"a": ids[row], "b": other, "score": score})

    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    near = reps.select("rep", "v").mapInPandas(run, "a long, b long, score double")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("a", "b")


def window_rows(placed: DataFrame, reps: DataFrame, dim: int, k: int, target: float, queries: int) -> int:
    """Half-width of the window that covers ``target`` of the sample's true neighbours on some curve."""
    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep", F.lit("tune")), "rep").limit(queries).toPandas()
    near = stored(_true_neighbours(reps, sample, dim, k), "ann-near")  # at most queries * k rows
    ids = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
    places = stored(placed.select("curve", "pos", "rep").join(F.broadcast(ids), "rep"), "ann-tuned")
    a, b = (places.select("curve", F.col("rep").alias(x), F.col("pos").alias(f"pos_{x}")) for x in "ab")
    gaps = near.join(a, "a").join(b, ["b", "curve"]).groupBy("a", "b").agg(
        F.min(F.abs(F.col("pos_a") - F.col("pos_b"))).alias("gap"))
    found = np.sort(gaps.select("gap").toPandas()["gap"].to_numpy(np.int64))
    if not len(found):
        return MIN_WINDOW
    return max(MIN_WINDOW, int(found[min(len(found) - 1, math.ceil(target * len(found)) - 1)]))


# --- search -----------------------------------------------------------------

def _scan(window: int, k: int, dim: int):
    """Rows sorted by (curve, seg, the segment's vectors first, pos) to the best candidates per query and segment.

    The vectors of one segment are held; queries pass by in batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, waiting, held = None, [], None
        for frame in frames:
            keys = frame[["curve", "seg", "kind"]].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(frame)]):
                rows, key = frame.iloc[a:b], tuple(keys[a])
                if key[:2] != segment:
                    segment, waiting, held = key[:2], [], None
                if key[2] == 0:
                    waiting.append(rows)
                    continue
                if not waiting:
                    continue
                if held is None:
                    whole = pd.concat(waiting)
                    held = whole["rep"].to_numpy(np.int64), whole["pos"].to_numpy(np.int64), unpack(whole["v"], dim)
                for at in range(0, len(rows), HELD_QUERIES):
                    part = rows.iloc[at:at + HELD_QUERIES]
                    score = cosines(unpack(part["v"], dim), held[2])
                    score[np.abs(part["pos"].to_numpy(np.int64)[:, None] - held[1][None, :]) > window] = -np.inf
                    top = TopK(len(part), k + 1)
                    top.add(np.arange(len(part)), score, held[0])
                    row, other, value = top.found()
                    yield pd.DataFrame({"query": part["rep"].to_numpy(np.int64)[row], "rep": other, "score": value})

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, projected: int = PROJECTED,
            target: float = TARGET, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest found by cosine, ties to the smaller id.

    ``rows(vec_id, vector)``.  Null and zero vectors, vectors with a null or
    non-finite component and rows without ``vec_id`` take no part; shorter
    vectors count as filled up with zeros.  A query is never its own candidate
    (rows of its id).  A repeated row counts once; an id with several vectors asks
    with the first in byte order.  Empty tables give no rows.
    """
    spark = rows.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    clean = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector")
    dim = max(1, dimension(clean, "vector"))
    vectors = stored(packed(clean, dim).where("norm > 0").dropDuplicates(["vec_id", "v"]), "ann-vectors")
    asked = stored(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    if asked.isEmpty():
        return spark.createDataFrame([], empty)
    reps = stored(distinct_vectors(vectors, k), "ann-reps")
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("v").toPandas()
    placed = stored(_placed(reps, Curves(_unit(unpack(sample["v"], dim)), curves, projected, BITS, seed), dim),
                    "ann-placed")
    window = window_rows(placed, reps, dim, k, target, TUNING_QUERIES)

    # each distinct query vector searches once; its ids share the result
    mapped = stored(asked.join(reps.select("rep", "v"), "v").select("vec_id", "rep"), "ann-mapped")
    # segments have a fixed size; a query goes to those that its window covers, the table to one each
    seg = lambda at: F.floor(at / SEGMENT_ROWS)
    last = (reps.count() - 1) // SEGMENT_ROWS
    probes = placed.join(mapped.select("rep").distinct(), "rep", "left_semi").select(
        "curve", F.explode(F.sequence(seg(F.greatest(F.col("pos") - window, F.lit(0))),
                                      F.least(seg(F.col("pos") + window), F.lit(last).cast("long"))))
        .alias("seg"), F.lit(1).alias("kind"), "pos", "rep", "v")
    walked = placed.select("curve", seg(F.col("pos")).alias("seg"), F.lit(0).alias("kind"), "pos", "rep", "v")
    found = (walked.unionByName(probes).repartition("curve", "seg")
             .sortWithinPartitions("curve", "seg", "kind", "pos")
             .mapInPandas(_scan(window, k, dim), "query long, rep long, score double"))
    best = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = best.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r")
    listed = best.join(reps.select("rep", "ids"), "rep").select(
        "query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = stored(listed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
                    .select("query", "r", "score", "vec_id"), "ann-found")
    own = mapped.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    # every query holds its own id at most once among k + 1
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    others = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.join(lists, "query").select("query_id", F.posexplode(others).alias("rank", "one")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "one.vec_id", "one.score")
