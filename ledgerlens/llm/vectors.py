"""Vector columns as packed doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null and has no null or non-finite component."""
    doubles = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """Longest vector; shorter ones count as filled up with zeros."""
    return int(rows.agg(F.max(F.size(vector))).first()[0] or 0)


def pack(arrays: pd.Series, dim: int) -> np.ndarray:
    """Matrix of doubles from a column of arrays."""
    out = np.zeros((len(arrays), dim))
    for i, a in enumerate(arrays):
        out[i, :len(a)] = a
    return out


def unpack(blobs: pd.Series, dim: int) -> np.ndarray:
    """Matrix of doubles from packed rows."""
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), dim)


def packed(rows: DataFrame, dim: int, scale_floor: float | None = None) -> DataFrame:
    """``vec_id, norm, v`` (v: packed doubles) of ``rows(vec_id, vector)``; optionally floor(scale * x)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            matrix = pack(frame["vector"], dim)
            if scale_floor is not None:
                matrix = np.floor(matrix * scale_floor)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "norm": np.linalg.norm(matrix, axis=1),
                                "v": [row.tobytes() for row in matrix]})

    return rows.mapInPandas(run, "vec_id long, norm double, v binary")


def no_score(kind: np.dtype):
    """What stands for no score: below every score of its kind."""
    return -np.inf if kind.kind == "f" else np.iinfo(np.int64).min


def _downwards(score: np.ndarray) -> np.ndarray:
    """Sorts the highest score first."""
    return -score if score.dtype.kind == "f" else ~score


def best_per_row(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` highest scores, ties to the smaller id."""
    given = score > no_score(score.dtype)
    if score.shape[1] > k:
        bar = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        given &= score >= bar
    row, col = np.nonzero(given)
    order = np.lexsort((ids[row, col], _downwards(score[row, col]), row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


class TopK:
    """Running best ``k`` of each row, highest score first, ties to the smaller id; scores are doubles or longs."""

    def __init__(self, rows: int, k: int, kind: type = np.float64):
        self.k, self.none = k, no_score(np.dtype(kind))
        self.score = np.full((rows, k), self.none, kind)
        self.ids = np.full((rows, k), np.iinfo(np.int64).max)

    def bar(self) -> np.ndarray:
        """The score a new candidate has to reach in each row, as a double (none at the lower end of longs)."""
        last = self.score[:, -1]
        return np.where(last <= self.none + 1, -np.inf, last.astype(np.float64))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer the candidates ``ids`` (one score per given row and candidate, or none)."""
        r, c = best_per_row(score, np.broadcast_to(ids, score.shape), self.k)
        new_score = np.full((len(rows), self.k), self.none, self.score.dtype)
        new_ids = np.full((len(rows), self.k), np.iinfo(np.int64).max)
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        new_score[r, rank], new_ids[r, rank] = score[r, c], ids[c]
        both_score = np.concatenate((self.score[rows], new_score), axis=1)
        both_ids = np.concatenate((self.ids[rows], new_ids), axis=1)
        order = np.lexsort((both_ids, _downwards(both_score)), axis=1)[:, :self.k]
        self.score[rows] = np.take_along_axis(both_score, order, axis=1)
        self.ids[rows] = np.take_along_axis(both_ids, order, axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of everything held."""
        row, col = np.nonzero(self.score > self.none)
        return row, self.ids[row, col], self.score[row, col]
