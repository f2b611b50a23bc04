"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (hashed
byte trigrams and shape statistics, none of them its length) and its page
metadata (language, source, length).  Over rounds each labels the unlabelled documents it is most sure of
for the other.  Both are then calibrated on labelled documents they were not
fitted on, and their log-odds add up (less the prior once) to the score of
every document.

Of the labelled documents at most ``PER_CLASS`` of each class are fitted on,
those with the smallest id hashes; offsets bring the log-odds back to the
classes' true shares.  All other rows are the pool, labelled or not: each round
scores them all by both views, and the fits on their pseudo-labels add up sums
that the tasks make.  Features are made once per document and stored; fitting
and scoring read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._util import U64, arrow_batches, discard, mix64, spans, stored
from ledgerlens.llm._words import range_hashes, separators, word_bounds

#: Labelled documents of a class that are fitted on, at most.
PER_CLASS = 2000
ROUNDS = 4
#: A pseudo-label needs this probability; a round exchanges at most this share of the pool per view and class.
CONFIDENT = 0.95
SHARE = 0.1
_RIDGES = (0.05, 1.0)
_STEPS = 8
#: Newton steps of a turn that measure the curvature; the others keep it and add up gradients only.
_CURVED = (0, 1, 4)
#: Log-odds are counted in bins of this width to find the share's cut.
_BIN, _FAR = 0.02, 30.0
THRESHOLD = 0.5
_GRAMS = 512
_SHAPE = 9
#: Bytes of texts that are looked at together; arrays of eight times as many are held.
_BYTES = 1 << 17
_META = 128
#: Documents that a task turns into features at once.
_BATCH_ROWS = 1000


# --- views ------------------------------------------------------------------

def text_view(texts: list[str]) -> np.ndarray:
    """Text features: hashed byte trigrams (square roots of shares) and shape statistics."""
    out = np.zeros((len(texts), _GRAMS + _SHAPE), np.float32)
    blobs = [t.encode("utf-8", "replace") for t in texts]
    for a, b in spans([len(x) for x in blobs], _BYTES):
        out[a:b] = _text_rows(blobs[a:b])
    return out


def _text_rows(blobs: list[bytes]) -> np.ndarray:
    n = len(blobs)
    buffer = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, blobs), np.int64, n)
    owner = np.repeat(np.arange(n), sizes + 1)
    wide = buffer.astype(np.uint32)
    packed = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    slot = ((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 9)).astype(np.int64)
    same = owner[:-2] == owner[2:]
    grams = np.bincount(owner[:-2][same] * _GRAMS + slot[same], minlength=n * _GRAMS).reshape(n, _GRAMS)
    grams = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))

    size = np.maximum(sizes, 1)
    lower, upper = (buffer >= 97) & (buffer <= 122), (buffer >= 65) & (buffer <= 90)
    digit, blank, other = (buffer >= 48) & (buffer <= 57), buffer <= 32, buffer >= 128
    share = [np.bincount(owner, weights=kind, minlength=n) / size
             for kind in (upper, digit, blank, other, ~(lower | upper | digit | blank | other))]
    starts, ends = word_bounds(buffer, separators(b" \t\n\r\x0b\x0c"))
    who = owner[starts] if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(who, minlength=n)
    hashes = range_hashes(buffer, starts, ends)
    again = np.bincount(who[1:], weights=(hashes[1:] == hashes[:-1]) & (who[1:] == who[:-1]), minlength=n) if len(who) else 0
    distinct = np.bincount(np.unique(np.stack((who.astype(np.uint64), hashes)), axis=1)[0].astype(np.int64),
                           minlength=n) if len(who) else np.zeros(n)
    length = np.bincount(who, weights=ends - starts, minlength=n) / np.maximum(words, 1)
    some = np.maximum(words, 1)
    # texts of unlike length compare by how far distinct words fall behind a square-root law
    stats = np.stack([*share, np.minimum(length, 30) / 10, again / some, distinct / some,
                      np.log1p(distinct) - 0.8 * np.log1p(words)], axis=1)
    return np.concatenate((grams, stats), axis=1).astype(np.float32)


def meta_view(lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """Metadata features: one slot per hashed language and source, one per length class; nulls have own slots."""
    n = len(lang)
    out = np.zeros((n, _META + 2), np.float32)
    rows = np.arange(n)
    for column, base, width in ((lang, 0, 32), (source, 32, 64)):
        codes, names = pd.factorize(column.astype("object"), use_na_sentinel=True)
        slots = np.array([int.from_bytes(str(x).encode()[-8:], "little") for x in names] + [0], np.uint64)
        slots = (mix64(slots + U64(1)) % U64(width - 1)).astype(np.int64) + 1
        slots[-1] = 0
        out[rows, base + slots[codes]] = 1
    chars = pd.to_numeric(n_chars, errors="coerce").to_numpy(np.float64)
    log = np.log1p(np.maximum(np.nan_to_num(chars), 0))
    out[rows, 96 + np.where(np.isnan(chars), 31, np.minimum(log * 2, 30).astype(np.int64))] = 1
    out[:, _META] = log / 10
    out[:, _META + 1] = (log / 10) ** 2
    return out


# --- logistic fits ----------------------------------------------------------

def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12, offset: float = 0.0) -> np.ndarray:
    """Ridge logistic regression (last weight: intercept) by Newton steps with conjugate gradients.

    ``offset`` is added to the log-odds of the rows and is no part of the weights.
    """
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(np.float32)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid((x @ w.astype(np.float32)).astype(np.float64) + offset)
        gradient = x.T @ (p - y).astype(np.float32) + penalty * w
        curve = np.maximum(p * (1 - p), 1e-6).astype(np.float32)
        step, r = np.zeros_like(w), -gradient
        d, norm = r.copy(), float(r @ r)
        goal = 1e-4 * norm
        for _ in range(40):
            if norm <= goal or norm < 1e-12:
                break
            hd = x.T @ (curve * (x @ d.astype(np.float32))) + penalty * d
            rate = norm / float(d @ hd)
            step += rate * d
            r -= rate * hd
            norm, before = float(r @ r), norm
            d = r + norm / before * d
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class CoTrained:
    """Weights of both views, their calibrations (slope, intercept) and the prior log-odds."""

    text: np.ndarray
    meta: np.ndarray
    calibrations: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    exchanged: tuple[int, int]


Views = tuple[np.ndarray, np.ndarray]
#: Adds up what a function gives for the blocks of the pool.
Sums = Callable[[Callable[[Views], np.ndarray]], np.ndarray]


@dataclass(frozen=True)
class _Turn:
    """Weights of both views after a fit and, per view, the log-odds (low, high) beyond which it gives labels."""

    weights: tuple[np.ndarray, np.ndarray]
    cuts: tuple[tuple[float, float], tuple[float, float]]


def given_labels(views: Views, turns: list[_Turn]) -> list[np.ndarray]:
    """Pseudo-labels (NaN: none) that the rows of a block have got for each view.

    They follow from the turns alone.  A row that either view has used is not given again.
    """
    n = len(views[0])
    given = [np.full(n, np.nan), np.full(n, np.nan)]
    for turn in turns:
        free = np.isnan(given[0]) & np.isnan(given[1])
        for v in (0, 1):
            z, (low, high) = logits(views[v], turn.weights[v]), turn.cuts[v]
            given[1 - v][free & (z >= high)] = 1.0
            given[1 - v][free & (z <= low)] = 0.0
    return given


def _histograms(turns: list[_Turn], weights: tuple[np.ndarray, np.ndarray]) -> Callable[[Views], np.ndarray]:
    bins = int(2 * _FAR / _BIN)

    def count(views: Views) -> np.ndarray:
        first, second = given_labels(views, turns)
        free = np.isnan(first) & np.isnan(second)
        return np.stack([np.bincount(np.clip(((logits(x[free], w) + _FAR) / _BIN).astype(np.int64), 0, bins - 1),
                                     minlength=bins) for x, w in zip(views, weights)]).astype(np.float64)

    return count


def _cuts(counts: np.ndarray, share: float, confident: float) -> tuple[float, float]:
    """Log-odds (low, high) of a view's pseudo-labels: confident, and ``share`` of the rows per class at most.

    A bin is taken whole or not at all, but the outermost one that has rows always is.
    """
    most, sure = max(share * counts.sum(), 1.0), float(np.log(confident / (1 - confident)))

    def inwards(c: np.ndarray) -> int:
        filled = np.flatnonzero(c)
        return max(int(np.searchsorted(np.cumsum(c), most, side="right")), int(filled[0]) + 1 if len(filled) else 0)

    low, high = -_FAR + inwards(counts) * _BIN, _FAR - inwards(counts[::-1]) * _BIN
    return min(low - 1e-9, -sure), max(high, sure)


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, offset: float = 0.0, curved: bool = True) -> np.ndarray:
    """Gradient and, if ``curved``, the upper triangle of the curvature of the rows' logistic loss."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(np.float32)
    p = _sigmoid((x @ w.astype(np.float32)).astype(np.float64) + offset)
    gradient = (x.T @ (p - y).astype(np.float32)).astype(np.float64)
    if not curved:
        return gradient
    bent = x * np.sqrt(np.maximum(p * (1 - p), 1e-6)).astype(np.float32)[:, None]
    return np.concatenate((gradient, (bent.T @ bent)[np.triu_indices(x.shape[1])])).astype(np.float64)


def _pool_slopes(turns: list[_Turn], weights: tuple[np.ndarray, np.ndarray], active: tuple[bool, bool],
                 curved: bool) -> Callable[[Views], np.ndarray]:
    def add(views: Views) -> np.ndarray:
        given = given_labels(views, turns)
        return np.concatenate([_slopes(x[~np.isnan(g)], g[~np.isnan(g)], w, curved=curved)
                               for x, g, w, on in zip(views, given, weights, active) if on])

    add.rough = curved  # half a million numbers: single floats do
    return add


def _counts(turns: list[_Turn]) -> Callable[[Views], np.ndarray]:
    return lambda views: np.array([float((~np.isnan(g)).sum()) for g in given_labels(views, turns)])


def _fit_turn(views: Views, label: np.ndarray, offset: float, pool: Sums, turns: list[_Turn],
              start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps of both views at once: sums over the labelled rows here, over the pool where it lies."""
    weights, active = [start[0].copy(), start[1].copy()], [True, True]
    curvature: list[np.ndarray | None] = [None, None]
    for number in range(_STEPS):
        curved = number in _CURVED
        total, at = pool(_pool_slopes(turns, (weights[0], weights[1]), (active[0], active[1]), curved)), 0
        for v in (0, 1):
            if not active[v]:
                continue
            n = len(weights[v])
            size = n + (n * (n + 1) // 2 if curved else 0)
            sums = total[at:at + size] + _slopes(views[v], label, weights[v], offset, curved)
            at += size
            penalty = np.full(n, _RIDGES[v])
            penalty[-1] = 1e-6
            if curved:
                whole = np.zeros((n, n))
                whole[np.triu_indices(n)] = sums[n:]
                curvature[v] = whole + np.triu(whole, 1).T + np.diag(penalty + 1e-6)
            step = np.linalg.solve(curvature[v], sums[:n] + penalty * weights[v])
            # a long step could leave the region where the curvature holds
            weights[v] -= step * min(1.0, 20 / max(np.abs(step).max(), 1e-12))
            active[v] = bool(np.abs(step).max() >= 1e-2)
        if not any(active):
            break
    return weights[0], weights[1]


def co_train_with(views: Views, label: np.ndarray, calibrate: np.ndarray, pool: Sums, true_odds: float | None = None,
                  rounds: int = ROUNDS, confident: float = CONFIDENT, share: float = SHARE) -> CoTrained | None:
    """Fit both views on labelled rows and a pool that is only seen through sums over its blocks.

    ``calibrate`` marks labelled rows kept for calibration; a class that one of
    the two parts lacks is taken from all rows.  ``true_odds`` are the log-odds of
    the classes where the rows come from, if the rows are no fair sample.  None if
    they hold one class only.
    """
    if len(np.unique(label)) < 2:
        return None
    fit, held = ~calibrate, calibrate.copy()
    for part in (fit, held):
        if len(np.unique(label[part])) < 2:
            part[:] = True
    rate = (label.sum() + 1) / (len(label) + 2)
    prior = float(np.log(rate / (1 - rate))) if true_odds is None else true_odds

    def beyond(part: np.ndarray) -> float:
        if true_odds is None:
            return 0.0
        return float(np.log(label[part].sum() / (1 - label[part]).sum())) - true_odds

    x = (views[0][fit], views[1][fit])
    y, offset = label[fit], beyond(fit)
    weights = tuple(fit_logistic(x[v], y, _RIDGES[v], offset=offset) for v in (0, 1))
    turns: list[_Turn] = []
    for _ in range(rounds):
        counts = pool(_histograms(turns, weights))
        cuts = tuple(_cuts(c, share, confident) for c in counts)
        edges = -_FAR + np.arange(counts.shape[1]) * _BIN
        if not any(c[(edges >= high - _BIN) | (edges <= low)].any() for c, (low, high) in zip(counts, cuts)):
            break  # nothing left that a view is sure of
        turns.append(_Turn(weights, cuts))
        weights = _fit_turn(x, y, offset, pool, turns, weights)
    given = pool(_counts(turns)) if turns else np.zeros(2)
    calibrations, offset = [], beyond(held)
    for v in (0, 1):
        w = fit_logistic(logits(views[v][held], weights[v])[:, None], label[held], 1e-2, offset=offset)
        calibrations.append((float(w[0]), float(w[1])))
    return CoTrained(weights[0], weights[1], tuple(calibrations), prior, (int(given[0]), int(given[1])))


def co_train(views: Views, label: np.ndarray, calibrate: np.ndarray, rounds: int = ROUNDS,
             confident: float = CONFIDENT, share: float = SHARE) -> CoTrained | None:
    """``co_train_with`` over rows in memory; ``label`` is 1, 0 or NaN (pool)."""
    known = ~np.isnan(label)
    block = (views[0][~known], views[1][~known])
    return co_train_with((views[0][known], views[1][known]), label[known], calibrate[known],
                         lambda part: part(block), None, rounds, confident, share)


def combine(text: np.ndarray, meta: np.ndarray, model: CoTrained) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the text view, the metadata view and both (independent views: log-odds add)."""
    (a1, b1), (a2, b2) = model.calibrations
    one, two = a1 * logits(text, model.text) + b1, a2 * logits(meta, model.meta) + b2
    return _sigmoid(one), _sigmoid(two), _sigmoid(one + two - model.prior)


# --- the operator -----------------------------------------------------------

_TEXT_WIDTH, _META_WIDTH = _GRAMS + _SHAPE, _META + 2
#: Rows of sums that reach the driver at most; parts of the pool that one task adds up, at most.
_FAN_IN, _PARTS = 16, 4


def _packed(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> list[bytes]:
    rows = np.concatenate((text_view([t or "" for t in texts]), meta_view(langs, sources, sizes)), axis=1)
    return [row.tobytes() for row in rows.astype(np.float16)]


def _unpacked(rows: pd.Series) -> Views:
    whole = np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), _TEXT_WIDTH + _META_WIDTH).astype(np.float32)
    return whole[:, :_TEXT_WIDTH], whole[:, _TEXT_WIDTH:]


def pool_sums(pool: DataFrame, tasks: int) -> Sums:
    """Sums over the blocks of ``pool(features)``: per task, then per ``_FAN_IN`` of these, until so few are left.

    A task takes up to ``_PARTS`` of the ``tasks`` parts, as its sums are as large as many rows, but every
    core has two tasks while there are so many parts.
    """
    cores = pool.sparkSession.sparkContext.defaultParallelism
    fewer = max(_FAN_IN, 2 * cores, -(-tasks // _PARTS))
    if fewer < tasks:
        pool, tasks = pool.coalesce(fewer), fewer

    def sums(part: Callable[[Views], np.ndarray]) -> np.ndarray:
        none = np.zeros((0, _TEXT_WIDTH), np.float32), np.zeros((0, _META_WIDTH), np.float32)
        shape, kind = part(none).shape, np.float32 if getattr(part, "rough", False) else np.float64

        def over_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, seen = np.zeros(shape), False
            for frame in frames:
                for a in range(0, len(frame), 2048):
                    total, seen = total + part(_unpacked(frame["features"].iloc[a:a + 2048])), True
            if seen:
                yield pd.DataFrame({"sums": [total.astype(kind).tobytes()]})

        def over_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, seen = np.zeros(shape), False
            for frame in frames:
                for blob in frame["sums"]:
                    total, seen = total + np.frombuffer(blob, kind).reshape(shape), True
            if seen:
                yield pd.DataFrame({"sums": [total.astype(kind).tobytes()]})

        found, left = pool.mapInPandas(over_rows, "sums binary"), tasks
        while left > _FAN_IN:
            left = -(-left // _FAN_IN)
            found = found.repartition(left).mapInPandas(over_sums, "sums binary")
        return sum((np.frombuffer(r["sums"], kind).reshape(shape).astype(np.float64) for r in found.collect()), np.zeros(shape))

    return sums


def with_features(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns and ``features`` (both views of a document, 16-bit floats) of every row, stored.

    A null text counts as empty, a null metadata field has a class of its own.
    """
    @F.pandas_udf("binary")
    def features(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series(_packed(texts, langs, sources, sizes))

    with arrow_batches(docs.sparkSession, _BATCH_ROWS):
        return stored(docs.select(*kept, features("text", "lang", "source", "n_chars").alias("features")), "quality-features")


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> CoTrained | None:
    """Co-train on the labels of documents in ``rows(doc_id, features)`` and on all other rows as the pool.

    An id has one label, the smallest; null ids and labels other than 0 and 1 do not count.  Of each
    class the ``per_class`` ids with the smallest hashes are fitted on, one row
    each; rows of other ids, labelled ones among them, are pool rows.  None if
    the labels of existing documents hold one class only.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(F.col(label).cast("double")).alias("label"))
    known = stored(known.join(rows.select("doc_id"), "doc_id", "left_semi"), "quality-known")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    place = F.xxhash64("doc_id")
    bad, good = (known.where(F.col("label") == side).orderBy(place, "doc_id").limit(per_class) for side in (0.0, 1.0))
    chosen = stored(bad.unionByName(good), "quality-sample")
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(  # 2 * per_class ids
        F.min("label").alias("label"), F.min("features").alias("features")).orderBy("label", place, "doc_id").toPandas()
    pool = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("features")
    label_values = sample["label"].to_numpy(np.float64)
    # the second of every four of a class, so that a class of two is in both parts
    held = sample.groupby("label").cumcount().to_numpy() % 4 == 1
    return co_train_with(_unpacked(sample["features"]), label_values, held, pool_sums(pool, rows.rdd.getNumPartitions()),
                         float(np.log(sizes[1.0] / sizes[0.0])))


def fit_documents(docs: DataFrame, labels: DataFrame, label: str = "quality",
                  per_class: int = PER_CLASS) -> CoTrained | None:
    """``fit`` over the features of ``docs``."""
    return fit(with_features(docs, F.col("doc_id")), labels, label, per_class)


def quality_column(features: Column, model: CoTrained | None) -> Column:
    """Struct (text_score, meta_score, score): probabilities of good quality; without a model 0.5 each."""

    @F.pandas_udf("text_score double, meta_score double, score double")
    def score(rows: pd.Series) -> pd.DataFrame:
        names = ("text_score", "meta_score", "score")
        if model is None:
            return pd.DataFrame({c: np.full(len(rows), 0.5) for c in names})
        parts = [combine(*_unpacked(rows.iloc[a:a + _BATCH_ROWS]), model) for a in range(0, len(rows), _BATCH_ROWS)]
        return pd.DataFrame({n: np.concatenate([p[i] for p in parts] or [np.zeros(0)]) for i, n in enumerate(names)})

    return score(features)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` of every document.

    Rows repeat as they occur; a document stays from ``threshold`` on.  With no
    usable labels all scores are 0.5 and all documents stay.  An empty table
    gives no rows; other columns are not read.
    """
    rows = with_features(docs, F.col("doc_id"))
    model = fit(rows, labels)
    return rows.select("doc_id", quality_column(F.col("features"), model).alias("q")).select(
        "doc_id", "q.text_score", "q.meta_score", "q.score", (F.col("q.score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score ``threshold`` or more; columns as they are.

    The documents are stored beside their features, so that both are read together again;
    the result is stored too, as its batches are kept small, and the first table goes.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = with_features(docs, F.col("doc_id"), whole)
    with arrow_batches(docs.sparkSession, _BATCH_ROWS):
        model = fit(rows.select("doc_id", "features"), labels)
        kept = stored(rows.select("row", quality_column(F.col("features"), model).alias("q")).where(
            F.col("q.score") >= threshold).select("row.*"), "quality-kept")
    discard(rows)
    return kept
