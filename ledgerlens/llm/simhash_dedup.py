"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made per document, collapsed to distinct values, and dealt
into buckets that agree on two of six bit blocks (radius 4: at least two blocks
of any linked pair are equal, so no link is missed).  Inside a bucket the
fingerprints are stored as 64 vertical bit planes; distances of many pairs grow
together in carry-save counters, and a block is abandoned as soon as all of its
pairs exceed the radius.  A bucket emits a spanning forest of its links, never
its pairs; the forests are joined by star contractions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._components import components
from ledgerlens.llm._util import U64, arrow_batches, forest, stored

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
# Rows of a bucket that one task compares; larger buckets are cut into pairs of chunks.
CHUNK = 16384
_TILE = 256
#: Hashes of a text that are held at once.
_HASHES = 1 << 15
#: Documents that a task fingerprints at once, where whole rows pass it.
_BATCH_ROWS = 1000
_ONES = U64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -----------------------------------------------------------

def shingle_hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle, repeats included, some thousands at a time; the whole text if it has fewer words."""
    tokens = text.encode().lower().split()  # bytes: only A-Z fall, only ASCII space splits
    count = max(1, len(tokens) - words + 1) if tokens else 0
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, _HASHES):
        part = tokens[at:min(at + _HASHES, count) + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[words - 1:] if len(part) >= words else ends[-1:]
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist())], np.uint64)


def majority(blocks: Iterator[np.ndarray]) -> int:
    """64 bits, each set if set in over half of the hashes (none: zero)."""
    counts, total = np.zeros(64, np.int64), 0
    for part in blocks:
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > total))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text as a signed long; null and word-free texts give zero."""
    value = majority(shingle_hashes(text or "", words, seed))
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """Arrow UDF over whole texts."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return simhash(text)


# --- bit-sliced comparison --------------------------------------------------

def bit_planes(values: np.ndarray) -> np.ndarray:
    """Vertical layout: row ``b`` packs bit ``b`` of 64 values into each word; padding is zero."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.T, axis=1, bitorder="little")
    pad = -planes.shape[1] % 8
    return np.ascontiguousarray(np.pad(planes, ((0, 0), (0, pad)))).view("<u8").astype(np.uint64)


def near_mask(differences: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Lanes whose set bits over all difference planes number at most ``radius``.

    ``radius + 1`` lives in vertical counters of as many planes as it has bits;
    a carry out of the highest sticks.  Every eight planes the block is
    abandoned (None) if no lane is within the radius any more.
    """
    width = (radius + 1).bit_length()
    counter: list[np.ndarray] = []
    over: np.ndarray | None = None
    for at, carry in enumerate(differences, 1):
        if over is None:
            counter = [np.zeros_like(carry) for _ in range(width)]
            over = np.zeros_like(carry)
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if at % 8 == 0:
            far = over | _at_least(counter, radius + 1)
            if (far == _ONES).all():
                return None
    return None if over is None else ~(over | _at_least(counter, radius + 1))


def _at_least(counter: list[np.ndarray], bound: int) -> np.ndarray:
    """Lanes whose vertical count is ``bound`` or more (compared from the top bit)."""
    more, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for k in range(len(counter) - 1, -1, -1):
        if bound >> k & 1:
            equal &= counter[k]
        else:
            more |= equal & counter[k]
            equal &= ~counter[k]
    return more | equal


def _lanes(mask: np.ndarray, n: int) -> np.ndarray:
    """Booleans of the first ``n`` lanes in each row of a mask of words."""
    flat = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=-1, bitorder="little")
    return flat[..., :n].astype(bool)


def links_between(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(i, j)`` with ``a[i]`` and ``b[j]`` within ``radius``, tile by tile."""
    for right in range(0, len(b), 64 * 64):
        block = b[right:right + 64 * 64]
        planes = bit_planes(block)
        for left in range(0, len(a), _TILE):
            rows = a[left:left + _TILE]
            diff = (planes[k][None, :] ^ np.where((rows >> U64(k)) & U64(1), _ONES, U64(0))[:, None]
                    for k in range(64))
            mask = near_mask(diff, radius)
            if mask is not None:
                i, j = np.nonzero(_lanes(mask, len(block)))
                if len(i):
                    yield i + left, j + right


def links_in_small_groups(values: np.ndarray, group: np.ndarray, largest: int,
                          radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of many small groups at once: lanes are pairs at distance 1, 2, ... in sorted order."""
    for step in range(1, largest):
        at = np.flatnonzero(group[step:] == group[:-step])
        for part in range(0, len(at), 1 << 18):
            left = at[part:part + (1 << 18)]
            planes = bit_planes(values[left] ^ values[left + step])
            mask = near_mask(iter(planes), radius)
            if mask is not None:
                near = left[_lanes(mask, len(left))]
                if len(near):
                    yield near, near + step


# --- buckets ----------------------------------------------------------------

def block_bounds(radius: int) -> list[tuple[int, int]]:
    """``radius + 2`` bit blocks (offset, width): two of them are equal in any linked pair."""
    n = radius + 2
    widths = [64 // n + (k < 64 % n) for k in range(n)]
    return list(zip(itertools.accumulate([0, *widths[:-1]]), widths))


def _bucket_keys(fp: Column, radius: int) -> Column:
    keys = []
    pairs = itertools.combinations(block_bounds(radius), 2)
    for kind, ((o1, w1), (o2, w2)) in enumerate(pairs):
        part = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
                for o, w in ((o1, w1), (o2, w2))]
        keys.append(F.struct(F.lit(kind).alias("kind"),
                             F.shiftleft(part[0], w2).bitwiseOR(part[1]).alias("bits")))
    return F.array(*keys)


def _forest_of_groups(radius: int):
    """``mapInPandas`` body: sorted rows (kind, bits, ci, cj, side, fp) to forest edges (u, v)."""

    def whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["kind", "bits", "ci", "cj"]].to_numpy()
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = frame.iloc[cut:]
            if cut:
                yield frame.iloc[:cut]
        if rest is not None and len(rest):
            yield rest

    def edges(values: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"u": values[child].view(np.int64), "v": values[parent[child]].view(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames):
            key = frame[["kind", "bits", "ci", "cj"]].to_numpy()
            values = frame["fp"].to_numpy(np.int64).view(np.uint64)
            side = frame["side"].to_numpy()
            new = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            small = (sizes[group] <= 64) & (side == 0)
            two = np.bincount(group, weights=side) > 0
            small &= ~two[group]
            small &= sizes[group] > 1
            if small.any():
                v, g = values[small], group[small]
                parent = np.arange(len(v))
                for i, j in links_in_small_groups(v, g, int(sizes[g].max()), radius):
                    parent = forest(parent, i, j)
                yield edges(v, parent)
            starts = np.flatnonzero(new)
            for g in np.flatnonzero((sizes > 64) | two):
                v = values[starts[g]:starts[g] + sizes[g]]
                s = side[starts[g]:starts[g] + sizes[g]]
                left, right = (np.flatnonzero(s == 0), np.flatnonzero(s == 1)) if two[g] else (
                    np.arange(len(v)), np.arange(len(v)))
                parent = np.arange(len(v))
                for i, j in links_between(v[left], v[right], radius):
                    parent = forest(parent, left[i], right[j])
                yield edges(v, parent)

    return run


def link_forest(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the distinct fingerprints linked within ``radius``.

    ``fps`` holds each fingerprint once.  A bucket above ``chunk`` rows is cut
    by a hash into chunks, and every pair of chunks is a group of its own, so
    no task holds more than two chunks and no pair is skipped.
    """
    keyed = fps.select("fp", F.explode(_bucket_keys(F.col("fp"), radius)).alias("k")).select(
        F.col("k.kind").alias("kind"), F.col("k.bits").alias("bits"), "fp")
    hot = stored(
        keyed.groupBy("kind", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
        .select("kind", "bits", F.ceil(F.col("n") * 2 / chunk).cast("int").alias("cuts")), "simhash-hot")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    if hot.isEmpty():  # no bucket needs cutting: the same groups without the join
        grouped = keyed.select("kind", "bits", F.lit(0).alias("ci"), F.lit(0).alias("cj"),
                               F.lit(0).alias("side"), "fp")
    else:
        cut = (keyed.join(hot, ["kind", "bits"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
               .withColumn("own", own).withColumn("other", other))
        grouped = cut.select(
            "kind", "bits", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    return (grouped.repartition("kind", "bits", "ci", "cj")
            .sortWithinPartitions("kind", "bits", "ci", "cj", "side", "fp")
            .mapInPandas(_forest_of_groups(radius), "u long, v long"))


# --- the operator -----------------------------------------------------------

def fingerprint_components(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` for the fingerprints of ``hashed(fp)`` that have a link to another one."""
    return components(link_forest(hashed.select("fp").distinct(), radius))


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                       seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, fingerprint (16 hex digits), component_id``.

    Null, empty and word-free texts have fingerprint zero and link like any
    other; a text with fewer than ``words`` words is one shingle.  Repeated
    rows come back as often as they occur.  A null ``doc_id`` is ignored when
    the smallest id is sought (a component of null ids only has a null
    ``component_id``).  An empty table gives no rows; other columns are not read.
    """
    hashed = stored(docs.select("doc_id", fingerprint_column(F.col("text"), words, seed).alias("fp")), "simhash")
    members = stored(fingerprint_components(hashed, radius), "simhash-members")
    per_fp = hashed.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = per_fp.join(members, per_fp.fp == members.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = stored(rooted.join(lows, "root").select("fp", "component_id"), "simhash-ids")
    return hashed.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                     seed: int = SEED) -> DataFrame:
    """``docs`` without near-duplicates: the document with the smallest id of each component stays.

    Of rows that repeat that id and fingerprint one stays; a component of null
    ids keeps one row.  All columns come back as they are, whatever their names.
    The documents are stored beside their fingerprints and a row number, and
    winners are row numbers, so joins neither multiply nor depend on ids.  64
    row numbers in a row make one word of bits, so that few rows meet the documents.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    with arrow_batches(docs.sparkSession, _BATCH_ROWS):
        rows = stored(docs.select(whole, F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("at"),
                                  fingerprint_column(F.col("text"), words, seed).alias("fp")), "simhash-rows")
    members = stored(fingerprint_components(rows, radius), "simhash-members")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "at")
    per_fp = rows.groupBy("fp").agg(F.min(order).alias("low"))
    winners = (per_fp.join(members, per_fp.fp == members.node, "left")
               .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low"))
               .select(F.col("low.at").alias("at")))
    word, bit = F.shiftright("at", 6).alias("word"), F.col("at").bitwiseAND(63).cast("int")
    words = stored(winners.groupBy(word).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), "simhash-winners")
    return rows.join(words, F.shiftright("at", 6) == F.col("word")).where(F.getbit("bits", bit) == 1).select("row.*")
