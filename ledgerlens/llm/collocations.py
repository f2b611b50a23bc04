"""Phrase collocations by dynamic itemset counting.

Documents are dealt into shards that are scanned in turn, round and round.
Lengths are not counted one after the other: a phrase becomes active after the
step at whose end both its subphrases (without the last and without the first
word) have reached the threshold, it is counted from the next step on, whatever
shard that is, and it is complete when every shard has been scanned once since.
Counting ends when no phrase is active.

Texts are split into words once.  A word is a 64-bit hash of its language and its
letters from then on, and a phrase up to four of these numbers; a second hash
shows that no two words share a number (else another salt is taken), so counts
are exact.

A scan knows the supported phrases as two Bloom filters (all of them, and those
of the last cycle) of a bounded size, so that the tasks pass on few phrases that
are not active.  Filters only save work: which phrases were active from which
step on is settled by joins on the phrases themselves.  A phrase that reaches the
threshold has reached its share in one shard, so only such phrases are looked up
in the shards' counts, by a broadcast if they are few and else behind a filter.

Pairs are tallied by hash before the scans: in tables of hashes that are dealt by
hash value, so that no task holds more than a block of them.  A pair whose hash
stays below the threshold in the whole corpus can't reach it, so it is never
counted, nor built upon.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm._util import U64, long_rows, mix64, shared_path, stored
from ledgerlens.session import shared_root

MIN_COUNT = 30
MAX_WORDS = 4
SHARDS = 3
TOP = 2000
#: A phrase is dropped if a longer one around it has at least this percentage of its occurrences.
COVER = 80
NO_LANG = "und"
#: Tables up to this many rows are broadcast to be looked up in.
BROADCAST_ROWS = 200_000
#: Bits of a filter: so many per phrase, within these bounds (a full filter costs time, no phrase).
BITS_PER_PHRASE, FEWEST_BITS, MOST_BITS = 32, 1 << 16, 1 << 26
_PROBES = 4
#: Words that a task holds before it passes counts on, and bytes of a text that are split at once.
_WORDS = 1 << 21
_BYTES = 1 << 20
#: Words of a row of coded texts, about, and such rows that are read at once.
_ROW_WORDS, _READ_ROWS = 1 << 17, 32
#: Hashes that are looked up in a filter at once.
_LOOKED_UP = 1 << 18
_EMIT = 1 << 18
#: Hashes of pairs that a block of their tally holds, about.
_BLOCK = 1 << 21
#: No byte of a text; the number of the end of a piece.
_END, _STOP = b"\xff", 0
_KEY = ["a", "b", "c", "d"]  # the words of a phrase, 0 behind the last one


def _byte_table() -> bytes:
    """A-Z to a-z, tabs to spaces, ends of pieces to ``_END``."""
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    table[ord("\t")] = ord(" ")
    for end in b".,;:!?\n\x0b\x0c\r":
        table[end] = _END[0]
    return bytes(table)


# --- words as numbers -------------------------------------------------------

def _blocks(data: bytes) -> Iterator[bytes]:
    """A translated text in parts of about ``_BYTES``, cut before spaces or ends of pieces."""
    at = 0
    while len(data) - at > _BYTES:
        cut = min((p for p in (data.find(b" ", at + _BYTES), data.find(_END, at + _BYTES)) if p >= 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


class _Words(dict):
    """Words of a language to numbers."""

    def __init__(self, lang: str, salt: int):
        super().__init__()
        self.lang, self.seed = lang, xxhash.xxh64_intdigest(lang.encode(), salt)
        self[_END] = _STOP

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh64_intdigest(word, self.seed)
        number = self[word] = number - (1 << 64) if number >> 63 else number or 1
        return number


def _coded(salt: int):
    """``mapInArrow`` body: (lang, text, shard) to coded texts and, in shard -1, the words of the task."""
    table = _byte_table()

    def batch(shard: list | None, langs: list, ids: list, words: list, numbers: list) -> pa.RecordBatch:
        n = len(langs)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(words, pa.binary()).cast(pa.string()),
             pa.array(numbers, pa.int64()), pa.array([-1] * n if shard is None else shard, pa.int32())],
            ["lang", "ids", "word", "id", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        most = min(_ROW_WORDS, _WORDS)

        def joined(out: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            """Parts of texts, in order, as one row per shard."""
            for shard in dict.fromkeys(s for s, _ in out):
                codes = np.concatenate([c for s, c in out if s == shard])
                yield batch([shard], [None], [codes.tobytes()], [None], [None])

        def dictionary() -> Iterator[pa.RecordBatch]:
            for lang, words in known.items():
                names = [w for w in words if w != _END]
                for a in range(0, len(names), _EMIT):
                    part = names[a:a + _EMIT]
                    yield batch(None, [lang] * len(part), [None] * len(part), part, [words[w] for w in part])
            known.clear()

        for rows in batches:
            out: list[tuple[int, np.ndarray]] = []
            size = 0
            for lang, data, shard in zip(rows.column("lang").to_pylist(), rows.column("text").cast(pa.binary()),
                                         rows.column("shard").to_pylist()):
                number = known.setdefault(lang, _Words(lang, salt)).__getitem__
                for part in _blocks(data.as_py().translate(table)):
                    codes = np.array(array("q", map(number, part.replace(_END, b" " + _END + b" ").split())), np.int64)
                    out.append((shard, codes))
                    size += len(codes)
                    if size > most and (codes == _STOP).any():  # a long text is cut between pieces
                        cut = int(np.flatnonzero(codes == _STOP)[-1]) + 1
                        out[-1] = shard, codes[:cut]
                        yield from joined(out)
                        out, size = [(shard, codes[cut:])], len(codes) - cut
                out.append((shard, np.zeros(1, np.int64)))
                if size > most:
                    yield from joined(out)
                    out, size = [], 0
                if sum(map(len, known.values())) > _WORDS:
                    yield from dictionary()
            yield from joined(out)
        yield from dictionary()

    return run


@dataclass(frozen=True)
class Coded:
    """Coded texts ``ids, shard`` and words ``id, lang, word`` (a row per task that met the word)."""

    texts: DataFrame
    words: DataFrame


def coded(docs: DataFrame, shards: int) -> Coded:
    """Texts as numbers of words in shards; taken again with another salt if two words share a number."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text",
                       # dealt by row, so that copies of one text spread over the shards
                       F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    schema = "lang string, ids binary, word string, id long, shard int"
    salt = 0
    while True:
        path = shared_path(spark, "phrases-coded")
        rows.where("text is not null").mapInArrow(_coded(salt), schema).write.partitionBy("shard").option(
            "compression", "zstd").parquet(path)
        whole = spark.read.schema(schema).parquet(path)
        words = whole.where("shard = -1").select("id", "lang", "word")
        other = F.xxhash64("lang", "word")
        if words.select("id", other.alias("h")).groupBy("id").agg(F.min("h").alias("h1"), F.max("h").alias("h2")).where(
                "h1 <> h2").isEmpty():
            return Coded(whole.where("shard >= 0").select("ids", "shard"), words)
        salt += 1


# --- filters ----------------------------------------------------------------

def extended(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all words but the last, and the last one."""
    with np.errstate(over="ignore"):
        return mix64((before * U64(0x9E3779B97F4A7C15)) ^ word)


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases given word by word, 0 behind the last one."""
    state = np.zeros(len(columns[0]), np.uint64)
    for words in columns:
        words = words.astype(np.int64).view(np.uint64)
        state = np.where(words != _STOP, extended(state, words), state)
    return state


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    other = mix64(hashes ^ U64(0xD6E8FEB86659FD93)) | U64(1)
    with np.errstate(over="ignore"):
        for k in range(_PROBES):
            yield (hashes + U64(k) * other) & U64(bits - 1)


def held(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each phrase may be in the filter."""
    out = np.ones(len(hashes), bool)
    for a in range(0, len(hashes), _LOOKED_UP):
        part = out[a:a + _LOOKED_UP]
        for at in _probes(hashes[a:a + _LOOKED_UP], 8 * len(filter_)):
            part &= (filter_[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def bits_for(phrases: int) -> int:
    return max(FEWEST_BITS, min(MOST_BITS, 1 << (BITS_PER_PHRASE * (phrases + 1)).bit_length()))


def _key_hashes(frame: pd.DataFrame) -> np.ndarray:
    return phrase_hashes([frame[c].to_numpy() for c in _KEY])


def filter_of(phrases: DataFrame, bits: int, hashes: Callable[[pd.DataFrame], np.ndarray] = _key_hashes) -> np.ndarray:
    """Bloom filter of ``phrases(a, b, c, d)``: made per task, united in one, one filter reaches the driver."""

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, seen = np.zeros(bits // 8, np.uint8), False
        for frame in frames:
            seen = seen or len(frame) > 0
            for at in _probes(hashes(frame), bits):
                np.bitwise_or.at(out, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))
        if seen:
            yield pd.DataFrame({"bits": [out.tobytes()]})

    def united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(bits // 8, np.uint8)
        for frame in frames:
            for blob in frame["bits"]:
                out |= np.frombuffer(blob, np.uint8)
        yield pd.DataFrame({"bits": [out.tobytes()]})

    made = phrases.select(*[c for c in phrases.columns if c in (*_KEY, "h")]).mapInPandas(marked, "bits binary").repartition(1).mapInPandas(united, "bits binary")
    found = made.first()
    return np.frombuffer(found["bits"], np.uint8) if found else np.zeros(bits // 8, np.uint8)


def _matched(table: DataFrame, keys: DataFrame) -> DataFrame:
    """``table`` joined to the distinct ``keys``: by a broadcast of few keys, else behind a filter that lets few others pass."""
    rows = keys.count()
    if rows <= BROADCAST_ROWS:
        return table.join(F.broadcast(keys), _KEY)
    marks = filter_of(keys, bits_for(rows))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(marks, phrase_hashes([batch.column(c).to_numpy() for c in _KEY]))))

    return table.mapInArrow(passed, table.schema).join(keys, _KEY)


# --- pairs that can reach the threshold -------------------------------------

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of whole texts, about ``_WORDS`` at once."""
    parts, size = [], 0
    for batch in batches:
        for value in batch.column("ids"):
            ids = np.frombuffer(value.as_buffer(), np.int64)
            parts.append(ids)
            size += len(ids)
            if size > _WORDS:
                yield np.concatenate(parts)
                parts, size = [], 0
    if size:
        yield np.concatenate(parts)


def frequent_pairs(texts: DataFrame, min_count: int) -> DataFrame:
    """``h``: hashes that pairs of neighbouring words in ``texts(ids)`` have ``min_count`` times or more in all."""
    words = (texts.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8
    bits = max(1, (words // _BLOCK).bit_length())

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _runs(batches):
            at = np.flatnonzero((ids[:-1] != _STOP) & (ids[1:] != _STOP))
            hashes, n = np.unique(phrase_hashes([ids[at], ids[at + 1]]), return_counts=True)
            n = np.minimum(n, min_count).astype(np.uint32)
            block = (hashes >> U64(64 - bits)).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(block[cuts[:-1]], pa.int32()),
                pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["block", "hashes", "n"])

    def reached(rows: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(rows["hashes"].to_pylist()), np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        n = np.frombuffer(b"".join(rows["n"].to_pylist()), np.uint32)[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return pa.table({"h": hashes[first][np.add.reduceat(n, first) >= min_count].view(np.int64)})

    tally = texts.mapInArrow(tallied, "block int, hashes binary, n binary")
    with long_rows(texts.sparkSession, _READ_ROWS):
        return stored(tally.groupBy("block").applyInArrow(reached, "h long"), "phrases-pairs")


def pair_filter(texts: DataFrame, min_count: int) -> np.ndarray:
    """Bloom filter of ``frequent_pairs``: it holds every pair that can reach the threshold."""
    pairs = frequent_pairs(texts, min_count)
    return filter_of(pairs, bits_for(pairs.count()), lambda frame: frame["h"].to_numpy(np.int64).view(np.uint64))


# --- a scan -----------------------------------------------------------------

@dataclass(frozen=True)
class Active:
    """What a step counts: words or not, and phrases by the filters of all and of new supported phrases and of pairs."""

    words: bool
    all: np.ndarray | None
    new: np.ndarray | None
    longest: int
    pairs: np.ndarray | None = None


def counted_rows(ids: np.ndarray, active: Active) -> Iterator[pa.RecordBatch]:
    """Words and active phrases of a run of numbers with their counts."""
    words, codes, n = np.unique(ids, return_inverse=True, return_counts=True)
    codes = codes.astype(np.int32)
    real = words != _STOP
    if active.words:
        yield from _rows([np.flatnonzero(real)], n[real], words)
    if active.all is None or len(codes) < 2:
        return
    numbers = words.view(np.uint64)
    state = extended(np.zeros(len(words), np.uint64), numbers)
    ok, fresh, state = (held(active.all, state) & real)[codes], held(active.new, state)[codes], state[codes]
    # ok[i], fresh[i], state[i]: of the phrase of the last length that begins at i
    for length in range(2, active.longest + 1):
        pair = np.flatnonzero(ok[:-1] & ok[1:])
        if length == 2 and active.pairs is not None:
            pair = pair[held(active.pairs, extended(state[pair], numbers[codes[pair + 1]]))]
        live = pair[fresh[pair] | fresh[pair + 1]]
        if len(live):
            yield from _rows(*_distinct(codes, live, length, len(words)), words)
        if length == active.longest or not len(pair):
            return
        ok, fresh, before = np.zeros(len(ok) - 1, bool), np.zeros(len(ok) - 1, bool), state
        state = np.zeros(len(ok), np.uint64)
        state[pair] = extended(before[pair], numbers[codes[pair + length - 1]])
        ok[pair], fresh[pair] = held(active.all, state[pair]), held(active.new, state[pair])


def _distinct(codes: np.ndarray, at: np.ndarray, length: int, v: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Word codes (one array per place) and counts of the distinct phrases that begin at ``at``."""
    key = codes[at].astype(np.int64)
    for k in range(1, length):
        if k > 1:  # numbers of the distinct beginnings, so that the product stays within 64 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * v + codes[at + k]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [codes[at[first] + k] for k in range(length)], n


def _rows(places: list[np.ndarray], n: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(n), _EMIT):
        columns = [words[p[a:a + _EMIT]] for p in places]
        columns += [np.zeros(len(columns[0]), np.int64)] * (len(_KEY) - len(places))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, n[a:a + _EMIT])], [*_KEY, "n"])


def scan(texts: DataFrame, active: Active) -> DataFrame:
    """Counts ``a, b, c, d, n`` of the words and active phrases (and few others) in ``texts(ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _runs(batches):
            yield from counted_rows(ids, active)

    return texts.mapInArrow(run, "a long, b long, c long, d long, n long").groupBy(*_KEY).agg(F.sum("n").alias("n"))


# --- dynamic itemset counting -----------------------------------------------

class Steps:
    """A table that grows by a stored part with each step; any steps of it are read by one scan.

    A plan over many steps stays as short as over one, which is what the driver
    has to hold and to compile.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.schema = spark, f"{name}-{uuid.uuid4().hex}", None

    def add(self, step: int, df: DataFrame) -> None:
        self.schema = stored(df, f"{self.name}/{step}").schema

    def read(self, steps: Iterable[int]) -> DataFrame:
        folder = f"{shared_root(self.spark)}/llm/{self.name}"
        return self.spark.read.schema(self.schema).parquet(*[f"{folder}/{step}-*" for step in steps])


def _length() -> Column:
    return sum(((F.col(c) != _STOP).cast("int") for c in _KEY[1:]), F.lit(1))


@dataclass(frozen=True)
class Counted:
    """Phrases that reach the threshold with their exact counts, and the steps it took."""

    phrases: DataFrame
    words: DataFrame
    steps: int


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, shards: int = SHARDS) -> Counted:
    """``phrases(lang, len, phrase, a)`` of up to ``longest`` words with ``a >= min_count``; ``words(lang, n)``.

    The driver holds filters of at most ``MOST_BITS`` bits and one number per length and step.
    """
    if not 1 <= longest <= MAX_WORDS:
        raise ValueError(f"phrases have 1 to {MAX_WORDS} words")
    spark = docs.sparkSession
    code = coded(docs, shards)
    share = -(-min_count // shards)
    pairs = pair_filter(code.texts.select("ids"), min_count) if longest > 1 else None
    counts = Steps(spark, "phrases-counts")
    every = Steps(spark, "phrases-supported")  # supported phrases with the step that supported them
    filters: list[np.ndarray] = []
    bits = step = 0
    while True:
        active = Active(step < shards, None, None, longest)
        if filters:
            active = Active(step < shards, reduce(np.bitwise_or, filters), reduce(np.bitwise_or, filters[-shards:]), longest, pairs)
        found = scan(code.texts.where(F.col("shard") == step % shards).select("ids"), active)
        with long_rows(spark, _READ_ROWS):
            counts.add(step, found.withColumn("t", F.lit(step)))
        every.add(step, _reached(counts, every, min_count, share, shards, step).withColumn("reach", F.lit(step)))

        fresh = every.read([step])
        bits = bits or bits_for(4 * fresh.count())
        filters.append(filter_of(fresh.where(_length() < longest), bits))  # empty if no longer phrase can build on the step's
        step += 1
        if step >= shards and not any(f.any() for f in filters[-shards:]):
            break

    phrases = stored(_matched(counts.read(range(step)), every.read(range(step)).drop("reach")).where(
        (F.col("t") >= F.col("since")) & (F.col("t") < F.col("since") + shards)).groupBy(*_KEY).agg(
        F.sum("n").alias("n")), "phrases-totals")
    words = counts.read(range(shards)).where("b = 0").select("a", "n")
    return Counted(*_named(phrases, words, code.words), step)


def _reached(counts: Steps, every: Steps, min_count: int, share: int, shards: int, step: int) -> DataFrame:
    """``a, b, c, d, since`` of the phrases whose count since they became active reaches the threshold now."""
    first = max(0, step - shards + 1)
    recent = counts.read(range(first, step + 1))
    wanted = recent.where(F.col("n") >= share).select(*_KEY).distinct()
    zero = F.lit(0).cast("long")
    if step:
        known = every.read(range(step))
        last, word = _length(), F.col("b") == _STOP
        # a word builds on nothing: itself stands for its parts, so that no key is shared by all words
        parts = wanted.join(known, _KEY, "left_anti").withColumns({
            "ha": F.col("a"), "hb": F.when(last > 2, F.col("b")).otherwise(0), "hc": F.when(last > 3, F.col("c")).otherwise(0),
            "hd": zero, "ta": F.when(word, F.col("a")).otherwise(F.col("b")), "tb": F.col("c"), "tc": F.col("d"), "td": zero})
        heads = known.select(*[F.col(c).alias(f"h{c}") for c in _KEY], F.col("reach").alias("r1"))
        tails = known.select(*[F.col(c).alias(f"t{c}") for c in _KEY], F.col("reach").alias("r2"))
        met = parts.join(heads, [f"h{c}" for c in _KEY], "left").join(tails, [f"t{c}" for c in _KEY], "left")
        wanted = met.where(word | (F.col("r1").isNotNull() & F.col("r2").isNotNull())).select(
            *_KEY, F.when(word, 0).otherwise(F.greatest("r1", "r2") + 1).alias("since"))
    else:
        wanted = wanted.where("b = 0").withColumn("since", F.lit(0))
    wanted = stored(wanted.where(F.col("since") >= first), "phrases-candidates")
    totals = _matched(recent, wanted).where("t >= since").groupBy(*_KEY, "since").agg(F.sum("n").alias("n"))
    return totals.where(F.col("n") >= min_count).drop("n")


def _named(phrases: DataFrame, words: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases as text, and the words of each language in all."""
    lang_of = dictionary.groupBy(F.col("id").alias("a")).agg(F.min("lang").alias("lang"))
    sizes = words.groupBy("a").agg(F.sum("n").alias("n")).join(lang_of, "a").groupBy("lang").agg(F.sum("n").alias("n"))
    used = phrases.where("b = 0").select(F.col("a").alias("id"))
    names = stored(_lookup_words(dictionary, used), "phrases-words")
    out = phrases
    for place, c in enumerate(_KEY):
        own = names.select(F.col("id").alias(c), F.col("word").alias(f"w{c}"), *([F.col("lang")] if place == 0 else []))
        out = out.join(own, c, "inner" if place == 0 else "left")
    text = out.select("lang", _length().alias("len"), F.concat_ws(" ", *[f"w{c}" for c in _KEY]).alias("phrase"),
                      F.col("n").alias("a"))
    return stored(text, "phrases"), stored(sizes, "phrases-sizes")


def _lookup_words(dictionary: DataFrame, used: DataFrame) -> DataFrame:
    """``id, lang, word`` of the used numbers, one row each."""
    keys = used.select(F.col("id").alias("a"), *[F.lit(0).cast("long").alias(c) for c in _KEY[1:]])
    rows = dictionary.select(F.col("id").alias("a"), *[F.lit(0).cast("long").alias(c) for c in _KEY[1:]], "lang", "word")
    return _matched(rows, keys).groupBy(F.col("a").alias("id")).agg(F.min("lang").alias("lang"), F.min("word").alias("word"))


# --- scores -----------------------------------------------------------------

def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(counted: Counted, cover: int = COVER) -> DataFrame:
    """``lang, phrase, len, a, l, r, score`` by the lowest-scoring cut, without phrases that a longer one covers."""
    every = counted.phrases
    names = ["lang", "len", "phrase"]
    phrases = every.where("len > 1")
    words = F.split("phrase", " ")

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice(words, start, size), " ")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).select(
        *names, "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("len") - F.col("k")).alias("tail"))
    both = (cuts.join(every.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
            .join(every.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]))
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * _wide("a"), _wide("l") + _wide("r"))
    best = both.withColumn("score", score).groupBy(*names, "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where("len > 2").select(
        "lang", F.col("a").alias("around"), F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("len") - 1), lambda size: F.transform(
                F.sequence(F.lit(1), F.col("len") - size + 1), lambda at: part(at, size))))).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    covered = F.coalesce(F.lit(100).cast("decimal(3,0)") * _wide("around") >= F.lit(cover).cast("decimal(3,0)") * _wide("a"), F.lit(False))
    return best.join(longest, ["lang", "phrase"], "left").where(~covered).select(
        "lang", "phrase", "len", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, shards: int = SHARDS,
                 top: int = TOP, cover: int = COVER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    Null texts count as empty, a null language as ``und``; repeated rows count as
    often as they occur.  Texts are read whole, a long one part by part.  Ties in
    score and count go to the smaller phrase by its bytes.  An empty table gives
    no rows; other columns are not read.
    """
    counted = count_phrases(docs, min_count, longest, shards)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored(counted, cover).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(counted.words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB twin of ``collocations`` with its defaults.
SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM texts),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT f.*, c, string_split(phrase, ' ') AS w FROM f, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scores AS (SELECT x.lang, x.k, x.phrase, x.a, c, p.a AS l, q.a AS r, 2000000::HUGEINT * x.a // (p.a::HUGEINT + q.a) AS score FROM cuts x
  JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(w[1:c], ' ') JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(w[c + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, a, string_split(phrase, ' ') AS w, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
