"""Token ids as bit-plane shuffled binary files.

Documents are range-partitioned by id and encoded where they lie; their ids,
each document ended by an end id, form one stream in ascending id order.  The
stream is cut into chunks of a fixed number of ids.  A chunk is transposed into
planes (bit ``b`` or byte ``b`` of all its ids side by side), each plane is
compressed by zstandard on its own, and a chunk index of offsets, plane lengths
and checksums follows the chunks in the file.  High planes are all zero or
nearly so and shrink to a few bytes.

File: magic; chunks (planes, then the table of the documents that begin in the
chunk); the index, an array of fixed-width entries; a trailer that says where
the index is.  A file holds whole documents.  Files have unique names and only
the written index names them, so a retried task leaves an unlisted file behind
and no wrong row.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._files import opened, shared_folder
from ledgerlens.llm._util import spans, stored

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids of a chunk, and the size from which a file takes no further document.
CHUNK_IDS = 1 << 16
FILE_BYTES = 256 << 20
#: Bits of a plane's unit: 8 for byte planes, 1 for bit planes.
UNIT_BITS = 8
LEVEL = 3
#: Chunks that one reading task begins documents in.
READ_CHUNKS = 64
#: Documents of the sample whose common words tasks know from the start, and words at most.
COMMON_ROWS, COMMON_WORDS = 20_000, 200_000
_CHARS = 1 << 21
#: Further words that a task remembers.
_CACHED_WORDS = 1 << 18
_MAGIC = b"IDPLANE1"
_TRAILER = "<QQQII8s"  # index offset, chunks, ids, chunk ids, unit bits, magic
INDEX_SCHEMA = "part int, file string, chunk int, offset long, length long, first long, n_ids long, n_docs long, crc32 long"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Path of a public tokenizer file that is installed on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- encoding ---------------------------------------------------------------

@dataclass(frozen=True)
class CommonWords:
    """Words (or ends of words behind ``_MARK``) joined by spaces, their ids in a row, and the number of ids of each."""

    words: str
    ids: np.ndarray
    size: np.ndarray


class _Numbers(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _splits_words(spec: str) -> bool:
    """Whether the tokenizer splits plain text at words, each with the space before it."""
    form = json.loads(spec)
    before = form.get("pre_tokenizer") or {}
    return (form.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True))


@lru_cache(maxsize=1)
def _tokenizer(spec: str):
    """The tokenizer, whether it splits words, and which ids begin with a space; a worker reads it once for all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(spec)
    model.encode_special_tokens = True
    vocabulary = model.get_vocab()
    opens_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    opens_word[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
    return model, _splits_words(spec), opens_word


#: Words are cut behind a letter before a comma or full stop; the rest begins with ``_MARK`` and has no space before it.
_MARK = "\x01"
_CUT = "([A-Za-zÀ-ÖØ-öø-ɏ])([.,])"


class Encoder:
    """Ids of whole texts; special strings in a text are ordinary text.

    A byte-level tokenizer that splits words before spaces never joins a space
    to the character before it, unless that is white space as well, nor a comma or
    full stop to a letter before it.  There the words of a
    text are looked up, and only words not seen before are encoded.  Any other
    text, and every text under another kind of tokenizer, is encoded as a whole.
    """

    _UNSAFE = f"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] |{_MARK}"  # white space, space

    def __init__(self, spec: str, end_id: int = END_ID, common: CommonWords | None = None):
        self.model, self.by_words, self.opens_word = _tokenizer(spec)
        self.end_id, self.common = end_id, common
        self._forget()

    def _forget(self) -> None:
        """Only the common words are known."""
        self.numbers = _Numbers()
        self.pool, self.at, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.common is not None:
            self.numbers.update(zip(self.common.words.split(" "), range(len(self.common.size))))
            self.pool, self.size = self.common.ids, self.common.size.astype(np.int64)
            self.at = np.cumsum(self.size) - self.size

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _behind_spaces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each behind a space, in a row, and the number of ids of each."""
        if words and all(words) and not any(w[-1].isspace() for w in words):
            ids = self._each([" " + " ".join(words)])[0]
            starts = np.flatnonzero(self.opens_word[ids])
            if len(starts) == len(words):
                return ids, np.diff(np.append(starts, len(ids)))
        return _in_a_row(self._each([" " + w for w in words]))

    def _learn(self, words: list[str]) -> None:
        """Adds words (each behind a space) and ends of words to the pool, in order."""
        ends = np.fromiter((w.startswith(_MARK) for w in words), bool, len(words))
        size, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for which, (ids, n) in (
                (~ends, self._behind_spaces([w for w in words if not w.startswith(_MARK)])),
                (ends, _in_a_row(self._each([w[1:] for w in words if w.startswith(_MARK)])))):
            size[which], at[which] = n, len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate((self.pool, ids))
        self.at, self.size = np.concatenate((self.at, at)), np.concatenate((self.size, size))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, an end id after each, and the number of ids of each (end ids counted)."""
        seeded = 0 if self.common is None else len(self.common.size)
        if len(self.numbers) > seeded + _CACHED_WORDS:
            self._forget()
        known = len(self.numbers)
        unsafe = pc.match_substring_regex(pa.array(texts, pa.string()), self._UNSAFE).to_pylist()
        whole = unsafe if self.by_words else [True] * len(texts)
        plain = pa.array(["" if w else t for w, t in zip(whole, texts)], pa.string())
        split = pc.split_pattern(pc.replace_substring_regex(plain, _CUT, rf"\1 {_MARK}\2"), " ")
        offsets, pieces = split.offsets.to_numpy(), split.values.dictionary_encode()
        firsts = [t if w else f for w, t, f in zip(whole, texts, pieces.take(pa.array(offsets[:-1])).to_pylist())]
        place = pieces.indices.to_numpy()
        is_word = np.ones(len(place), bool)
        is_word[offsets[:-1]] = False
        used = np.zeros(len(pieces.dictionary), bool)
        used[place[is_word]] = True
        number_of = np.zeros(len(used), np.int64)
        words = pieces.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        number_of[used] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        new = list(islice(self.numbers, known, None))
        if new:
            self._learn(new)
        heads = self._each(firsts)
        # pool: words, then the heads of these texts, then the end id
        head_size = np.fromiter(map(len, heads), np.int64, len(heads))
        pool = np.concatenate((self.pool, *heads, np.array([self.end_id], np.uint32)))
        at = np.concatenate((self.at, len(self.pool) + np.cumsum(head_size) - head_size, [len(pool) - 1]))
        size = np.concatenate((self.size, head_size, [1]))
        n, each = len(self.numbers), np.arange(len(texts))
        items = np.empty(len(place) + len(texts), np.int64)
        tails = offsets[1:].astype(np.int64) + each
        items[np.arange(len(place)) + np.repeat(each, np.diff(offsets))] = number_of[place]
        items[offsets[:-1] + each], items[tails] = n + each, n + len(texts)
        length = size[items]
        upto = np.cumsum(length)
        place = np.repeat(at[items] - (upto - length), length) + np.arange(int(length.sum()))
        return pool[place], np.diff(upto[tails], prepend=0)


def _in_a_row(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ids joined, and the length of each."""
    return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))


def common_words(docs: DataFrame, spec: str, rows: int = COMMON_ROWS, most: int = COMMON_WORDS) -> CommonWords | None:
    """The most frequent words of a sample of about ``rows`` documents with their ids.

    Tasks start with them, so that no task encodes them again; they change no
    result.  The driver receives ``most`` words at most.
    """
    if not _splits_words(spec):
        return None
    texts = docs.select("text").where("text is not null")
    count = texts.count()
    sample = texts.sample(min(1.0, rows / max(1, count)), seed=7) if count > rows else texts
    cut = F.regexp_replace("text", _CUT, f"$1 {_MARK}$2")
    words = sample.select(F.explode(F.slice(F.split(cut, " "), 2, 1 << 30)).alias("word")).groupBy("word").count()
    kept = words.where((F.col("count") > 1) & (F.length("word") > 0)).orderBy(F.desc("count"), "word").limit(most)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(spec)
        for frame in frames:
            found = encoder._each([w[1:] if w.startswith(_MARK) else " " + w for w in frame["word"]])
            yield pd.DataFrame({"word": frame["word"], "ids": [x.tobytes() for x in found]})

    found = kept.select("word").repartition(max(1, most // 20_000)).mapInPandas(encode, "word string, ids binary").toPandas()
    if found.empty:
        return None
    return CommonWords(" ".join(found["word"]), np.frombuffer(b"".join(found["ids"]), np.uint32),
                       (found["ids"].map(len) // 4).to_numpy(np.int32))


# --- planes -----------------------------------------------------------------

def to_planes(ids: np.ndarray, unit_bits: int = UNIT_BITS) -> list[bytes]:
    """Planes of 32-bit ids: byte ``b`` of every id side by side, or bit ``b`` packed eight to a byte."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if unit_bits == 8:
        return [plane.tobytes() for plane in raw.T]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(plane, bitorder="little").tobytes() for plane in bits.T]


def from_planes(planes: list[bytes], n: int, unit_bits: int = UNIT_BITS) -> np.ndarray:
    """The ids again."""
    raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1) if n else np.zeros((0, 4), np.uint8)
    if unit_bits == 8:
        return np.ascontiguousarray(raw).view("<u4").ravel()
    bits = np.stack([np.unpackbits(plane, bitorder="little")[:n] for plane in raw.T], axis=1) if n else raw
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel() if n else np.zeros(0, "<u4")


def _entry(unit_bits: int) -> np.dtype:
    """An entry of the chunk index."""
    return np.dtype([("offset", "<u8"), ("length", "<u8"), ("first", "<u8"), ("n_ids", "<u4"), ("n_docs", "<u4"),
                     ("lead", "<u4"), ("crc32", "<u4"), ("doc_bytes", "<u4"), ("planes", "<u4", (32 // unit_bits,))])


class PlaneFile:
    """One file being written."""

    def __init__(self, out, chunk_ids: int, unit_bits: int):
        self.out, self.chunk_ids, self.unit_bits = out, chunk_ids, unit_bits
        self.entries: list[tuple] = []
        self.offset, self.first = len(_MAGIC), 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.held, self.held_ids, self.docs, self.lead = [], 0, [], 0
        out.write(_MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """One document; whole chunks are written at once."""
        at = 0
        if not self.docs:
            self.lead = self.held_ids
        self.docs.append((doc_id, len(ids)))
        while True:
            take = min(len(ids) - at, self.chunk_ids - self.held_ids)
            self.held.append(ids[at:at + take])
            self.held_ids, at = self.held_ids + take, at + take
            if self.held_ids == self.chunk_ids:
                self._flush()
            if at == len(ids):
                return

    def _flush(self) -> None:
        ids = np.concatenate(self.held).astype("<u4")
        planes = [self.pack(p) for p in to_planes(ids, self.unit_bits)]
        names = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        empty = np.array([d is None for d, _ in self.docs], np.uint8)
        sizes = np.array([n for _, n in self.docs], "<u8")
        table = self.pack(names.tobytes() + empty.tobytes() + sizes.tobytes())
        blob = b"".join(planes) + table
        self.out.write(blob)
        self.entries.append((self.offset, len(blob), self.first, len(ids), len(self.docs),
                             self.lead if self.docs else len(ids), zlib.crc32(ids.tobytes()), len(table), tuple(map(len, planes))))
        self.offset, self.first = self.offset + len(blob), self.first + len(ids)
        self.held, self.held_ids, self.docs = [], 0, []

    def close(self) -> np.ndarray:
        """Writes the rest, the index and the trailer; returns the index."""
        if self.held_ids or self.docs:
            self._flush()
        index = np.array(self.entries, _entry(self.unit_bits))
        self.out.write(index.tobytes())
        self.out.write(struct.pack(_TRAILER, self.offset, len(index), self.first, self.chunk_ids, self.unit_bits, _MAGIC))
        self.out.close()
        return index


@dataclass(frozen=True)
class PlaneReader:
    """An open file with its index."""

    source: object
    index: np.ndarray
    unit_bits: int

    @classmethod
    def of(cls, source) -> PlaneReader:
        end = source.size()
        at, chunks, _, _, unit_bits, magic = struct.unpack(
            _TRAILER, source.read_at(struct.calcsize(_TRAILER), end - struct.calcsize(_TRAILER)))
        if magic != _MAGIC:
            raise ValueError("not a file of id planes")
        kind = _entry(unit_bits)
        return cls(source, np.frombuffer(source.read_at(chunks * kind.itemsize, at), kind), unit_bits)

    def chunk(self, i: int) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
        """Ids of a chunk and the documents that begin in it; raises ``ValueError`` on damage."""
        entry = self.index[i]
        data = self.source.read_at(int(entry["length"]), int(entry["offset"]))
        unpack, planes, at = zstandard.ZstdDecompressor().decompress, [], 0
        for size in entry["planes"].tolist():
            planes.append(unpack(data[at:at + size]))
            at += size
        ids = from_planes(planes, int(entry["n_ids"]), self.unit_bits)
        if len(data) != entry["length"] or zlib.crc32(ids.tobytes()) != entry["crc32"]:
            raise ValueError(f"chunk {i} does not match its checksum")
        n, table = int(entry["n_docs"]), unpack(data[at:])
        names, empty = np.frombuffer(table, "<i8", n).tolist(), table[8 * n:9 * n]
        sizes = np.frombuffer(table, "<u8", n, 9 * n).tolist()
        return ids, [(None if e else d, s) for d, e, s in zip(names, empty, sizes)]

    def documents(self, begin: int, end: int) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """``doc_id, first, n, pieces`` of the documents that begin in chunks ``begin..end``.

        ``first`` counts the file's ids before the document.  Its ids come in
        pieces, a chunk at a time, whatever its length.
        """
        for i in range(begin, end):
            ids, docs = self.chunk(i)
            at = int(self.index[i]["lead"])
            for doc_id, size in docs:
                yield doc_id, int(self.index[i]["first"]) + at, size, self._pieces(i, ids, at, size)
                at += size

    def _pieces(self, i: int, ids: np.ndarray, at: int, left: int) -> Iterator[np.ndarray]:
        while left:
            piece = ids[at:at + left]
            if len(piece):
                yield piece
            left -= len(piece)
            if left:
                i, at = i + 1, 0
                ids = self.chunk(i)[0]


# --- the operator -----------------------------------------------------------

def _writer(folder: str, spec: str, common: CommonWords | None, end_id: int, chunk_ids: int, unit_bits: int, file_bytes: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        part, encode = TaskContext.get().partitionId(), Encoder(spec, end_id, common)
        file, name, before = None, None, 0

        def closed() -> pd.DataFrame:
            index = file.close()
            return pd.DataFrame({
                "part": part, "file": f"{folder}/{name}", "chunk": np.arange(len(index)), "offset": index["offset"],
                "length": index["length"], "first": before + index["first"].astype(np.int64), "n_ids": index["n_ids"],
                "n_docs": index["n_docs"], "crc32": index["crc32"]}).astype(
                {c: "int64" for c in ("offset", "length", "n_ids", "n_docs", "crc32")})

        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            names = [None if d is None else int(d) for d in frame["doc_id"]]
            for a, b in spans([len(t) for t in texts], _CHARS):
                ids, sizes = encode(texts[a:b])
                ends = np.cumsum(sizes)
                for doc_id, lo, hi in zip(names[a:b], (ends - sizes).tolist(), ends.tolist()):
                    if file is not None and file.offset >= file_bytes:
                        yield closed()
                        before, file = before + file.first, None
                    if file is None:
                        name = f"{uuid.uuid4().hex}.idplanes"
                        file = PlaneFile(system.open_output_stream(f"{base}/{name}", compression=None), chunk_ids, unit_bits)
                    file.add(doc_id, ids[lo:hi])
        if file is not None:
            yield closed()

    return write


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS,
                 unit_bits: int = UNIT_BITS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every document into files of id planes; returns the stored chunk index (``INDEX_SCHEMA``).

    ``part`` and ``first`` place a chunk: parts ascend by document id (null last,
    ties by a hash of the text), ``first`` counts the part's ids before the chunk.
    A null text counts as empty and gives the end id alone; rows repeat as they
    occur.  An empty table gives no files; other columns are not read.
    """
    if unit_bits not in (1, 8):
        raise ValueError("planes hold bits (1) or bytes (8)")
    spark = docs.sparkSession
    with open(path or tokenizer_path(), encoding="utf-8") as source:
        spec = source.read()
    folder = shared_folder(spark, "tokens")
    # the hash spreads rows of one id over ranges, the row number equal rows
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    placed = docs.select("doc_id", "text").repartitionByRange(
        *order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    # ids travel as text: a batch with a null id would turn whole numbers into doubles
    rows = placed.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return stored(rows.mapInPandas(_writer(folder, spec, common_words(docs, spec), end_id, chunk_ids, unit_bits,
                                           file_bytes), INDEX_SCHEMA), "tokens-index")


def _read(summary: bool):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, file, begin, end, before in frame[["part", "file", "begin", "end", "before"]].itertuples(
                    index=False, name=None):
                system, place = opened(file)
                with system.open_input_file(place) as source:
                    rows, held = [], 0
                    for doc_id, first, n, pieces in PlaneReader.of(source).documents(begin, end):
                        if summary:
                            value = 0
                            for piece in pieces:
                                value = zlib.crc32(np.ascontiguousarray(piece).tobytes(), value)
                        else:
                            value = np.concatenate(list(pieces)).astype(np.int32) if n else np.zeros(0, np.int32)
                            held += n
                        rows.append((part, None if doc_id is None else str(doc_id), before + first, n, value))
                        if len(rows) == 10_000 or held > 1 << 20:
                            yield _rows(rows, summary)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, summary)

    return read


def _rows(rows: list[tuple], summary: bool) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "doc_id", "start", "n_tokens", "ids_crc32" if summary else "ids"])


def read_tokens(index: DataFrame, summary: bool = False, chunks: int = READ_CHUNKS) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files that ``index`` names.

    ``start`` counts the ids of all documents before it.  ``summary`` gives
    ``ids_crc32`` in place of the ids: the unsigned CRC-32 of all of them as
    little-endian unsigned 32-bit integers.  A task begins documents in at most
    ``chunks`` chunks; damaged chunks fail the job.
    """
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition of the writer: safe to add up in one task and to broadcast
    offsets = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))
    group = F.floor(F.col("chunk") / F.lit(chunks))
    units = index.groupBy("part", "file", group.alias("unit")).agg(
        F.min("chunk").alias("begin"), (F.max("chunk") + 1).alias("end"))
    files = index.where("chunk = 0").select(F.col("file").alias("named"), F.col("first").alias("before"))
    work = stored(units.join(files, units["file"] == files["named"]).select("part", "file", "begin", "end", "before"),
                  "tokens-units")
    placed = work.repartition(max(1, work.count()), "file", "begin")
    found = placed.mapInPandas(_read(summary), "part int, doc_id string, start long, n_tokens long, "
                               + ("ids_crc32 long" if summary else "ids array<int>"))
    return found.join(F.broadcast(offsets), found["part"] == offsets["of"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("start") + F.col("part_first")).alias("start"), "n_tokens",
        "ids_crc32" if summary else "ids")


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files it was written to."""
    return read_tokens(write_tokens(docs, **options), summary=True)
