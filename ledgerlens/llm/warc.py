"""WARC archives, index first.

``write_archives`` turns pages into gzip-member WARC/1.1 files in the shared
folder and returns one index row per record (archive, offset, length, URL,
digest).  ``read_records`` takes any selection of index rows, sorts them by
place, joins neighbouring byte ranges into few reads and parses the records.

Archives have unique names, and only the index names them: a retried task
leaves an unlisted file behind and no wrong record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._files import opened, shared_folder
from ledgerlens.llm._util import stored

#: Payloads below this size are always stored in full.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 512 << 20
#: Ranges closer than GAP_BYTES are read together, up to READ_BYTES at once.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Archive bytes that one reading task covers.
TASK_BYTES = 32 << 20
RECORD_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = ("archive string, offset long, length long, url string, payload_digest string, "
                "record_type string, page_id long")
RECORD_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
                 "payload_bytes long")


def _whole(text: str | None) -> int | None:
    return None if text is None else int(text)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame; whole numbers stay exact beside nulls."""
    columns = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({name: pd.array([r[i] for r in rows], dtype="Int64" if kind == "long" else object)
                         for i, (name, kind) in enumerate(columns)})


# --- records ----------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _field(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unfield(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that only refers to one."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload; raises ValueError on a damaged record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return fields, block.partition(b"\r\n\r\n")[2]


def _id_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- writing ----------------------------------------------------------------

def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, size, refers_to``: equal payloads refer to their smallest page id."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"))
    lowest = stored(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "low"), "warc-repeats")
    joined = rows.join(lowest, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(
        F.col("page_id").isNull() | (F.col("page_id") != F.col("low")), F.col("low")).alias("refers_to"))


def _writer(folder: str, archive_bytes: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        out, name, offset = None, None, 0
        try:
            for frame in frames:
                index = []
                for page_id, url, payload, digest, refers in frame.itertuples(index=False, name=None):
                    page_id, refers = _whole(page_id), _whole(refers)
                    member = _gzip(make_record(page_id, url, payload, digest, refers))
                    if out is None or offset + len(member) > archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    index.append((f"{folder}/{name}", offset, len(member), url, digest,
                                  "response" if refers is None else "revisit", page_id))
                    offset += len(member)
                yield _frame(index, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a WARC record; returns the stored index.

    Nulls: a null ``html`` is an empty payload, a null ``url`` has no target
    URI; a null ``page_id`` revisits the smallest non-null id of its payload,
    and is a response if there is none.  Rows that repeat the smallest id and
    its payload are responses, all of them.  Other columns are not read.
    """
    folder = shared_folder(pages.sparkSession, "archives")
    # ids travel as text: a batch with a null id would turn whole numbers into doubles
    rows = with_revisits(pages, min_bytes).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stored(rows.mapInPandas(_writer(folder, archive_bytes), INDEX_SCHEMA), "warc-index")


# --- reading ----------------------------------------------------------------

def coalesce(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads (start, end, first range, end of ranges)."""
    reads: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads:
            start, end, first, _ = reads[-1]
            if offset - end <= gap and max(end, offset + length) - start <= most:
                reads[-1] = (start, max(end, offset + length), first, i + 1)
                continue
        reads.append((offset, offset + length, i, i + 1))
    return reads


def _reader(gap: int, most: int):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, part in frame.groupby("archive", sort=True):
                part = part.sort_values("offset")
                ranges = list(zip(part["offset"].tolist(), part["length"].tolist()))
                system, path = opened(archive)
                with system.open_input_file(path) as source:
                    for start, end, first, last in coalesce(ranges, gap, most):
                        data = memoryview(source.read_at(end - start, start))
                        rows = []
                        for offset, length in ranges[first:last]:
                            member = data[offset - start:offset - start + length]
                            rows.append(_as_row(*parse_record(zlib.decompress(member, 31))))
                        yield _frame(rows, RECORD_SCHEMA)

    return read


def _as_row(fields: dict[str, str], payload: bytes) -> tuple:
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = kind == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    url = fields.get("warc-target-uri")
    return (_id_of(fields["warc-record-id"]), None if url is None else _unfield(url), kind,
            _id_of(fields["warc-refers-to"]) if revisit else None, digest, None if revisit else len(payload))


def read_records(selected: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Records of the selected index rows, read in few sorted ranges.

    Rows are dealt by ranges of (archive, offset), so neighbours meet in a task
    and a long archive spreads over several.  Payloads are checked against
    their digests; a damaged record fails the job.
    """
    wanted = selected.select("archive", "offset", "length")
    # index rows are tiny beside what they point to, so tasks are cut by archive bytes
    tasks = 1 + int((wanted.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    placed = wanted.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInPandas(_reader(gap, most), RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload size of revisits taken from the response they refer to."""
    targets = records.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("target"), F.col("payload_digest").alias("target_digest")).agg(
        F.max("payload_bytes").alias("target_bytes"))
    own, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    met = revisits.join(targets, (F.col("refers_to") == F.col("target"))
                        & (F.col("payload_digest") == F.col("target_digest")), "left")
    columns: list[Column] = [F.col(c) for c in records.columns if c != "payload_bytes"]
    return own.select(*columns, "payload_bytes").unionByName(
        met.select(*columns, F.col("target_bytes").alias("payload_bytes")))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back through the index.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``;
    an empty table gives no rows.
    """
    records = stored(read_records(write_archives(pages)), "warc-records")
    return resolved(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: DuckDB twin of ``archive_round_trip``.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to, url
FROM m
"""
