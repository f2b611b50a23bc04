from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc as W
from ledgerlens.llm._files import opened
from tests.llm.conftest import rows_of

PAGES = "page_id long, url string, html string"
BIG, LONG = "<p>" + "x" * 120, "é" * 200_000


def pages(spark):
    return spark.createDataFrame([
        (5, "http://a/\r\nInjected: 1", BIG), (3, "http://b", BIG), (9, None, BIG), (1, "http://c", "tiny"),
        (2, "http://d", "tiny"), (4, "http://e", None), (6, "http://f", ""), (7, "%41\x00", LONG), (8, "u", LONG),
        (None, "n", BIG), (None, "n", "WARC/1.1\r\n\r\n" * 30), (3, "http://b", BIG),
        (2 ** 60 + 1, "http://big", "y" * 100), (2 ** 60 + 3, "http://big", "y" * 100)], PAGES).withColumn("digest", F.lit(1))


def plain(rows):
    out = []
    payloads = [(r[0], r[1], (r[2] or "").encode()) for r in rows]
    for page_id, url, payload in payloads:
        ids = [i for i, _, p in payloads if p == payload and i is not None]
        low = min(ids) if len(payload) >= 100 and ids else None
        refers = low if low is not None and page_id != low else None
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(),
                    "response" if refers is None else "revisit", refers, url))
    return sorted(out, key=repr)


def test_round_trip(spark):
    assert rows_of(W.archive_round_trip(pages(spark))) == plain(pages(spark).drop("digest").collect())


def test_empty_table(spark):
    assert W.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_archives_are_gzip_members_and_the_index_selects(spark):
    index = W.write_archives(pages(spark))
    row = index.where("page_id = 7").first()
    system, path = opened(row["archive"])
    whole = system.open_input_file(path).read()
    member = whole[row["offset"]:row["offset"] + row["length"]]
    fields, payload = W.parse_record(gzip.decompress(member))
    assert payload == LONG.encode() and fields["warc-type"] == "response"
    some = W.read_records(index.where("page_id in (1, 8)")).collect()
    assert sorted(r["page_id"] for r in some) == [1, 8]


def test_damage_is_found(spark):
    raw = W.make_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    with pytest.raises(ValueError):
        W.parse_record(raw[:-6])
    with pytest.raises(ValueError):
        W._as_row(*W.parse_record(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")))


def test_ranges_join_up_to_gap_and_size():
    assert W.coalesce([(0, 10), (10, 5), (20, 5), (100, 10)], gap=5, most=1000) == [(0, 25, 0, 3), (100, 110, 3, 4)]
    assert W.coalesce([(0, 10), (10, 10), (20, 10)], gap=0, most=20) == [(0, 20, 0, 2), (20, 30, 2, 3)]
    assert W.coalesce([], 1, 1) == []
