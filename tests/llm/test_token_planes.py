from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import _files, token_planes as T
from tests.llm.conftest import messy_rows, prose, rows_of


@pytest.fixture(scope="module")
def spec():
    with open(T.tokenizer_path(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def model(spec):
    found = Tokenizer.from_str(spec)
    found.encode_special_tokens = True
    return found


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "\n\na b\n\n", "x\n", "x\n y", "tab\t and\u00a0 nbsp\u2003 em",
       "don't we'll I'm  they're", "<|endoftext|> in the text", "ĠĠ Ġ word Ġa", "naïve café \U0001F600 日本語 のテキスト", "1234 56 7 a1b2",
       "end.  ", "\x1c \x1d x", "a b  c d", "\u3000 x y", "a\u0085 b", "mixed\r\n lines\r\n\r\n here"]


def test_words_are_encoded_as_in_the_whole_text(spec, model):
    rng = random.Random(2)
    texts = ODD + [prose(rng, "fr", 40) + rng.choice(["\n", "  ", " ", ".", "\t x"]) + prose(rng, "de", 9) for _ in range(60)]
    texts += ["".join(rng.choices("ab \n\t.'sĠ\u00a0é", k=rng.randint(0, 30))) for _ in range(3000)]
    encode = T.Encoder(spec)
    assert encode.by_words
    for _ in range(2):  # the second time every word is known
        ids, sizes = encode(texts)
        got = np.split(ids, np.cumsum(sizes)[:-1])
        assert [g.tolist() for g in got] == [e.ids + [0] for e in model.encode_batch(texts, add_special_tokens=False)]


def test_words_are_cut_before_commas_and_full_stops(spec, model):
    """A word is encoded once, whatever comma or full stop follows it, and the tokenizer is read once."""
    texts = ["x " + " ".join(f"{w}{end}" for w in ("alpha", "bêta", "Gamma") for end in ("", ",", ".", ".\nThen", "...", ",'s x"))]
    texts += ["1.5 a.b, c. ,d .e é,ß. Д, 中. ﬁ. ª, 's, don't. it's, x,'s ),a. \x01, a \x01b, a\x01,", "a.,b\n,c \n.d", ", . a ,", "a,", "×, ÷. ɏ, ɐ,"]
    encode = T.Encoder(spec)
    for _ in range(2):
        ids, _ = encode(texts)
        assert ids.tolist() == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids + [0]]
    assert sum(w in ("alpha", "alpha,", "alpha.", "alpha...") for w in encode.numbers) == 1
    assert T.Encoder(spec).model is encode.model


def test_white_space_before_spaces_is_found(spec):
    """The white space that keeps a text whole is all that Python knows."""
    texts = [f"a{chr(c)} b" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    found = pa.compute.match_substring_regex(pa.array(texts, pa.string()), T.Encoder._UNSAFE).to_pylist()
    assert found == [t[1].isspace() or t[1] == T._MARK for t in texts]


def test_common_words_change_nothing(spark, spec, model, messy):
    common = T.common_words(messy, spec, most=300)
    assert len(common.size) == 300 == len(common.words.split(" ")) and common.size.sum() == len(common.ids)
    texts = [r["text"] or "" for r in messy.collect()] + ODD
    ids, sizes = T.Encoder(spec, 0, common)(texts)
    assert ids.tolist() == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids + [0]]


def test_word_cache_starts_over(spec, model, monkeypatch):
    monkeypatch.setattr(T, "_CACHED_WORDS", 10)
    encode, rng = T.Encoder(spec), random.Random(3)
    for _ in range(5):
        texts = [prose(rng, "en", 12) for _ in range(4)]
        ids, _ = encode(texts)
        assert ids.tolist() == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids + [0]]


@pytest.mark.parametrize("unit_bits", [1, 8])
def test_planes_give_the_ids_back(unit_bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        planes = T.to_planes(ids, unit_bits)
        assert len(planes) == 32 // unit_bits
        assert T.from_planes(planes, n, unit_bits).tolist() == ids.tolist()
    one = T.to_planes(np.array([1 << 9, 0, 1 << 9], np.uint32), 1)
    assert one[9] == bytes([0b101]) and sum(map(sum, one)) == 0b101


def plain(rows, model):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    ids = [model.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in order]
    return [(r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(order, ids)]


@pytest.mark.parametrize("options", [{}, {"unit_bits": 1, "chunk_ids": 256}, {"chunk_ids": 7, "file_bytes": 3000}])
def test_round_trip_of_messy_documents(spark, clashing, model, options):
    """Small chunks: documents run over many of them; small files: the stream runs over many files."""
    found = rows_of(T.token_round_trip(clashing.repartition(5), **options))
    assert sorted(((r[0], r[2], r[3]) for r in found), key=repr) == sorted(plain(messy_rows(), model), key=repr)
    found.sort(key=lambda r: r[1])
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found])[:-1].tolist()
    ids = [r[0] for r in found if r[0] is not None]
    assert ids == sorted(ids) and all(r[0] is None for r in found[len(ids):])


def test_ids_and_empty_table(spark, messy, no_docs, model):
    assert T.token_round_trip(no_docs).collect() == []
    some = messy.where("doc_id < 20")
    got = {r["doc_id"]: r["ids"] for r in T.read_tokens(T.write_tokens(some)).collect()}
    assert got == {r["doc_id"]: model.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in some.collect()}


def test_hot_id_is_spread(spark):
    """A third of the rows share a null id, another third id and text: they do not meet in one file."""
    rows = [(None, f"text {i}") for i in range(400)] + [(5, "same text")] * 400 + [(i, "x y") for i in range(10, 410)]
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")  # tables this small would become one partition
    try:
        index = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    finally:
        spark.conf.set(conf, "true")
    assert index.where("n_docs > 700").count() == 0
    assert index.select("file").distinct().count() > 1
    found = T.read_tokens(index, summary=True)
    assert found.count() == 1200
    assert found.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]


def test_files_describe_themselves_and_damage_is_found(spark, messy):
    index = T.write_tokens(messy, chunk_ids=512).orderBy("part", "first").collect()
    system, path = _files.opened(index[0]["file"])
    raw = system.open_input_file(path).read()
    reader = T.PlaneReader.of(pa.BufferReader(raw))
    mine = [r for r in index if r["file"] == index[0]["file"]]
    assert reader.index["offset"].tolist() == [r["offset"] for r in mine]
    assert reader.index["crc32"].tolist() == [r["crc32"] for r in mine]
    at = mine[0]["offset"] + 30
    broken = T.PlaneReader.of(pa.BufferReader(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1:]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.chunk(0)
    with pytest.raises(ValueError):
        T.PlaneReader.of(pa.BufferReader(raw[:-1] + b"x"))


def test_scheme_rule():
    assert _files.task_uri("file:/tmp/x") == "file:///tmp/x" == _files.task_uri("file:///tmp/x")
    assert _files.task_uri("s3a://bucket/x") == "s3://bucket/x" and _files.task_uri("hdfs://h:1/x") == "hdfs://h:1/x"
    for uri in ("/tmp/x", "tmp/x", "wasb://c@a/x"):
        with pytest.raises(ValueError):
            _files.task_uri(uri)


def test_folder_without_a_scheme_is_the_default_file_system(spark):
    from ledgerlens.session import qualified
    assert qualified(spark, "/tmp/x").startswith("file:/") and qualified(spark, "file:/tmp/x").startswith("file:/")
