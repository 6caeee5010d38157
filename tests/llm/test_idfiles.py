import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wearlens.llm import idfiles
from wearlens.llm.catalog import QUERIES
from wearlens.session import scratch_path

from . import helpers


def plain_ids(texts, name=idfiles.TOKENIZER):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def expected(rows):
    """(doc_id, start, n_tokens, crc) for distinct ids."""
    rows, at, out = sorted(rows, key=lambda r: (r[0] is not None, r[0])), 0, []
    for (doc, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", range(1, 33))
def test_any_width_round_trips(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = r.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        raw = idfiles.pack(ids, bits)
        assert len(raw) == -(-n // 8) * bits and np.array_equal(idfiles.unpack(raw, n, bits), ids)
        value = int.from_bytes(raw, "little")  # least significant bit first, nothing between ids
        assert [(value >> (i * bits)) & ((1 << bits) - 1) for i in range(min(n, 50))] == ids[:50].tolist()


def test_fewest_bits():
    assert [idfiles.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("bits", (13, 16, 17))
def test_random_access_reads_its_blocks_only(bits):
    r = np.random.default_rng(1)
    ids = [r.integers(0, 1 << bits, n).astype(np.uint32) for n in (5, 9000, 1, 4096, 12000)]
    raw = idfiles.file_bytes(pa.array([3, 4, 5, 6, 7]), ids, bits)
    file = idfiles.PackedFile(raw)
    for i, x in enumerate(ids):
        assert np.array_equal(file.document(i), x)
    flat = np.concatenate(ids)
    for a, b in ((0, 1), (4095, 4097), (8000, 8000), (100, 25000), (len(flat) - 1, len(flat))):
        assert np.array_equal(file.ids(a, b), flat[a:b])
    broken = bytearray(raw)  # another block's bytes do not matter
    broken[-(idfiles.BLOCK * bits // 8) :] = bytes(idfiles.BLOCK * bits // 8)
    assert np.array_equal(idfiles.PackedFile(bytes(broken)).document(0), ids[0])
    with pytest.raises(ValueError):
        idfiles.PackedFile(b"x" * 100)


def test_words_encode_as_the_text():
    r, e = random.Random(3), idfiles.WordEncoder(idfiles.TOKENIZER)
    assert e.by_word and e.bits == 16
    letters = "abZ\x01'sΣσ́é \n\t\r\x0b\x1c\x85 　.,1 "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["<|endoftext|> a<|startoftext|>"]
    ids, bounds = e.encode(texts)
    for i, x in enumerate(plain_ids(texts)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == x
    texts = [t.replace("\x01", "") for t in texts]  # now words are learned together
    ids, bounds = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == plain_ids(texts)
    other = idfiles.WordEncoder("byte_bpe_50k.json")  # tokens cross spaces there
    ids, bounds = other.encode(texts)
    assert not other.by_word and [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == plain_ids(texts, "byte_bpe_50k.json")


def test_files_round_trip(spark):
    rows = [(9, None), (2, ""), (-3, " "), (4, "a"), (5, "a  b\n c"), (6, "<|endoftext|> 12,5"), (7, "x y " * 30000), (None, "none"), (8, "é ü　ñ")]
    docs = helpers.texts(spark, rows).withColumn("row", F.lit("x")).withColumn("part", F.lit(1)).withColumn("packed", F.lit(2))
    path = scratch_path(spark, "ids")
    idfiles.write_ids(docs, path, segment=1000)
    found = idfiles.read_ids(spark, path).collect()
    assert sorted((tuple(r[:4]) for r in found), key=lambda r: r[1]) == expected(rows)
    assert {r.doc_id: r.ids for r in found} == dict(zip([d for d, _ in rows], plain_ids([t for _, t in rows]), strict=True))
    part = next(p for p in spark.read.format("binaryFile").load(path).select("path").toPandas().path)
    with open(part.removeprefix("file:"), "rb") as f:  # the files are plain files of the format
        assert f.read(8) in (idfiles.MAGIC, b"")


def test_equal_ids_no_rows_and_other_kinds(spark):
    rows = [(1, "b c"), (1, "a"), (1, "a"), (0, "z"), (2, "q")]
    path = scratch_path(spark, "ids")
    idfiles.write_ids(helpers.texts(spark, rows), path)
    found = sorted(idfiles.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [0, 1, 1, 1, 2] and sorted(r.ids for r in found) == sorted(plain_ids([t for _, t in rows]))
    at = 0
    for r in found:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    path = scratch_path(spark, "ids")
    idfiles.write_ids(helpers.texts(spark, []), path)
    assert idfiles.read_ids(spark, path).count() == 0
    path = scratch_path(spark, "ids")
    idfiles.write_ids(helpers.texts(spark, [("b", "x"), ("a", None)], "doc_id string, text string"), path)
    assert [tuple(r) for r in idfiles.read_ids(spark, path, "string", ids=False).orderBy("start").select("doc_id", "start", "n_tokens").collect()] == [("a", 0, 1), ("b", 1, 2)]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_token_id_files"](spark, helpers.SF)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == expected(docs)
