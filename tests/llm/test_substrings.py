import hashlib
import random

from pyspark.sql import functions as F

from wearlens.llm import substrings
from wearlens.llm.catalog import QUERIES

from . import helpers


def expected(rows):
    owners = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            if doc is not None and doc < owners.get(w, doc + 1):
                owners[w] = doc
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if doc is not None and owners[b[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(doc), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(frame):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def test_against_all_windows(spark):
    r = random.Random(2)

    def fresh(n):
        return "".join(r.choice("abcdé \n") for _ in range(n))

    shared = [fresh(r.choice((49, 50, 51, 80, 300))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice((fresh(r.randint(0, 60)), r.choice(shared), r.choice(shared)[r.randint(0, 20) :])) for _ in range(r.randint(0, 5))]
        rows.append((i * 37 % 61, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "a" * 60), (104, "ab" * 90), (105, "ba" * 40), (7, rows[3][1]), (None, rows[4][1]), (200, rows[5][1]), (200, rows[5][1])]
    docs = helpers.texts(spark, rows).withColumn("same", F.lit("x")).withColumn("zipped", F.lit(1))
    assert rows_of(substrings.without_repeats(docs)) == expected(rows)


def test_segments_agree(spark, monkeypatch):
    import pyarrow as pa

    from wearlens.llm.textscan import text_chunks

    chunk = next(text_chunks(pa.array(["".join(random.Random(8).choice("abc ") for _ in range(3000)), "", "x" * 20, "q" * 500])))
    whole = substrings.anchors(chunk)
    monkeypatch.setattr(substrings, "SEGMENT", 256)
    parts = substrings.anchors(chunk)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_no_rows(spark):
    assert substrings.without_repeats(helpers.texts(spark, [])).count() == 0


def test_query(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op8_suffix_array_dedup"](spark, helpers.SF)) == expected(docs)
