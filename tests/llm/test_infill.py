import hashlib
import random

from pyspark.sql import functions as F

from wearlens.llm import infill
from wearlens.llm.catalog import QUERIES

from . import helpers


def plain(doc, text, seed=1):
    """doc_id, n, form, prefix_chars, middle_chars, output of one document."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ODD = [
    "", None, " ", "\n", "a", "é", "😀", "a😀\n\r b", "$1 \\ {3} $", "x" * 1023, "x" * 1024, "y😀" * 1024, "z" * 300_000, "<P>", "a <S> b", "<M", "<<<P", "<S<P<M",
    "é‍\U0001f469", "\x00\x01", "</S>",
]


def test_against_plain_cutting(spark):
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(t for t in ODD for _ in range(7))]
    rows += [(1000 + i, "".join(r.choice("ab<>PSM😀\n$\\{}") for _ in range(r.randint(0, 40)))) for i in range(600)]
    rows += [(None, "no id"), (3, "same id"), (3, "same id"), (3, "another text")]
    docs = helpers.texts(spark, rows).withColumn("n", F.lit("x")).withColumn("form", F.lit("x")).withColumn("h1", F.lit(1))
    found = infill.transformed(docs).withColumn("back", infill.restored()).collect()
    assert sorted((tuple(f)[:6] for f in found), key=str) == sorted((plain(d, t) for d, t in rows), key=str)
    assert sorted(f.back for f in found) == sorted(t or "" for _, t in rows)
    assert {f.form for f in found} == {"plain", "psm", "spm"}


def test_parameters_and_no_rows(spark):
    docs = helpers.texts(spark, [(i, f"text number {i}") for i in range(50)])
    assert {f.form for f in infill.transformed(docs, plain_from=100, spm_below=100).collect()} == {"spm"}
    assert {f.form for f in infill.transformed(docs, plain_from=0).collect()} == {"plain"}
    assert [tuple(f) for f in infill.transformed(docs, seed=7).orderBy("doc_id").limit(3).collect()] != [plain(i, f"text number {i}") for i in range(3)]
    assert infill.transformed(docs.limit(0)).count() == 0


def test_stays_in_built_in_functions(spark):
    plan = QUERIES["op12_fill_in_middle"](spark, helpers.SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, helpers.SF).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*p[:5], sha(p[5]), sha(t or "")) for p, t in ((plain(d, t), t) for d, t in docs)]
    assert found == sorted(want)
