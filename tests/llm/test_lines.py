import re
from collections import Counter

from pyspark.sql import functions as F

from wearlens.llm import lines
from wearlens.llm.catalog import QUERIES

from . import helpers


def base(text):
    text = text or ""
    w = helpers.SPACED.findall(text)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if helpers.SPACED.search(line):
            doubled += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found in [base(t) for d, t in texts if d == r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op5_quality_rules"](spark, helpers.SF).collect(), texts)


def test_case_and_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "a b c A b c a b c"), (4, "Ab aB ab Ab aB ab"), (5, "x y\nx y\n\nX y\n x y"), (6, "é#é\té é\n é"), (6, "twice"), (None, "no id")]
    docs = helpers.texts(spark, texts).withColumn("source", F.lit(None).cast("string")).withColumn("row", F.lit("x")).withColumn("copy", F.lit(1))
    check(lines.judged(docs).collect(), texts)
    assert lines.judged(docs.limit(0)).count() == 0


def test_common_lines_deplete(spark):
    def text(i, common):
        own = " ".join(f"own{i}x{j}" for j in range(40))
        return own + "\n" + "\n".join(f"Common line number {j} of the  site" for j in range(common))

    rows = [(i, text(i, 12 if i < 30 else 0), "a") for i in range(100)] + [(200 + i, text(300, 12), "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in lines.judged(docs).collect()}
    assert all(found[i].depleted and found[i].common_words == 84 for i in range(30))
    assert not any(found[i].depleted for i in range(30, 100))
    # fifty copies of one text are one document of their host
    assert not any(found[200 + i].depleted for i in range(50))


def test_limit_grows_like_the_root_of_the_host(spark):
    """1 600 texts of one host, limit 40: a line held by 41 of them goes, one held by 40 stays, though both are below 3 %."""

    def text(i):
        own = " ".join(f"own{i}x{j}" for j in range(30))
        return own + ("\nHeld by forty one texts" * 9 if i < 41 else "\nHeld by just forty texts" * 9 if i < 81 else "")

    rows = [(i, text(i), None) for i in range(1_600)] + [(5_000 + i, text(i), "small") for i in range(19)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in lines.judged(docs).collect()}
    assert all(found[i].common_words == (45 if i < 41 else 0) for i in range(1_600))
    assert all(found[i].depleted == (i < 41) for i in range(1_600))
    assert all(found[5_000 + i].common_words == 0 for i in range(19))
