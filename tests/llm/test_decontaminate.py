import random

import duckdb
from pyspark.sql import functions as F

from wearlens.llm import decontaminate
from wearlens.llm.catalog import QUERIES, SQL

from . import helpers


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = helpers.alnum(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = helpers.alnum(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((str(doc), len(w), len(hit), sorted(found)))
    return sorted(out)


def rows_of(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in frame.collect())


def test_against_all_windows(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["Ü", "ño"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 4, 5, 9, 10, 11, 30))))) for i in range(25)]
    items += [(3, items[5][1]), (None, "w1 w2"), (90, None), (91, "--"), (92, items[5][1].upper())]
    docs = []
    for i in range(60):
        text = [r.choice(words) for _ in range(r.randint(0, 40))]
        if i % 2:
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(w))
            text[5:5] = w[a : a + r.randint(0, 20)]
        docs.append((i, ", ".join(text)))
    docs += [(70, None), (71, ""), (1, docs[1][1]), (None, docs[3][1])]
    frame = helpers.texts(spark, docs).withColumn("windows", F.lit("x")).withColumn("item_id", F.lit(1)).withColumn("n_hit", F.lit(5))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F.lit("x"))
    assert rows_of(decontaminate.contaminated_words(frame, bench)) == expected(docs, items)


def test_empty_tables(spark):
    docs, bench = helpers.texts(spark, [(1, "a b")]), spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(decontaminate.contaminated_words(docs, bench)) == [("1", 2, 0, [])]
    assert decontaminate.contaminated_words(docs.limit(0), bench).count() == 0


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{helpers.SF}/{t}.parquet'")
    result = con.execute(SQL["op10_decontamination"])
    names = [d[0] for d in result.description]
    found = QUERIES["op10_decontamination"](spark, helpers.SF).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(result.fetchall())
