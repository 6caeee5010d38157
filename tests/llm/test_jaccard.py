import itertools
import random

from pyspark.sql import functions as F

from wearlens.llm import jaccard
from wearlens.llm.catalog import QUERIES

from . import helpers


def shingles(text):
    w = helpers.spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_against_all_pairs(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    passage = r.sample(words, 40)
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(3, 120))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.choice((1, 1, 2, 9))):
            text = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one two"), (1, rows[0][1]), (1, rows[0][1])]
    docs = helpers.texts(spark, rows).withColumn("node", F.lit("x")).withColumn("set", F.lit(2))
    found = sorted(tuple(x) for x in jaccard.linked(docs).collect())
    want = expected([(d, t) for d, t in rows if d < 2000 or d > 2002]) + [(d, 0, d) for d in (2000, 2001, 2002)]
    assert found == sorted(want)


def test_no_rows_and_null_id(spark):
    assert jaccard.linked(helpers.texts(spark, [])).count() == 0
    found = jaccard.linked(helpers.texts(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_members_that_fail_their_leader(spark):
    """Excerpts and edits of one text, with shared passages besides: many pairs link only through what their leader lacks."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base, rows = r.sample(words, 200), []
    extras = [r.sample(words, 60) for _ in range(4)]
    for i in range(160):
        a, n = r.randint(0, 80), r.randint(60, 140)
        text = base[a : a + n] if i % 2 else list(base)
        for _ in range(r.randint(0, 9)):
            text[r.randrange(len(text))] = r.choice(words)
        if i % 3:
            text += extras[i % 4][: r.randint(10, 60)]
        rows.append((i, " ".join(text)))
    assert sorted(tuple(x) for x in jaccard.linked(helpers.texts(spark, rows)).collect()) == expected(rows)


def test_tables_grow_with_the_input():
    assert [jaccard.sketch_bits(n) for n in (0, 1 << 28, 1 << 30, 1 << 34, 1 << 60)] == [20, 20, 21, 23, 24]
    import numpy as np

    assert jaccard.slots(np.array([0, (1 << 40) - 1], np.uint64), 1 << 22).tolist() == [0, (1 << 22) - 1]


def test_prefixes_share_enough():
    import numpy as np

    table = np.zeros(1 << jaccard.SKETCH, np.float32)
    r = np.random.default_rng(1)
    table[:] = r.integers(1, 50, len(table))
    for _ in range(200):
        common = r.integers(0, 1 << 40, 90, dtype=np.uint64)
        a = np.unique(np.concatenate([common, r.integers(0, 1 << 40, r.integers(0, 15), dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, r.integers(0, 1 << 40, r.integers(0, 15), dtype=np.uint64)]))
        (p, k, _), (q, m, _) = jaccard.prefix(a, table, 1.0), jaccard.prefix(b, table, 1.0)
        assert len(np.intersect1d(p, q)) >= min(k, m)


def test_query(spark):
    docs = spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(tuple(x) for x in QUERIES["op2_ngram_jaccard_join"](spark, helpers.SF).collect())
    assert found == expected([tuple(d) for d in docs])
