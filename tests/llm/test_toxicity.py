import numpy as np
from pyspark.sql import functions as F

from wearlens.llm import toxicity
from wearlens.llm.catalog import QUERIES

from . import helpers


def corpus(n=240):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(5, 60)))
        if i % 4 == 0:
            words[int(rng.integers(len(words)))] = f"snarlo{'abcdefg'[i % 7]}"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_held_out_accuracy_and_unseen_forms():
    rows = corpus(600)
    model = toxicity.fit([t for _, t, _ in rows[:480]], np.array([y for *_, y in rows[:480]]))
    net = toxicity.Net.of(model["net"])
    batch = toxicity._batch([t for _, t, _ in rows[480:]])
    found = net.logits(batch) >= model["cuts"][batch.language]
    assert (found == np.array([y for *_, y in rows[480:]])).mean() > 0.95


def test_nulls_empty_texts_and_clashing_columns(spark):
    labelled = corpus(120)
    docs = helpers.texts(spark, [(i, t) for i, t, _ in labelled] + [(None, None), (900, ""), (901, "   "), (900, "")])
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(900, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, 50, 60)
    found = toxicity.scores(docs.withColumn("toxicity", F.lit("x")).withColumn("score", F.lit(1)), model).collect()
    assert len(found) == 124 and all(0 <= r.toxicity <= 1 and r.score == 1 for r in found)
    assert len({r.toxicity for r in found if not (r.text or "").strip()}) == 1


def test_empty_tables(spark):
    docs, labels = helpers.texts(spark, []), spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.scores(docs, model).count() == 0
    assert toxicity.scores(helpers.texts(spark, [(1, "a b")]), model).count() == 1


def test_query_keeps_rows_and_split(spark):
    import zlib

    rows = QUERIES["op1_toxicity"](spark, helpers.SF).collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_thresholds_follow_the_class_ratio_of_all_labels(spark):
    """Half of the toxic texts have a word that a tenth of the clean ones have too: worth a cut in the capped sample only."""
    rng = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(5000):
        toxic = i % 25 == 0
        sign = ("hardsnarl" if i % 50 == 0 else "softsnarl") if toxic else "softsnarl" if i % 10 == 3 else "mild"
        rows.append((i, " ".join([*rng.choice(plain, 12), sign, *rng.choice(plain, 5)]), int(toxic)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    docs = helpers.texts(spark, [r[:2] for r in rows])
    model = toxicity.train(docs, labels, 120, 120)
    found = {r.doc_id: (r.toxicity, r.predicted) for r in toxicity.scores(docs, model).collect()}
    fresh = [r for r in rows if toxicity._text_key(r[1]) not in set(model["fitted"].tolist())]
    y = np.array([r[2] for r in fresh])
    score, predicted = (np.array([found[r[0]][k] for r in fresh]) for k in (0, 1))
    weight = np.where(y == 1, 200 / (y == 1).sum(), 4800 / (y == 0).sum())

    def f1(accepted):
        return 2 * weight[accepted & (y == 1)].sum() / (weight[accepted].sum() + 200)

    assert f1(predicted == 1) > 0.95 * max(f1(score >= c) for c in np.unique(score))


def test_a_model_holds_only_what_the_fit_has_changed():
    """Rows of the tables that no text touched come from the seed, not with the model."""
    import pickle

    rows = corpus(120)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert len(pickle.dumps(model)) < 1 << 20
    net, start = toxicity.Net.of(pickle.loads(pickle.dumps(model["net"]))), toxicity.Net()
    changed = (net.table != start.table).any(2)
    assert 0 < changed.sum() <= sum(map(len, model["net"]["slots"])) and not (changed & ~net.changed).any()
    assert all(np.array_equal(table[slots], kept) for table, slots, kept in zip(net.table, model["net"]["slots"], model["net"]["rows"], strict=True))


def test_the_start_is_the_one_drawn_at_once():
    whole = np.random.default_rng(7).normal(0, 0.1, (toxicity.TABLES, 1 << toxicity.SLOTS, toxicity.DIM)).astype(np.float32)
    whole[:, 0] = 0
    assert np.array_equal(toxicity.Net().table, whole)
