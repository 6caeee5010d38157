import corpus_pipeline
from wearlens.llm import pii
from wearlens.session import written

from . import helpers
from .test_decontaminate import expected as hits
from .test_jaccard import expected as groups
from .test_packing import check


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{helpers.SF}/documents.parquet")
    names = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{helpers.SF}/labels.parquet").where("toxic = 1").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, helpers.SF), name)
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) >= len(before) - 2 * len(toxic) - 5
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, _, c in groups(list(before.items()))}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{helpers.SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(map(str, after)) == {d for d, _, n, _ in hits(list(before.items()), items) if not n}
        if name == "pii":
            assert set(after) == set(before)
            assert not any(pii.base_spans(t or "") for t in after.values())
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, helpers.SF).collect()
    assert check(rows, list(before.items())) < 0.03


def test_rows_are_told_apart_by_number(spark, tmp_path):
    """Null and repeated ids, clashing extra columns, a very long text."""
    from pyspark.sql import functions as F

    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"
    words = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, f"clean one {words}"), (1, f"this holds {item} indeed"), (None, f"that holds {item} too"), (None, "no id here at all but some words follow"),
        (None, "no id here at all but some words follow"), (2, "long " + " ".join(f"x{i}" for i in range(40_000))), (3, f"clean one {words} more"),
    ]
    docs = helpers.texts(spark, rows).select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"),
        *[F.lit(i).alias(c) for i, c in enumerate(("_row", "toxicity", "predicted", "spans", "base", "redacted", "component_id"))],
    )
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{helpers.SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = written(docs, "odd")
    for name in ("toxicity", "ngram_jaccard_join", "decontamination", "pii"):
        before = docs
        docs = written(stages[name](spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns
        assert {tuple(r) for r in docs.select(docs.columns[5:]).distinct().collect()} == {tuple(range(7))}
        left = sorted((str(r.doc_id), r.text[:10]) for r in docs.collect())
        if name == "ngram_jaccard_join":  # one of two copies without an id, and of the near copies the smaller id
            assert left == sorted([("1", "clean one "), ("1", "this holds"), ("None", "that holds"), ("None", "no id here"), ("2", "long x0 x1")])
        if name == "decontamination":
            assert left == sorted([("1", "clean one "), ("None", "no id here"), ("2", "long x0 x1")])


def test_odd_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e g"), (3, "a b c d e f")]
    docs = helpers.texts(spark, rows).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{helpers.SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, None}


def test_stages_leave_no_tables_of_their_searches(spark, tmp_path):
    """Of the near-copy search only the numbers of the rows that stay, of the whole run only what the last stage reads."""
    from pyspark.sql import functions as F

    from wearlens import session

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"one {words}"), (2, f"one {words}"), (3, f"{words} three"), (4, "other words altogether")]
    docs = helpers.texts(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{helpers.SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")

    def made_by(make):
        made = session._MADE.setdefault(spark.sparkContext.applicationId, [])
        before = set(made)
        found = {r.doc_id for r in make().collect()}
        return found, {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made if p not in before}

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert made_by(lambda: corpus_pipeline.drop_near_copies(spark, read, str(tmp_path))) == ({1, 4}, {"numbered", "first-rows"})
    assert made_by(lambda: corpus_pipeline.run(spark, str(tmp_path))) == ({1, 4}, {"stage-pii", "tokenized"})


def test_texts_come_in_small_batches(spark, tmp_path, monkeypatch):
    """Also where the caller writes a stage's rows, and where the near-copy search counts shingles."""
    from wearlens.llm import decontaminate, jaccard, toxicity

    def small(module, name, rows):
        before = getattr(module, name)

        def checked(given, *more):
            for batch in [given] if rows else (given := list(given)):
                assert len(batch) <= 1000
            return before(given if rows else iter(given), *more)

        monkeypatch.setattr(module, name, checked)

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    usual = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        for module in (toxicity, decontaminate, pii):
            small(module, "text_chunks", True)
        for name in ("_sets", "_counters", "_postings"):
            small(jaccard, name, False)
        rows = [(i, f"text {i} of many " + " ".join(f"w{i + j}" for j in range(6))) for i in range(2500)]
        docs = helpers.texts(spark, rows).coalesce(1).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
        spark.createDataFrame([("b1", "words of no text")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.read.parquet(f"{helpers.SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            for k in keys:
                spark.conf.unset(k)
            found = stage(spark, docs, str(tmp_path))
            found.write.parquet(f"{tmp_path}/{name}")
            assert spark.read.parquet(f"{tmp_path}/{name}").count() == 2500
        for k in keys:
            spark.conf.unset(k)
        assert jaccard.linked(docs).count() == 2500
        spark.conf.set(keys[0], "300")  # smaller ones are kept
        corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
        assert spark.conf.get(keys[0]) == "300"
    finally:
        for k, v in zip(keys, usual, strict=True):
            spark.conf.set(k, v)
