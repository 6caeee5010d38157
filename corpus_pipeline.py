"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlens.llm import decontaminate, jaccard, packing, pii, toxicity
from wearlens.llm.spread import IN_BATCH, IN_SCAN, limit_rows
from wearlens.session import written, written_alone

#: Classifiers and retrieval are not expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


#: Rows are told apart by number inside a stage: ids may be null or repeated.
ROW = "row_number"


def _by_place(docs: DataFrame) -> DataFrame:
    """Columns other than the text named by their place, so that none clashes with what is added."""
    return docs.toDF(*[c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows, columns named by place, with a number each; written, so that numbers are the same wherever they are read."""
    return written(_by_place(docs).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def few_texts(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with few whole texts in a batch, for Python as for the readers of tables. The settings stay in the session, since the
    stage's rows are made when its caller writes them; smaller ones are kept."""

    @functools.wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key in (IN_BATCH, IN_SCAN):
            limit_rows(docs.sparkSession, key)
        return stage(spark, docs, sf_dir)

    return limited


@few_texts
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of two thirds of the ids."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity.scores(_by_place(docs), toxicity.train(docs, labels))
    return scored.where("predicted = 0").drop("toxicity", "predicted").toDF(*docs.columns)


@few_texts
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the first one of the smallest id; a null id counts as the largest."""
    rows = _numbered(docs)
    doc_id = F.col(f"column_{docs.columns.index('doc_id')}")
    order = F.struct(doc_id.isNull(), doc_id, ROW)

    def first() -> DataFrame:
        linked = jaccard.linked(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
        return linked.join(rows.select(ROW, doc_id), ROW).groupBy("component_id").agg(F.min_by(ROW, order).alias(ROW)).select(ROW)

    # numbers alone are kept of what the search has written: its sets and postings would lie there up to the last stage
    return rows.join(written_alone(spark, first, "first-rows"), ROW, "left_semi").drop(ROW).toDF(*docs.columns)


@few_texts
def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows = _numbered(docs)
    found = decontaminate.contaminated_words(rows.select(F.col(ROW).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias(ROW)), ROW, "left_anti").drop(ROW).toDF(*docs.columns)


@few_texts
def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data; a null text stays null, and n_chars follows the text."""
    found = pii.private_spans(_by_place(docs))
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    number = f"column_{docs.columns.index('n_chars')}"
    chars = F.when(F.size("spans") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(number))
    return found.withColumns({number: chars, "text": text}).drop("base", "spans", "redacted").toDF(*docs.columns)


@few_texts
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens in sequences of one window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Rows of equal or null ids are documents of their own."""
    return packing.sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("pii", redact_private),
    ("packing", pack),
]


def _left(spark: SparkSession, sf_dir: str, done: int) -> DataFrame:
    """The documents after so many stages, written; what the stages have read and written before is removed by then."""
    if not done:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    name, stage = STAGES[done - 1]
    return written_alone(spark, lambda: stage(spark, _left(spark, sf_dir, done - 1), sf_dir), f"stage-{name}")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table of documents, one after another; each is written before the next one reads it. No rows
    give no rows; extra columns are carried up to the last stage."""
    return STAGES[-1][1](spark, _left(spark, sf_dir, len(STAGES) - 1), sf_dir)
