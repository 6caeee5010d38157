"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlens.session import scratch_path

from . import centroids, decontaminate, extract, idfiles, infill, jaccard, kneser, lines, packing, pii, quality, substrings, toxicity
from .registry import query, table
from .sqltext import CENTROIDS, DECONTAMINATION, INFILL, JACCARD, QUALITY_RULES, REPEATS


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.train(documents, labels)
    scored = toxicity.scores(documents.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), "predicted")


@query("op2_ngram_jaccard_join", JACCARD)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op5_quality_rules", QUALITY_RULES)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "common_words")


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "described")


@query("op8_suffix_array_dedup", REPEATS)
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = kneser.fit(documents.where(~F.col("held_out")))
    return kneser.scores(documents, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", F.col("lm_score").alias("score")
    )


@query("op10_decontamination", DECONTAMINATION)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op11_token_id_files")
def op11_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-id-files")
    documents = table(spark, sf_dir, "documents")
    idfiles.write_ids(documents, path)
    return idfiles.read_ids(spark, path, documents.schema["doc_id"].dataType.simpleString(), ids=False)


@query("op12_fill_in_middle", INFILL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transformed(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256")
    )


@query("op13_centroid_clustering", CENTROIDS)
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.with_inertia(centroids.clustered(table(spark, sf_dir, "embeddings")))
    written_out = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written_out, 256).alias("centroid_sha256"))
