"""File readers: run-to-failure text, remaining-life targets, CSV batches, saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import attach_facts
from ..schemas import READING_SCHEMA, UNIT_CYCLE_SCHEMA, require
from ..session import written


def _file_part(pattern: str, group: int):
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def read_cycles(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = UNIT_CYCLE_SCHEMA, names: str | None = None
) -> DataFrame:
    """Whitespace-separated rows without a header; a row with another number of fields fails the job.

    `names`: pattern with two groups over the file path, read as `split` and `fd`.
    """
    fields = schema.fields
    rows = spark.read.text(paths)
    named = [_file_part(names, 1).alias("split"), _file_part(names, 2).alias("fd")] if names else []
    parts = rows.select(F.trim("value").alias("line"), *named).where("line != ''")
    parts = parts.withColumn("parts", F.split("line", r"\s+"))
    wrong = F.raise_error(F.format_string(f"Unexpected column count: expected {len(fields)}, got %d", F.size("parts")))
    checked = F.when(F.size("parts") == len(fields), F.col("parts")).otherwise(wrong.cast("array<string>"))
    values = [
        F.element_at("checked", i + 1).try_cast("double").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)
    ]
    keep = ["split", "fd"] if names else []
    return parts.select(*keep, checked.alias("checked")).select(*keep, *values)


def numbered_lines(spark: SparkSession, paths: str | list[str], per: str = "file") -> DataFrame:
    """`path, number, line`: lines numbered from 1 within their file or, with per="folder", on through the files of a folder in the
    order of their names, which is how Spark writes a sorted frame.

    Large files are read in splits: a line's place in its split is a difference of row ids, and only the splits' numbers of
    lines are added up. Lines of white space at the end are left out, those in between count; an empty file has no lines.
    """
    if per not in ("file", "folder"):
        raise ValueError(f"Lines are numbered per file or folder, not per {per}.")
    # Written, so that ids are the same wherever they are read.
    lines = written(
        spark.read.text(paths).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
            F.col("value").alias("line"),
        ),
        "lines",
    )
    splits = lines.groupBy("path", "block").agg(
        F.min("id").alias("first"),
        F.count(F.lit(1)).alias("lines"),
        F.max(F.when(F.col("line").rlike(r"\S"), F.col("id"))).alias("filled"),
    )
    series = F.col("path") if per == "file" else F.regexp_replace("path", "/[^/]+$", "")
    # One row per split, so a window over all splits of a file is small.
    of_series = W.partitionBy(series)
    before = F.coalesce(F.sum("lines").over(of_series.orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = splits.withColumn("before", before).withColumn("end", F.max(F.col("before") + F.col("filled") - F.col("first") + 1).over(of_series))
    number = F.col("before") + F.col("id") - F.col("first") + 1
    found = attach_facts(lines, placed.select("path", "block", "first", "before", "end"), ["path", "block"], "id", "inner")
    return found.select("path", number.alias("number"), "line", "end").where("number <= end").drop("end")


def read_targets(spark: SparkSession, paths: str | list[str], names: str | None = None, per: str = "file") -> DataFrame:
    """`unit, rul`: the unit is the 1-based line number inside its file, or inside its folder of files (see `numbered_lines`)."""
    lines = numbered_lines(spark, paths, per)
    named = [F.regexp_extract("path", names, 1).alias("fd")] if names else []
    return lines.select(*named, F.col("number").cast("int").alias("unit"), F.trim("line").cast("int").alias("rul"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a given schema; no inference pass."""
    return spark.read.schema(schema).option("header", True).csv(path)


def load_dataset(
    spark: SparkSession,
    root: str,
    source: str = "nasa",
    fd: str = "FD001",
    table_name: str = "predictive_maintenance",
    schema: T.StructType | str = READING_SCHEMA,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Train rows, test rows and test targets of a source; a single-table source has train rows only."""
    if source == "nasa":
        folder = f"{root}/CMaps"
        train, test = (read_cycles(spark, f"{folder}/{split}_{fd}.txt") for split in ("train", "test"))
        return train, test, read_targets(spark, f"{folder}/RUL_{fd}.txt", per="folder")
    if source == "kaggle":
        return read_csv(spark, f"{root}/Kaggle/{table_name}.csv", schema), None, None
    raise ValueError(f"No reader for {source}.")


def newest_folder(spark: SparkSession, pattern: str) -> str | None:
    """The most recently written folder among those of a path pattern, by the times of its files; the name decides between equal
    times. Spark lists the files; their content is not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    folder = F.regexp_replace("path", "/[^/]+$", "")
    times = files.groupBy(folder.alias("folder")).agg(F.max("modificationTime").alias("time"))
    return times.agg(F.max_by("folder", F.struct("time", "folder"))).first()[0]


def read_newest(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of the newest run folder; only that folder is scanned."""
    folder = newest_folder(spark, pattern)
    if folder is None:
        raise FileNotFoundError(f"No files in {pattern}.")
    return spark.read.parquet(folder)


def read_saved(spark: SparkSession, path: str, required: list[str], form: str = "parquet", schema=None) -> DataFrame:
    """Saved predictions, scores or schedules; raises when a required column is absent."""
    df = spark.read.parquet(path) if form == "parquet" else read_csv(spark, path, schema)
    require(df, required, "read saved results")
    return df
