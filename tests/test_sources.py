"""Line numbers of files that are read in many splits."""

import pytest
from pyspark.sql import functions as F

from wearlens.session import scratch_path
from wearlens.sources import files as sf


@pytest.fixture
def small_splits(spark):
    names = {
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # a sorted frame is written to several files
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def numbers(df):
    return {(r["path"].rsplit("/", 1)[1], r["number"]): r["line"] for r in df.collect()}


def test_lines_of_many_splits_are_numbered(spark, small_splits, tmp_path):
    long = [str(i * 7919 % 1000) for i in range(200_000)]
    (tmp_path / "a.txt").write_text("\n".join(long))
    (tmp_path / "b.txt").write_text("4\r\n\r\n5\r\n \r\n\r\n")  # white space at the end is no line, in between it is
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.txt").write_text("\n \n")
    assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 8
    got = numbers(sf.numbered_lines(spark, str(tmp_path)))
    want = {("a.txt", i + 1): x for i, x in enumerate(long)} | {("b.txt", 1): "4", ("b.txt", 2): "", ("b.txt", 3): "5"}
    assert got == want


def test_lines_are_numbered_through_a_folder(spark, small_splits):
    path = scratch_path(spark, "ordered")
    rows = spark.range(0, 60_000, 1, 5).select(F.xxhash64("id").alias("place"), "id")
    rows.orderBy("place").select(F.col("id").cast("string").alias("value")).write.text(path)
    assert len({r["path"] for r in sf.numbered_lines(spark, path).select("path").distinct().collect()}) > 1
    targets = sf.read_targets(spark, path, per="folder")
    got = [r["rul"] for r in targets.orderBy("unit").collect()]
    assert got == [r["id"] for r in rows.orderBy("place").collect()]
    assert targets.agg(F.min("unit"), F.max("unit"), F.countDistinct("unit")).first()[:] == (1, 60_000, 60_000)


def test_no_lines_and_unknown_numbering(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert sf.read_targets(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="per page"):
        sf.numbered_lines(spark, str(tmp_path), per="page")
