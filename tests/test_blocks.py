"""Compaction into blocks: nothing is lost over any sequence of cutoffs, schemas and failures."""

import datetime

import pytest
from pyspark.sql import functions as F

from wearlens.sinks import blocks as bl
from wearlens.sinks import tables as st

SCHEMA = "event_time timestamp, equipment_id string, run_id string, a double"


def days(spark, first, last, hour=0, extra=False):
    rows = [(datetime.datetime(2024, 1, d, hour), f"e{d}", "r", float(d)) for d in range(first, last + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("b", F.col("a") * 2) if extra else df


def whole(spark, hot, cold):
    """All rows of both tables as (day, hour, a, b)."""
    parts = [bl.read_blocks(spark, cold)]
    try:
        parts.append(spark.read.option("mergeSchema", True).parquet(hot))
    except Exception:  # every day was moved
        pass
    rows = []
    for df in parts:
        if df is not None:
            b = F.col("b") if "b" in df.columns else F.lit(None).cast("double")
            rows += [tuple(r) for r in df.select(F.dayofmonth("event_time"), F.hour("event_time"), "a", b).collect()]
    return sorted(rows, key=str)


def folders(tmp_path):
    return str(tmp_path / "hot"), str(tmp_path / "cold")


def test_three_cutoffs_in_one_block_keep_all_rows(spark, tmp_path):
    hot, cold = folders(tmp_path)
    st.write_by_day(days(spark, 1, 28), hot)
    before = whole(spark, hot, cold)
    assert [bl.compact_before(spark, hot, cold, f"2024-01-{d}") for d in ("06", "10", "20")] == [5, 4, 10]
    assert spark.read.parquet(hot).count() == 9 and bl.read_blocks(spark, cold).count() == 19
    assert whole(spark, hot, cold) == before
    assert bl.read_blocks(spark, cold, "2024-01-08", "2024-01-12").count() == 5
    assert bl.discard_generations(spark, cold) == 2 and whole(spark, hot, cold) == before


def test_columns_of_newer_files_and_late_rows_stay(spark, tmp_path):
    hot, cold = folders(tmp_path)
    st.write_by_day(days(spark, 1, 6), hot)
    st.write_by_day(days(spark, 5, 9, hour=1, extra=True), hot)
    before = whole(spark, hot, cold)
    bl.compact_before(spark, hot, cold, "2024-01-08")
    assert whole(spark, hot, cold) == before
    st.write_by_day(days(spark, 2, 3, hour=2, extra=True), hot)  # rows for days that were moved already
    before = whole(spark, hot, cold)
    assert bl.compact_before(spark, hot, cold, "2024-01-20") == 4
    assert whole(spark, hot, cold) == before and len([r for r in before if r[3] is not None]) == 7
    assert bl.compact_before(spark, hot, cold, "2024-01-20") == 0  # the source is empty


def test_failure_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    hot, cold = folders(tmp_path)
    st.write_by_day(days(spark, 1, 9), hot)
    bl.compact_before(spark, hot, cold, "2024-01-04")
    before = whole(spark, hot, cold)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(bl.Store, "publish", broken)
        with pytest.raises(OSError):
            bl.compact_before(spark, hot, cold, "2024-01-08")
    assert whole(spark, hot, cold) == before
    bl.compact_before(spark, hot, cold, "2024-01-08")
    assert whole(spark, hot, cold) == before and spark.read.parquet(hot).count() == 2


def test_failure_between_manifest_and_removal_is_finished_later(spark, tmp_path, monkeypatch):
    hot, cold = folders(tmp_path)
    st.write_by_day(days(spark, 1, 9), hot)
    before = whole(spark, hot, cold)
    with monkeypatch.context() as m:
        m.setattr(bl, "finish_moves", lambda *_: 0)
        bl.compact_before(spark, hot, cold, "2024-01-06")
    assert spark.read.parquet(hot).count() == 9  # moved rows are still in the source
    st.write_by_day(days(spark, 2, 2, hour=5), hot)  # and a late row comes
    bl.compact_before(spark, hot, cold, "2024-01-06")
    assert whole(spark, hot, cold) == sorted([*before, (2, 5, 2.0, None)], key=str)


def test_second_run_of_the_same_version_is_refused(spark, tmp_path, monkeypatch):
    hot, cold = folders(tmp_path)
    st.write_by_day(days(spark, 1, 9), hot)
    bl.compact_before(spark, hot, cold, "2024-01-03")
    stale = bl._manifest(bl.Store(spark, cold))
    bl.compact_before(spark, hot, cold, "2024-01-05")
    before = whole(spark, hot, cold)
    with monkeypatch.context() as m:
        m.setattr(bl, "_manifest", lambda store: stale)
        with pytest.raises(Exception, match="[Ee]xist"):
            bl.compact_before(spark, hot, cold, "2024-01-08")
    assert whole(spark, hot, cold) == before
    with pytest.raises(ValueError, match="blocks of 30"):
        bl.compact_before(spark, hot, cold, "2024-01-08", block_days=7)


def test_nothing_to_move(spark, tmp_path):
    hot, cold = folders(tmp_path)
    assert bl.compact_before(spark, hot, cold, "2024-01-03") == 0 and bl.read_blocks(spark, cold) is None
    st.write_by_day(days(spark, 4, 5), hot)
    assert bl.compact_before(spark, hot, cold, "2024-01-03") == 0 and spark.read.parquet(hot).count() == 2
