import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from wearlens.operators import prepare as pr
from wearlens.operators import validate as va
from wearlens.plans import experiments as ex
from wearlens.schemas import READINGS, SENSORS, SETTINGS
from wearlens.session import scratch_path
from wearlens.sinks import tables as st
from wearlens.sources import files as sf
from wearlens.streaming import ingest as si


def batch(spark, rows=3):
    data = [(f"2026-04-04T00:0{i}:00Z", "engine_1", "run_1", float(500 + i), 510.0) for i in range(rows)]
    return spark.createDataFrame(data, "event_time string, equipment_id string, run_id string, sensor_1 double, sensor_2 double")


def test_validation_passes_and_fails(spark):
    good = va.validation_checks(batch(spark), ["sensor_1", "sensor_2"])
    va.gate(good)
    assert va.validation_report(good).first()["success"]
    doubled = va.validation_checks(batch(spark).unionByName(batch(spark, 1)), ["sensor_1", "sensor_2"])
    failed = [r["name"] for r in doubled.where("NOT success").collect()]
    assert failed == ["unique_batch_keys"]
    with pytest.raises(ValueError, match="unique_batch_keys"):
        va.gate(doubled)
    holed = batch(spark).withColumn("sensor_1", F.lit(None).cast("double"))
    strict = {r["name"]: r["success"] for r in va.validation_checks(holed, ["sensor_1"]).collect()}
    lenient = {r["name"]: r["success"] for r in va.validation_checks(holed, ["sensor_1"], mode="lenient").collect()}
    assert not strict["sensor_1_range"] and lenient["sensor_1_range"] and not lenient["sensor_1_non_null"]
    assert not [r for r in va.validation_checks(batch(spark).drop("event_time"), ["sensor_1"]).collect() if r["name"] == "required_columns"][0]["success"]


def test_batch_run_end_to_end(spark):
    path = scratch_path(spark, "features")
    for _ in range(2):  # a repeated run replaces its own rows
        stored = ex.run_batch(batch(spark), path, ["sensor_1", "sensor_2"], "v1", "a.csv")
    assert stored.count() == 3
    found = pr.payload_values(stored, ["sensor_1_1h_mean", "sensor_1_lag_1"], "v1").orderBy("event_time").collect()
    assert found[2]["sensor_1_1h_mean"] == 501.0 and found[2]["sensor_1_lag_1"] == 501.0
    with pytest.raises(ValueError):
        ex.run_batch(batch(spark).withColumn("sensor_1", F.lit(9999.0)), scratch_path(spark, "none"), ["sensor_1", "sensor_2"], "v1")


def test_insert_counts_only_new_rows(spark):
    path = scratch_path(spark, "readings")
    rows = batch(spark).withColumn("event_time", F.col("event_time").cast("timestamp"))
    assert st.insert_if_absent(rows, path) == 3
    assert st.insert_if_absent(rows, path) == 0
    more = batch(spark, 5).withColumn("event_time", F.col("event_time").cast("timestamp"))
    assert st.insert_if_absent(more, path) == 2
    assert spark.read.parquet(path).count() == 5


def test_mapping_names_and_times(spark):
    row = (2, 3, *[0.0] * 3, *[1.0] * 21)
    kinds = "unit int, cycle int, " + ", ".join(f"{c} double" for c in SETTINGS + SENSORS)
    out = pr.to_telemetry(spark.createDataFrame([row], kinds), "FD001", "train").first()
    assert out["equipment_id"] == "FD001_train_unit_002" and out["run_id"].endswith("_run_001")
    assert str(out["event_time"]).endswith("00:02:00")


def test_text_loader_refuses_other_widths(spark):
    path = scratch_path(spark, "text")
    spark.createDataFrame([("1 2 3",)], "value string").write.text(path)
    with pytest.raises(Exception, match="Unexpected column count"):
        sf.read_cycles(spark, path).collect()
    with pytest.raises(ValueError):
        sf.load_dataset(spark, path, "elsewhere")


def test_payload_keeps_null_keys(spark):
    rows = batch(spark, 1).select("event_time", "equipment_id", "run_id", F.lit(float("nan")).alias("a"), F.lit(2.0).alias("b"))
    out = pr.pack_features(rows).first()
    assert json.loads(out["feature_payload"]) == {"a": None, "b": 2.0} and out["feature_set_version"] == "day4_v1"


def _message(**changes):
    base = {"event_time": "2026-04-04T00:00:00Z", "equipment_id": "e", "run_id": "r", "cycle": 3, "failure_label": "1", "extra": "x"}
    base.update({c: i for i, c in enumerate(SETTINGS + SENSORS)})
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


def test_messages_are_typed_or_refused(spark):
    lines = [_message(), _message(sensor_21="521"), _message(event_time="soon"), _message(sensor_2="hot"), _message(run_id=...), "no json"]
    parsed = si.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    good = si.good_messages(parsed)
    assert good.columns == READINGS and good.count() == 2
    reasons = sorted(r["reason"] for r in si.refused_messages(parsed).collect())
    assert reasons == ["invalid values: event_time", "invalid values: sensor_2", "missing columns: run_id", "not a JSON object"]


def test_stream_load_is_idempotent(spark):
    root = scratch_path(spark, "stream")
    spark.createDataFrame([(_message(),), (_message(),), ("bad",)], "value string").write.text(f"{root}/in")
    for checkpoint in ("a", "b"):  # a lost checkpoint replays everything
        si.load_stream(si.read_messages(spark, f"{root}/in"), f"{root}/table", f"{root}/refused", f"{root}/{checkpoint}").awaitTermination()
    assert spark.read.parquet(f"{root}/table").count() == 1


def test_late_repeats_are_loaded_once_and_clean_batches_leave_no_quarantine(spark):
    root = scratch_path(spark, "stream")
    minutes = [f"2026-04-{day:02}T10:{minute:02}:00Z" for day in (4, 5) for minute in range(20)]
    first = [(_message(event_time=m),) for m in minutes]
    late = [(_message(event_time=minutes[i]),) for i in (0, 7, 25)] + [(_message(event_time="2026-04-04T10:07:30Z"),)]

    def load():
        stream = si.read_messages(spark, f"{root}/in", files_per_batch=1)
        si.load_stream(stream, f"{root}/table", f"{root}/refused", f"{root}/checkpoint").awaitTermination()

    for part in (first, late):  # the second call goes on from the checkpoint of the first
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(f"{root}/in")
        load()
    table = spark.read.parquet(f"{root}/table")
    assert table.count() == table.select("event_time").distinct().count() == 41
    assert not os.path.exists(f"{root}/refused")


def test_a_small_batch_looks_at_stored_rows_of_its_times_only(spark, tmp_path):
    path = str(tmp_path / "table")

    def rows(seconds):
        frame = spark.createDataFrame([(s, f"e{s % 3}") for s in seconds], "s long, equipment_id string")
        return frame.select(F.timestamp_seconds("s").alias("event_time"), "equipment_id", F.lit("r").alias("run_id"), F.col("s").alias("value"))

    day = 86_400
    for start in range(0, 3 * day, 3600):  # appended hour after hour
        if start % day < 4 * 3600:
            assert st.insert_if_absent(rows(range(start, start + 3600, 60)), path) == 60
    batch = rows([3660, 3661, day + 60, day + 120])
    stored = st._stored_keys(spark, path, st._dated(batch), ["equipment_id", "event_time", "run_id"])
    assert stored.count() == 1 + 2
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(event_time" in stored._jdf.queryExecution().executedPlan().toString().replace("And(IsNotNull(event_time),", "")
    assert st.insert_if_absent(batch, path) == 1
    by_run = rows([3660]).withColumn("event_time", F.timestamp_seconds(F.lit(9 * 3600)))  # a key without the time: the whole day counts
    assert st.insert_if_absent(by_run, path, key=["equipment_id", "run_id"]) == 0


def test_upsert_keeps_stored_columns_and_takes_new_ones(spark, tmp_path):
    path = str(tmp_path / "features")

    def rows(values, columns):
        kinds = "event_time timestamp, equipment_id string, run_id string, arrival int" + "".join(f", {c} double" for c in columns)
        return spark.createDataFrame([(datetime.datetime(2024, 1, 1 + i), f"e{i}", "r", k, *v) for i, k, v in values], kinds)

    st.upsert(rows([(0, 1, (1.0, 2.0)), (1, 1, (3.0, 4.0))], ["a", "b"]), path, arrival=["arrival"])
    st.upsert(rows([(0, 2, (10.0,))], ["a"]), path, arrival=["arrival"])
    st.upsert(rows([(1, 3, (5.0, 6.0))], ["a", "c"]), path, arrival=["arrival"])
    found = {r["equipment_id"]: (r["a"], r["b"], r["c"]) for r in st.read_by_day(spark, path).collect()}
    assert found == {"e0": (10.0, 2.0, None), "e1": (5.0, 4.0, 6.0)}


def test_published_messages_keep_key_and_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    st.publish(spark.createDataFrame([("e1", None), ("e2", 2.0)], "equipment_id string, a double"), path)
    found = sorted(tuple(r) for r in spark.read.schema("key string, value string").json(path).collect())
    assert found == [("e1", '{"equipment_id":"e1","a":null}'), ("e2", '{"equipment_id":"e2","a":2.0}')]


def test_other_errors_are_not_an_absent_table(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    (path / "part-0.parquet").write_text("no parquet")
    batch = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "e", "r", 1.0)], "event_time timestamp, equipment_id string, run_id string, a double")
    with pytest.raises(Exception):
        st.insert_if_absent(batch, str(path))


def test_scratch_folders_can_be_discarded(spark):
    from wearlens import session

    before = session._MADE.pop(spark.sparkContext.applicationId, [])
    kept = session.written(spark.range(3), "discarded")
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and session.discard_scratch(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    session._MADE[spark.sparkContext.applicationId] = before


def test_only_the_newest_folder_is_read(spark, tmp_path):
    import os

    for i, name in enumerate(("run_b", "run_c", "run_a")):
        spark.range(i + 1).write.parquet(str(tmp_path / name))
        for file in (tmp_path / name).iterdir():
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    found = sf.read_newest(spark, str(tmp_path / "run_*"))
    assert found.count() == 3 and all("/run_a/" in f for f in found.inputFiles())
    with pytest.raises(Exception):
        sf.read_newest(spark, str(tmp_path / "none_*"))


def test_equal_times_are_ordered_by_run(spark):
    rows = [("2026-04-04T00:00:00Z", "e", f"run_{i % 7}", float(i)) for i in (3, 1, 6, 0, 2, 5, 4)]
    frame = spark.createDataFrame(rows, "event_time string, equipment_id string, run_id string, sensor_1 double")
    found = pr.prepare_batch(frame, ["sensor_1"]).orderBy("cycle").collect()
    assert [r.run_id for r in found] == [f"run_{i}" for i in range(7)]
