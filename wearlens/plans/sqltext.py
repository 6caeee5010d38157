"""SQL fragments shared by the check queries: the same views over the given tables, written independently."""

from __future__ import annotations

from ..functions.columns import HASH_SPAN
from ..schemas import SENSORS, SETTINGS

READINGS = """tv AS (
  SELECT ts AS event_time, epoch_us(ts) AS event_us, printf('engine_%03d', user_id) AS equipment_id,
         printf('engine_%03d', user_id) || '_batch_run_001' AS run_id, value AS sensor_1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sensor_2,
         CAST(event_type = 'error' AS INTEGER) AS failure_label, event_type, event_id, user_id AS unit,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle
  FROM events)"""

UNIT_CYCLES = READINGS + """,
lv AS (SELECT unit, max(cycle) AS life FROM tv GROUP BY unit),
u0 AS (SELECT tv.*, life - cycle AS rul FROM tv JOIN lv USING (unit)),
ab AS (SELECT regr_slope(rul, cycle) AS slope, regr_intercept(rul, cycle) AS start FROM u0),
uv AS (SELECT u0.*, round(start + slope * cycle, 6) AS prediction FROM u0, ab)"""

def matrix(names: list[str]) -> str:
    picked = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate(names, start=1))
    return f"ev AS (SELECT label AS unit, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS cycle, vec_id, {picked} FROM embeddings)"


MATRIX = matrix(SENSORS + SETTINGS)
WIDE_MATRIX = matrix([f"sensor_{i}" for i in range(1, 65)])


def row_hash(a: str, b: str, salt: str | int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {a}, {b}, {salt})), 1, 8) AS BIGINT)"


def uniform(a: str, b: str, salt: str | int) -> str:
    return f"(({row_hash(a, b, salt)} + 0.5) / {HASH_SPAN}.0)"


def unpivot(source: str, ids: list[str], columns: list[str], name: str = "sensor", value: str = "value") -> str:
    keep = "".join(f"{c}, " for c in ids)
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {source}" for c in columns)
