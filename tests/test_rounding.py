"""SQL rounds as Spark does: half up of the number as it is written."""

import duckdb

import mediasift.operators.scoring  # noqa: F401  registers the queries
from mediasift.operators.registry import half_up_sql, oracles, queries
from mediasift.operators.signals import MISMATCHES_SQL
from mediasift.operators.timeline import half_up, merge_intervals

VALUES = [26.549999999999997, -28.049999999999997, 110.14999999999999, 198.45, -12.35, 0.25, -0.25, 1.05, 1e-7, 0.0, 0.049999999999999996, -1e-9]


def test_half_up_in_sql_as_in_spark(spark):
    con = duckdb.connect()
    rounded = [con.execute(f"SELECT {half_up_sql('x', 1)} FROM (SELECT CAST(? AS DOUBLE) AS x)", [x]).fetchone()[0] for x in VALUES]
    assert rounded == [half_up(x, 1) for x in VALUES]
    assert rounded == [r[0] for r in spark.createDataFrame([(x,) for x in VALUES], "x double").selectExpr("round(x, 1)").collect()]


def test_fused_offset_just_below_a_half(spark, tmp_path):
    """Events of which DuckDB's own round gave 110.2, -111.2 and 216.2."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, 1 AS user_id, 1.0::DOUBLE AS value FROM unnest([11716, 48390, 57848, 11717]) u(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = dict(map(tuple, queries()["r8_fused_offset"](spark, str(tmp_path)).collect()))
    assert got == dict(con.execute(oracles()["r8_fused_offset"]).fetchall())
    assert [got[i] for i in (11716, 48390, 57848)] == [110.1, -111.1, 216.1]


def test_merged_lags_just_below_a_half(spark):
    """A run of lags whose mean meets 26.549999999999997: DuckDB's own round gave 26.6."""
    lags = [200.0, -200.0, -200.0, -200.0, -200.0, 200.0, -200.0, -200.0, 200.0]
    rows = [(1, k, k / 5, k / 5 + 0.8, "DESYNC", "MEDIUM", x) for k, x in enumerate(lags)]
    listed = ", ".join(map(str, rows))
    sql = oracles()["w4_mismatches"]
    assert MISMATCHES_SQL in sql
    own = sql.replace(MISMATCHES_SQL, f'mm AS (SELECT * FROM (VALUES {listed}) v(media_id, "window", start, "end", kind, severity, offset_ms))')
    got = merge_intervals(spark.createDataFrame(rows, 'media_id long, seq long, start double, end double, kind string, severity string, offset_ms double'), 0.25).collect()
    found = duckdb.connect().execute(f"SELECT n, offset_ms FROM ({own})").fetchall()
    assert [(r["n"], r["offset_ms"]) for r in got] == found == [(len(lags), 26.5)]
