from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from credlens.operators import changepoint
from credlens.operators.ordered import ordered
from credlens.streaming.changes import changes, levels

SCHEMA = "series string, time timestamp, x double"


def run(spark, folder, known, name, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = changes(stream, "series", "time", "x", known, **options).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name)


def test_stream_in_order_equals_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.lit("value").alias("series"), F.col("ts").alias("time"), F.col("value").alias("x"), "event_id")
    rows = events.orderBy("time", "event_id").dropDuplicates(["time"]).orderBy("time").toPandas()
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for k in range(3):
        spark.createDataFrame(rows.iloc[cuts[k] : cuts[k + 1]][["series", "time", "x"]], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    whole = spark.createDataFrame(rows[["series", "time", "x"]], SCHEMA)
    found = run(spark, str(tmp_path / "in"), levels(whole, "series", "x"), "in_order").orderBy("i").collect()
    want = changepoint.features(ordered(whole.withColumnRenamed("x", "value"), ["value"], ["time"])).orderBy("i").collect()
    assert len(found) == len(want) == len(rows) and not any(r["late"] for r in found)
    for a, b in zip(found, want, strict=True):
        assert (a["i"], a["x"]) == (b["i"], b["x"])
        assert a["cusum"] == pytest.approx(b["cusum"], abs=1e-6) and a["ph_stat"] == pytest.approx(b["ph_stat"], abs=1e-6)


def test_late_values_alarms_and_series_apart(spark, tmp_path):
    at = lambda k: f"2026-01-01 {k // 60:02d}:{k % 60:02d}:00"
    first = [("a", at(k), float(k % 2)) for k in range(40)] + [("b", at(k), 5.0 + k % 3) for k in range(40)] + [("unknown", at(1), 1.0), (None, at(1), 1.0), ("a", None, 1.0), ("a", at(3), None)]
    second = [("a", at(10), 9.0), ("a", at(39), 1.0)] + [("a", at(40 + k), 40.0 + k % 2) for k in range(20)]
    for k, rows in enumerate((first, second)):
        frame = spark.createDataFrame(rows, "series string, time string, x double").select("series", F.to_timestamp("time").alias("time"), "x")
        frame.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    known = spark.createDataFrame([("a", 0.5, 0.5), ("b", 6.0, 0.8)], "series string, mean double, spread double")
    found = run(spark, str(tmp_path / "in"), known, "late").collect()
    assert sorted({r["series"] for r in found}) == ["a", "b"] and len(found) == 40 + 40 + 22
    late = [r for r in found if r["late"]]
    assert [(r["x"], r["i"], r["cusum"], r["ph_stat"], r["alarm"]) for r in late] == [(9.0, None, None, None, False)]
    alarms = [r for r in found if r["alarm"]]
    assert alarms and all(r["series"] == "a" and r["x"] >= 40 for r in alarms) and min(r["i"] for r in alarms) == 41
    assert sorted(r["i"] for r in found if r["series"] == "a" and not r["late"]) == list(range(61))
