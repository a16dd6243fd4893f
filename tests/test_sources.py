"""Readers, the run registry and the streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from anchorline.schemas import DISPLAY, WEIGHTS
from anchorline.sources import readers as R
from anchorline.streaming.buckets import weekly_stream


def test_ticker_blocks(spark):
    rows = spark.createDataFrame([("T1", "1", "#N/A"), ("T9", "5", "6")], "t string, `202001` string, `202002` string")
    got = sorted(R.ticker_rows(rows, "t", {"T1": "a"}).collect())
    assert [(r["series"], str(r["date"]), r["value"]) for r in got] == [("a", "2020-01-01", 1.0), ("a", "2020-02-01", None)]
    block = spark.createDataFrame([("2020-01-01", "1", "#N/A"), ("2020-01-02", "2", "3")], "d string, A string, B string")
    values, markers = R.ticker_columns(block, "d", {"A": "a", "B": "b"})
    assert values.filter("value is not null").count() == 3
    assert {r["series"]: r["markers"] for r in markers.collect()} == {"a": 0, "b": 1}


def test_json_cubes_dense_and_sparse(spark):
    cubes = spark.createDataFrame([(1, '{"value":[1,null,3,4,5,6]}'), (2, '{"value":{"5":9.5}}')], "id int, value string")
    got = {(r["id"], r["d0"], r["d1"]): r["value"] for r in R.json_cube(cubes, (2, 3)).collect()}
    assert got == {(1, 0, 0): 1, (1, 0, 2): 3, (1, 1, 0): 4, (1, 1, 1): 5, (1, 1, 2): 6, (2, 1, 2): 9.5}


def test_csv_schema_is_enforced(spark, tmp_path):
    (tmp_path / "w.csv").write_text("year,series,w\n2020,a,1.5\n")
    assert R.read_csv(spark, str(tmp_path), WEIGHTS).collect() == [(2020, "a", 1.5)]


def test_registry_scan_twice_changes_nothing(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / "m" / "20240101" / run).mkdir(parents=True)
        (tmp_path / "m" / "20240101" / run / "metadata.json").write_text(json.dumps({"draws": 10}))
    found = R.run_folders(spark, str(tmp_path))
    assert sorted((r["model_id"], r["vintage"], r["run_id"]) for r in found.collect()) == [("m", "20240101", "r1"), ("m", "20240101", "r2")]
    keys = ["model_id", "vintage", "run_id"]
    known = spark.createDataFrame([("m", "20240101", "r1", 1), ("m", "20240101", "gone", 0)], "model_id string, vintage string, run_id string, promoted int")
    once = R.register_runs(known, found, keys)
    twice = R.register_runs(once.select(*keys, "promoted"), found, keys)
    assert once.exceptAll(twice).isEmpty() and once.count() == 3
    assert {r["run_id"]: r["present_on_disk"] for r in once.collect()} == {"r1": True, "r2": True, "gone": False}
    assert R.file_inventory(spark, str(tmp_path)).filter("role = 'metadata'").count() == 2
    fields = R.flatten_json(found, "metadata", ["run_id"]).filter("run_id = 'r1'").first()
    assert (fields["key"], fields["text"]) == ("draws", "10")


def test_display_schema():
    assert len(DISPLAY.fields) == 24


def test_weekly_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    run = weekly_stream(source, "ts", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    batch = events.groupBy("event_type", F.trunc("ts", "week").alias("date")).agg(F.count("value").alias("n"))
    assert spark.table("weekly").select("event_type", "date", "n").exceptAll(batch).isEmpty()
    assert spark.table("weekly").count() == batch.count()
    assert spark.table("weekly").first()["date"].weekday() == 0 and isinstance(spark.table("weekly").first()["date"], dt.date)
