"""Nested JSON, labelled cubes, archives of arrays, commits of a registry, integrity of stored parts."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.operators import validate as V
from anchorline.sources import cubes as C
from anchorline.sources import nested as N
from anchorline.sources import store


def paths_of(value, at="$"):
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in paths_of(v, f"{at}.{k}")]
    if isinstance(value, list):
        return [p for k, v in enumerate(value) for p in paths_of(v, f"{at}[{k}]")]
    return [(at, None if value is None else value if isinstance(value, str) else json.dumps(value))]


def test_json_paths_of_any_depth(spark):
    docs = [{"a": 1, "b": {"c": [1, {"d": "x \"y\" \n"}, []], "e": None}}, [[["deep"]], True], "alone", {}, {"k.l": {"ü": -2}}, {"n": [[1, 2], [3]]}]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(99, None)], "id long, props string")
    got = sorted((r["id"], r["path"], r["text"]) for r in N.json_paths(df, "props", ["id"]).collect())
    assert got == sorted((k, *p) for k, d in enumerate(docs) for p in paths_of(d))
    assert N.json_paths(df.limit(0), "props", ["id"]).count() == 0


def payload(dims, sizes, codes, values):
    return json.dumps({"id": dims, "size": sizes, "dimension": {d: {"label": d, "category": {"index": {c: k for k, c in enumerate(codes[d])}}} for d in dims}, "value": values})


def test_cubes_in_any_order_of_dimensions(spark):
    codes = {"time": ["2020-01", "2020-02", "2020-03"], "geo": ["BE", "FR"], "unit": ["I15"]}
    array = np.arange(6.0).reshape(3, 2, 1)
    rows = [("dense", payload(["time", "geo", "unit"], [3, 2, 1], codes, array.ravel().tolist()))]
    turned = array.transpose(1, 2, 0)
    rows.append(("turned", payload(["geo", "unit", "time"], [2, 1, 3], codes, turned.ravel().tolist())))
    rows.append(("sparse", payload(["geo", "unit", "time"], [2, 1, 3], codes, {str(k): v for k, v in enumerate(turned.ravel()) if v != 4})))
    rows.append(("holes", payload(["time", "geo", "unit"], [3, 2, 1], codes, [0.0, None, 2.0, 3.0, None, 5.0])))
    cells, wrong = N.labelled_cubes(spark.createDataFrame(rows, "cube string, payload string"), ["cube"])
    got = {}
    for r in cells.collect():
        got.setdefault(r["cube"], {})[r["codes"]["time"], r["codes"]["geo"], r["codes"]["unit"]] = r["value"]
    whole = {(t, g, "I15"): array[i, j, 0] for i, t in enumerate(codes["time"]) for j, g in enumerate(codes["geo"])}
    assert got["dense"] == got["turned"] == whole and wrong.isEmpty()
    assert got["sparse"] == {k: v for k, v in whole.items() if v != 4} and got["holes"] == {k: v for k, v in whole.items() if v not in (1, 4)}


def test_cube_violations_are_rows(spark):
    codes = {"time": ["a", "b"], "geo": ["x"]}
    rows = [("long", payload(["time", "geo"], [2, 1], codes, [1.0, 2.0, 3.0])), ("far", payload(["time", "geo"], [2, 1], codes, {"1": 5.0, "7": 9.0, "-1": 1.0})), ("codes", payload(["time", "geo"], [2, 2], codes, {"0": 1.0}))]
    cells, wrong = N.labelled_cubes(spark.createDataFrame(rows, "cube string, payload string"), ["cube"])
    assert sorted((r["cube"], r["problem"]) for r in wrong.collect()) == [("codes", "dimension geo has 1 codes for 2"), ("far", "position -1 of 2"), ("far", "position 7 of 2"), ("long", "3 values for 2 cells"), ("long", "position 2 of 2")]
    assert {(r["cube"], r["codes"]["time"], r["value"]) for r in cells.collect()} == {("long", "a", 1.0), ("long", "b", 2.0), ("far", "b", 5.0), ("codes", "a", 1.0)}


def test_archives_come_back_and_ranges_are_read_alone(spark, tmp_path):
    rng = np.random.default_rng(0)
    arrays = {"B": rng.standard_normal((200, 3, 4)), "phi": rng.standard_normal((200, 5)).astype(np.float32), "n": np.arange(200)}
    np.savez(tmp_path / "draws.npz", **arrays)
    uri = (tmp_path / "draws.npz").as_uri()
    manifest = {r["array"]: (r["shape"], r["type"]) for r in C.archive_manifest(spark, uri).collect()}
    assert manifest == {"B": ([200, 3, 4], "float64"), "phi": ([200, 5], "float32"), "n": ([200], "int64")}
    whole = C.read_archive(spark, uri).toPandas()
    for name, a in arrays.items():
        mine = whole[whole["array"] == name].sort_values(["draw", "place"])
        assert (mine["value"].to_numpy() == a.astype(float).ravel()).all()
    one = C.read_archive(spark, uri, array="B", draws="7:8")
    assert [r["value"] for r in one.orderBy("place").collect()] == arrays["B"][7].ravel().tolist()
    reader = C.ArchiveReader({"path": uri, "array": "B", "draws": "7:8"})
    (part,) = reader.partitions()
    opened, taken = C.opened, []
    C.opened = lambda u: taken.append(opened(u)) or taken[-1]
    try:
        list(reader.read(part))
    finally:
        C.opened = opened
    assert taken[0].taken == 3 * 4 * 8
    np.savez_compressed(tmp_path / "small.npz", **arrays)
    with pytest.raises(Exception, match="compressed"):
        C.read_archive(spark, (tmp_path / "small.npz").as_uri()).count()
    with pytest.raises(Exception, match="no array"):
        C.read_archive(spark, uri, array="missing").count()


def test_archives_of_runs(spark, tmp_path):
    rows = [(m, a, d, p, float(d * 10 + p + len(a))) for m in ("m 1", "m2") for a in ("h", "phi") for d in range(3) for p in range(4)]
    cube = spark.createDataFrame(rows, "model_id string, array string, draw long, place long, value double")
    made = {r["model_id"]: r["uri"] for r in C.write_archives(cube, (tmp_path / "runs").as_uri(), ["model_id"]).collect()}
    assert set(made) == {"m 1", "m2"}
    back = C.read_archive(spark, made["m2"]).withColumn("model_id", F.lit("m2"))
    assert sorted(map(tuple, back.select("model_id", "array", "draw", "place", "value").collect())) == sorted(r for r in rows if r[0] == "m2")
    with pytest.raises(Exception, match="values for"):
        C.write_archives(cube.filter("not (draw = 1 and place = 2)"), (tmp_path / "more").as_uri(), ["model_id"]).count()


RUN = "model_id string, run_id string, promoted int"


def test_two_writers_at_once_both_land(spark, tmp_path):
    root = tmp_path.as_uri()
    assert store.change(spark, root, lambda _: spark.createDataFrame([("m", "r0", 1)], RUN), ["model_id"]) == 1
    gate, errors, made = threading.Barrier(3), [], []

    def add(k):
        first = [True]

        def make(held):
            rows = held.unionByName(spark.createDataFrame([("m", f"r{k}", 0)], RUN))
            if first[0]:
                first[0] = False
                gate.wait(60)  # all begin from one version
            return rows

        try:
            made.append(store.change(spark, root, make, ["model_id"]))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    assert not errors and sorted(made) == [2, 3, 4]
    assert {r["run_id"] for r in store.read_version(spark, root).collect()} == {"r0", "r1", "r2", "r3"}
    with pytest.raises(ValueError, match="more than one promoted"):
        store.change(spark, root, lambda held: held.withColumn("promoted", F.lit(1)), ["model_id"])
    assert store.latest_version(spark, root) == 4 and not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]


def test_a_claim_that_leads_nowhere_is_told(spark, tmp_path):
    root = tmp_path.as_uri()
    store.change(spark, root, lambda _: spark.createDataFrame([("m", "r0", 1)], RUN))
    (tmp_path / "_claims" / "2").touch()
    with pytest.raises(TimeoutError, match="version 2"):
        store.change(spark, root, lambda held: held, wait=0.01)


def test_integrity_names_what_changed(spark):
    df = spark.createDataFrame([(y, k, float(y * k)) for y in (2000, 2001, 2002) for k in range(5)], "year int, k int, value double")
    baseline = V.part_signatures(df, ["year"])
    assert V.integrity_violations(baseline, V.part_signatures(df.repartition(7).select("value", "k", "year"), ["year"]), ["year"]).isEmpty()
    other = df.filter("year <> 2000").withColumn("value", F.when((F.col("year") == 2001) & (F.col("k") == 3), 0.0).otherwise(F.col("value"))).unionByName(spark.createDataFrame([(2003, 1, 1.0)], df.schema))
    found = V.part_signatures(other, ["year"])
    assert {r["year"]: r["problem"] for r in V.integrity_violations(baseline, found, ["year"]).collect()} == {2000: "missing", 2001: "changed", 2003: "unexpected"}
    whole = V.backfilled(baseline, found, ["year"])
    assert {r["year"]: r["problem"] for r in V.integrity_violations(whole, found, ["year"]).collect()} == {2000: "missing", 2001: "changed"}
