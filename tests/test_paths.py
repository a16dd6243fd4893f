"""Months of stitched weeks, growth over twelve months as conditions, record contracts."""

import datetime as dt

import pytest

from anchorline.operators import calendar as T
from anchorline.operators import tax as W
from anchorline.operators import validate as V


def test_weeks_of_history_and_paths(spark):
    monday = dt.date(2024, 1, 1)
    week = lambda k: monday + dt.timedelta(days=7 * k)
    history = spark.createDataFrame([("x", week(k), float(k)) for k in range(8)], "series string, date date, value double")
    paths = spark.createDataFrame([("x", d, week(k), 100.0 * d + k) for d in (0, 1) for k in range(6, 14)], "series string, draw int, date date, value double")
    got = {(r["draw"], r["date"].month): r["value"] for r in T.stitched_months(history, paths, ["series"]).collect()}
    # January has weeks 0 to 4, February 5 to 8 (5 is history), March 9 to 12; April has its first alone.
    assert got == {(d, m): v for d in (0, 1) for m, v in ((1, 2.0), (2, (5 + 3 * 100.0 * d + 6 + 7 + 8) / 4), (3, 100.0 * d + 10.5))}
    with pytest.raises(ValueError, match="2024-02"):
        T.stitched_months(history, paths.filter("date <> '2024-02-19'"), ["series"])


def test_growth_over_twelve_months(spark):
    history = spark.createDataFrame([("x", dt.date(2020, m, 1), 100.0 + m) for m in range(1, 13)], "series string, date date, value double")
    rates = spark.createDataFrame([("x", h, None if h == 2 else 10.0) for h in range(1, 27)], "series string, h int, rate double")
    got = {r["h"]: r["value"] for r in W.yearly_growth_path(history, ["series"], rates).collect()}
    assert got[1] == pytest.approx(101 * 1.1) and got[13] == pytest.approx(101 * 1.21) and got[25] == pytest.approx(101 * 1.331)
    assert got[2] is None and got[14] is None and got[26] is None and got[12] == pytest.approx(112 * 1.1)


def test_record_problems(spark):
    df = spark.createDataFrame([("fan", 1.0), ("fan", None), ("meta", None), ("other", 1.0), (None, 1.0)], "record_type string, value double")
    got = {r["problem"]: r["rows"] for r in V.record_problems(df, "record_type", ["fan", "meta"], {"fan": "value"}).collect()}
    assert got == {"fan without value": 1, "record type other": 1, "record type null": 1}
