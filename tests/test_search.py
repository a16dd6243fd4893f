"""The staged search of priors: resumed, and against every candidate scored by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorline.operators import models as M
from anchorline.operators import search as G

KEYS = ["model_id"]


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for k, model in enumerate(("m", "other")):
        rng = np.random.default_rng(k)
        z = np.zeros((60, 2))
        for t in range(1, 60):
            z[t] = np.array([[0.6, 0.0], [0.2, 0.4]]) @ z[t - 1] + rng.standard_normal(2)
        dates = pd.date_range("2000-01-01", periods=60, freq="MS").date
        rows += [(model, dates[t], s, float(z[t, j])) for t in range(60) for j, s in enumerate("xy")]
    return spark.createDataFrame(rows, "model_id string, date date, series string, value double")


STAGES = (G.Stage("screen", 16, 8, 2), G.Stage("confirm", 24, 12, 3, 2, 2))
BLOCKS = {"tightness": {"own": (0.05, 0.5), "cross": (0.5,)}, "decay": {"decay": (0.5, 2.0)}}


def plain_crps(x, y):
    x = np.asarray(x)
    return np.abs(x - y).mean() - np.abs(x[:, None] - x[None, :]).mean() / 2


def test_a_block_equals_all_candidates_scored_by_hand(spark, panel, tmp_path):
    found = G.block_search(panel, KEYS, {"tightness": BLOCKS["tightness"]}, STAGES[:1], str(tmp_path), 1, 2, 3)
    assert found.fits == 2 * 3 * 2  # models, candidates with the base, origins
    got = {(r["model_id"], r["own"]): r for r in found.ranking.collect()}
    cases = spark.read.parquet(f"{tmp_path}/run-*/cases-screen-tightness")
    assert {str(r["origin"]) for r in cases.select("origin").distinct().collect()} == {"2004-10-01", "2004-09-01"}
    scored = []
    for r in cases.filter("model_id = 'm'").collect():
        seen = panel.filter(F.col("date") <= F.lit(r["origin"])).filter("model_id = 'm'").withColumn("signature", F.lit(r["signature"]))
        by = ["model_id", "signature"]
        draws = M.gibbs(seen.select(*by, "series", "date", "value"), by, 1, 16, 8, 3, prior={p: r[p] for p in M.PRIOR})
        paths = M.simulate(draws, M.tail_of(seen, by, 1), by, 2, 3).toPandas()
        outcome = panel.filter("model_id = 'm'").toPandas()
        for (s, h), mine in paths.groupby(["series", "h"]):
            at = (pd.Timestamp(r["origin"]) + pd.DateOffset(months=int(h))).date()
            y = outcome[(outcome["series"] == s) & (outcome["date"] == at)]["value"].iat[0]
            scored.append((r["own"], plain_crps(mine["value"], y), (mine["value"].mean() - y) ** 2))
    by_hand = pd.DataFrame(scored, columns=["own", "crps", "square"]).groupby("own").mean()
    for own, row in by_hand.iterrows():
        assert got["m", own]["crps"] == pytest.approx(row["crps"]) and got["m", own]["rmse"] == pytest.approx(np.sqrt(row["square"])) and got["m", own]["scores"] == 8
    order = list(by_hand.sort_values("crps").index)
    assert [got["m", own]["place"] for own in order] == [1, 2, 3]
    assert got["m", 0.2]["is_base"] and got["m", 0.2]["crps_vs_base"] == pytest.approx(0)


def test_a_second_run_fits_nothing_and_a_longer_one_what_is_new(panel, tmp_path):
    first = G.block_search(panel, KEYS, BLOCKS, STAGES, str(tmp_path), 1, 2, 3)
    ranking = sorted(map(str, first.ranking.collect()))
    again = G.block_search(panel, KEYS, BLOCKS, STAGES, str(tmp_path), 1, 2, 3)
    assert first.fits > 0 and again.fits == 0 and sorted(map(str, again.ranking.collect())) == ranking
    longer = G.block_search(panel, KEYS, BLOCKS | {"outliers": {"outlier_years": (2.0,)}}, STAGES[:1], str(tmp_path), 1, 2, 3)
    assert longer.fits == 2 * 1 * 2
    rows = first.ranking.collect()
    assert {r["model_id"] for r in rows} == {"m", "other"} and all(r["origins"] == 3 and r["failures"] == 0 for r in rows)


def test_failed_fits_are_told_and_rank_last(spark, panel, tmp_path, monkeypatch):
    broken = panel.withColumn("value", F.when((F.col("model_id") == "other") & (F.col("series") == "x"), 1.0).otherwise(F.col("value")))
    found = G.block_search(broken, KEYS, {"decay": {"decay": (2.0,)}}, STAGES[:1], str(tmp_path), 1, 2, 3)
    rows = found.ranking.filter("model_id = 'other'").collect()
    assert rows and all(r["failures"] == 2 and r["crps"] is None and r["scores"] == 0 for r in rows)
    assert all(r["failures"] == 0 for r in found.ranking.filter("model_id = 'm'").collect())
    assert G.block_search(broken, KEYS, {"decay": {"decay": (2.0,)}}, STAGES[:1], str(tmp_path), 1, 2, 3).fits == 0
