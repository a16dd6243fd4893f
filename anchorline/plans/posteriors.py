"""Posteriors of the models of all line numbers: drawn once, written as tables by kind of parameter, and read by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.operators import models as M
from anchorline.operators import structural as T
from anchorline.plans import proxies as X
from anchorline.session import workspace

KEYS = ["model_id"]
LAGS, DRAWS, BURN = 2, 40, 30
#: Folder of what a session has drawn from the tables of a folder.
_STORED: dict[tuple[str, str, str], tuple[str, object]] = {}


def stored(s: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A posterior, written once a session and folder; a reader of one kind reads that kind's files."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _STORED:
        df, path = make(), workspace(s, name)
        df.write.mode("overwrite").partitionBy("kind").parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return s.read.schema(schema).parquet(path).select(schema.names)


def structural(s: SparkSession, d: str) -> DataFrame:
    """Draws of every model's changes, with the deviations of all dates."""
    return stored(s, d, "structural", lambda: M.gibbs(X.line_changes(s, d), KEYS, LAGS, DRAWS, BURN, 17, scales=True))


def two_chains(s: SparkSession, d: str) -> DataFrame:
    both = X.line_changes(s, d).withColumn("chain", F.explode(F.array(F.lit(0), F.lit(1))))
    return M.gibbs(both, ["model_id", "chain"], LAGS, 60, 30, 42)


def chains(s: SparkSession, d: str) -> DataFrame:
    return stored(s, d, "chains", lambda: two_chains(s, d))


def gapped_levels(s: SparkSession, d: str) -> DataFrame:
    logs = X.line_levels(s, d).withColumn("value", 100 * F.log("value"))
    end = logs.agg(F.max("date").alias("end"))
    edge = F.col("series").isin("N", "A") & (F.col("date") > F.add_months("end", -2))
    gap = ((F.year("date") * 12 + F.month("date")) % 7 == 3) & (F.col("series") == "R")
    return logs.join(end, F.lit(True)).withColumn("value", F.when(~(edge | gap), F.col("value"))).drop("end")


def gapped(s: SparkSession, d: str) -> DataFrame:
    """Draws of models of levels that have gaps and a ragged end."""
    return stored(s, d, "gapped", lambda: M.gibbs(gapped_levels(s, d), KEYS, 1, 40, 20, 11, levels=True, scales=True))


def ends(s: SparkSession, d: str) -> DataFrame:
    """The last values of each draw's panel, from which its paths go on."""
    return M.tail_of(T.panels_of(structural(s, d), X.line_changes(s, d), KEYS), ["model_id", "draw"], LAGS)
