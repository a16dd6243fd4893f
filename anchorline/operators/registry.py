"""The registry of runs and forecasts: tables with a promoted flag, at most one for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_coverage(runs: DataFrame) -> DataFrame:
    """Of each model: runs, vintages, promoted runs, the latest vintage."""
    return runs.groupBy("model_id").agg(F.count("*").alias("runs"), F.count_distinct("vintage").alias("vintages"), F.count_if(F.col("promoted") == 1).alias("promoted"), F.max("vintage").alias("latest"))


def vintage_matrix(runs: DataFrame, models: Sequence[str]) -> DataFrame:
    """vintage by model: whether there is a run. ``models`` are given, so that the columns are."""
    return runs.groupBy("vintage").agg(*[F.bool_or(F.col("model_id") == m).alias(m) for m in models])


def common_vintages(runs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Vintages of which every model has a run, newest first in ``rank``."""
    full = runs.filter(F.col("model_id").isin(list(models))).groupBy("vintage").agg(F.count_distinct("model_id").alias("n")).filter(F.col("n") == len(models))
    return full.select("vintage", F.row_number().over(Window.orderBy(F.desc("vintage"))).alias("rank"))  # a row a vintage


def promote(runs: DataFrame, keys: Sequence[str], run_id: str) -> DataFrame:
    """The table with ``run_id`` promoted: of its key it alone, other keys as they were."""
    mine = F.max(F.when(F.col("run_id") == run_id, 1).otherwise(0)).over(Window.partitionBy(*keys)) == 1
    return runs.withColumn("promoted", F.when(mine, F.when(F.col("run_id") == run_id, 1).otherwise(0)).otherwise(F.col("promoted")))


def promotion_conflicts(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum("promoted").alias("promoted")).filter("promoted > 1")


def promoted_forecasts(runs: DataFrame, forecasts: DataFrame) -> DataFrame:
    return forecasts.join(runs.filter("promoted = 1").select("model_id", "vintage", "run_id", "created"), ["model_id", "vintage", "run_id"])


def resolve_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The run that stands for each key: a promoted one before others, then the newest, then by run_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("promoted"), F.desc("created"), "run_id")
    return runs.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def ordered_runs(runs: DataFrame) -> DataFrame:
    """All promoted runs with their place by vintage (newest first), model, creation (newest first) and run_id."""
    w = Window.partitionBy("vintage").orderBy("model_id", F.desc("created"), "run_id")
    return runs.filter("promoted = 1").withColumn("place", F.row_number().over(w))


def missing_files(runs: DataFrame, inventory: DataFrame, required: Sequence[str]) -> DataFrame:
    """run_id and file of each required file that a run doesn't have."""
    wanted = runs.select("run_id", F.explode(F.array(*[F.lit(f) for f in required])).alias("file"))
    return wanted.join(inventory.select("run_id", "file"), ["run_id", "file"], "left_anti")
