"""Stored results as partitioned tables: draws, posteriors, their sidecars, and a registry of versions."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells one stored result from another.
RUN = ("model_id", "vintage", "run_id", "forecast_name")


def save(df: DataFrame, root: str, kind: str, keys: Sequence[str] = RUN) -> None:
    """The rows of a kind (paths, posterior, history, ...) in a folder for each of their keys; other keys' rows stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(f"{root}/{kind}")


def load(spark: SparkSession, root: str, kind: str, **run: str) -> DataFrame:
    """The rows of a kind; of one run only its folders are read. ValueError if a run that is named has none."""
    df = spark.read.option("basePath", f"{root}/{kind}").parquet(f"{root}/{kind}")
    for key, value in run.items():
        df = df.filter(F.col(key) == value)
    if run and df.isEmpty():
        raise ValueError(f"no {kind} of {run}")
    return df


def manifest(df: DataFrame) -> DataFrame:
    """column, type, rows of a table; the rows come from the files' footers."""
    fields = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema]
    return df.agg(F.count("*").alias("rows")).select(F.explode(F.array(*fields)).alias("f"), "rows").select("f.*", "rows")


def rebuild(spark: SparkSession, root: str, least_draws: int = 1, **run: str) -> tuple[DataFrame, DataFrame]:
    """A run's panel and posterior, ready to be simulated from. ValueError if draws are too few, or a draw lacks coefficients, or
    the posterior has other series than the panel."""
    panel, posterior = load(spark, root, "panel", **run), load(spark, root, "posterior", **run)
    coefficients = posterior.filter("kind = 'b'").groupBy("draw").agg(F.count("*").alias("n"), F.count_distinct("equation").alias("equations"))
    shape = coefficients.agg(F.count("*").alias("draws"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("equations").alias("equations")).first()
    series = panel.agg(F.count_distinct("series").alias("n")).first()["n"]
    if shape["draws"] < least_draws or shape["least"] != shape["most"] or shape["equations"] != series:
        raise ValueError(f"the stored posterior of {run} is not whole: {shape.asDict()}, {series} series")
    return panel, posterior


def commit_version(df: DataFrame, root: str) -> int:
    """``df`` as the next version of a table; readers see the versions before until its folder is whole."""
    version = (latest_version(df.sparkSession, root) or 0) + 1
    df.write.mode("error").parquet(f"{root}/version={version}")
    return version


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The newest version whose folder has the writer's success mark."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def read_version(spark: SparkSession, root: str) -> DataFrame:
    version = latest_version(spark, root)
    if version is None:
        raise ValueError(f"{root} has no version")
    return spark.read.parquet(f"{root}/version={version}")


def change(spark: SparkSession, root: str, make: Callable[[DataFrame | None], DataFrame], keys: Sequence[str] = (), attempts: int = 20, wait: float = 0.5) -> int:
    """The next version of a table, made from the newest by ``make`` (of None for the first); its number.

    Writers do not wait for each other while they work: each writes its rows to a folder of its own, then claims the next number. Of two
    that began from one version one gets it; the other makes its change again, from what that one has left. ValueError is raised,
    and nothing committed, if a key of ``keys`` would have two promoted rows; TimeoutError if others win each time, or a claimed version
    does not appear.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for _ in range(attempts):
        seen = latest_version(spark, root)
        new = make(None if seen is None else spark.read.parquet(f"{root}/version={seen}"))
        staged, number = f"{root}/_staged-{uuid4().hex}", (seen or 0) + 1
        new.write.mode("error").parquet(staged)
        if keys:
            held = spark.read.parquet(staged).groupBy(*keys).agg(F.sum("promoted").alias("n")).filter("n > 1")
            if not held.isEmpty():
                refused = [tuple(r) for r in held.select(*keys).limit(5).collect()]
                fs.delete(path(staged), True)
                raise ValueError(f"more than one promoted row: {refused}")
        # Creating a file that must not be there is the one step that cannot be shared.
        if claimed(fs, path(f"{root}/_claims/{number}")):
            fs.rename(path(staged), path(f"{root}/version={number}"))
            return number
        fs.delete(path(staged), True)
        for _ in range(120):
            if (latest_version(spark, root) or 0) >= number:
                break
            time.sleep(wait)
        else:
            raise TimeoutError(f"version {number} of {root} was claimed and has not appeared")
    raise TimeoutError(f"other writers won {attempts} times at {root}")


def claimed(fs, at) -> bool:  # noqa: ANN001
    """True if the file was not there and now is; where files cannot be made so, FileSystem.create() refuses."""
    try:
        fs.create(at, False).close()
    except Py4JJavaError as error:
        if not fs.exists(at):
            raise error
        return False
    return True


def portable(path: Column, root: str) -> Column:
    """A path below ``root`` as one relative to it; other paths stay."""
    return F.when(F.startswith(path, F.lit(f"{root}/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def resolved(reference: Column, root: str, anchor: str = "results") -> Column:
    """A reference as a path below ``root``: relative ones are, and of paths of other places what begins with ``anchor``."""
    stale = F.regexp_extract(reference, rf"/({anchor}/.*)$", 1)
    inside = F.startswith(reference, F.lit(f"{root}/"))
    return F.when(inside, reference).when(~F.startswith(reference, F.lit("/")), F.concat(F.lit(f"{root}/"), reference)).when(stale != "", F.concat(F.lit(f"{root}/"), stale))
