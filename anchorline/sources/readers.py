"""Sources and sinks: dated CSV files, ticker blocks, statistical tables, JSON cubes, run folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from anchorline.functions.scalar import clean_number, parse_date


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file with a header, of a schema that is given and enforced."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def ticker_rows(block: DataFrame, ticker: str, tickers: Mapping[str, str]) -> DataFrame:
    """series, date, value of a block with a row for each ticker and a column for each month named YYYYMM."""
    periods = [c for c in block.columns if len(c) == 6 and c.isdigit()]
    names = F.create_map(*[F.lit(x) for pair in tickers.items() for x in pair])
    long = block.withColumns({c: F.col(c).cast("string") for c in periods}).unpivot([ticker], periods, "period", "raw")
    named = long.withColumn("series", F.try_element_at(names, F.col(ticker))).filter("series is not null")
    return named.select("series", F.to_date("period", "yyyyMM").alias("date"), clean_number(F.col("raw")).alias("value"))


def ticker_columns(block: DataFrame, date: str, tickers: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """series, date, value of a block with a column for each ticker, and the number of error markers of each series."""
    held = [c for c in tickers if c in block.columns]
    long = block.withColumns({c: F.col(c).cast("string") for c in held}).unpivot([date], held, "ticker", "raw")
    names = F.create_map(*[F.lit(x) for pair in tickers.items() for x in pair])
    named = long.withColumn("series", F.element_at(names, F.col("ticker")))
    rows = named.select("series", parse_date(F.col(date)).alias("date"), clean_number(F.col("raw")).alias("value")).filter("date is not null")
    return rows, named.groupBy("series").agg(F.count_if(F.startswith("raw", F.lit("#"))).alias("markers"))


def pivot_panel(long: DataFrame, series: Sequence[str]) -> DataFrame:
    """date and a column for each of the given series: the columns are fixed, so nothing is collected to find them."""
    return long.groupBy("date").agg(*[F.max(F.when(F.col("series") == x, F.col("value"))).alias(x) for x in series])


def unpivot_panel(wide: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "series", "value")


def json_cube(cubes: DataFrame, sizes: Sequence[int], values: str = "value") -> DataFrame:
    """id, position, one place for each dimension, value: a cube whose JSON has a list, or a map by position, of values.

    A position counts through the dimensions with the last one fastest.
    """
    raw = F.get_json_object(values, "$.value")
    as_map = F.from_json(raw, "map<string,double>")
    as_list = F.from_json(raw, "array<double>")
    dense = cubes.filter(F.startswith(raw, F.lit("["))).select("id", F.posexplode(as_list).alias("position", "value"))
    sparse = cubes.filter(~F.startswith(raw, F.lit("["))).select("id", F.explode(as_map).alias("position", "value")).withColumn("position", F.col("position").cast("int"))
    out, stride = dense.unionByName(sparse).filter("value is not null"), 1
    for k in range(len(sizes) - 1, -1, -1):
        out = out.withColumn(f"d{k}", F.pmod(F.floor(F.col("position") / stride), F.lit(sizes[k])).cast("int"))
        stride *= sizes[k]
    return out


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """A row for each metadata.json below ``root``/model/vintage/run: identity from the path, fields from the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "metadata.json").option("recursiveFileLookup", True).load(root)
    parts = F.split(F.regexp_replace("path", r"/metadata\.json$", ""), "/")
    return files.select(F.element_at(parts, -3).alias("model_id"), F.element_at(parts, -2).alias("vintage"), F.element_at(parts, -1).alias("run_id"), F.col("content").cast("string").alias("metadata"), "path", "modificationTime")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, file, bytes, role of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    role = F.when(name == "metadata.json", "metadata").when(name.endswith(".parquet"), "table").when(name.endswith(".csv"), "sidecar").otherwise("other")
    return files.select("path", name.alias("file"), F.col("length").alias("bytes"), role.alias("role"))


def flatten_json(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """keys..., key, text of the fields of JSON objects, one level; deeper ones stay JSON text."""
    return df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("key", "text"))


def register_runs(known: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The registry after a scan: new runs added, old ones kept with whether they are still there; a second scan changes nothing."""
    both = known.withColumn("_known", F.lit(True)).join(found.select(*keys).distinct().withColumn("_found", F.lit(True)), list(keys), "full")
    promoted = F.coalesce("promoted", F.lit(0))
    return both.select(*keys, promoted.alias("promoted"), F.coalesce("_found", F.lit(False)).alias("present_on_disk"))


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A Parquet table in partitions; the job's commit makes it whole or not there."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
