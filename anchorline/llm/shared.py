"""What the operators share: written tables, marks of rows, checked joins, a hash."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.session import workspace

__all__ = ["SALTS", "ascii_lower", "mix", "row_mark", "small_enough", "spread_join", "table", "texts_of", "workspace", "written"]


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table: computed once, without lineage, and safe from lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts, at most; by default it is 10,000, which for texts of some KB are tens of MB in every task.
TEXT_ROWS = 1000


def texts_of(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches have TEXT_ROWS rows at most: for operators that send texts to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(docs.sparkSession.conf.get(name, "10000"))
    if not 0 < held <= TEXT_ROWS:
        docs.sparkSession.conf.set(name, TEXT_ROWS)
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that to texts of one byte a character."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def row_mark() -> Column:
    """What tells a document's doc_id and text from others, null-safe; rows with the same of both have the same results."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most so many rows; reads no more than are needed to tell."""
    return df.limit(rows + 1).count() <= rows


#: Parts over which the rows of one key are dealt where a join can't be broadcast.
SALTS = 16


def spread_join(large: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner", wide: str | None = None, most_bytes: int = 64 << 20, leave: Sequence[str] = ()) -> DataFrame:
    """A join to a side that is broadcast up to so many rows, else copied to each of SALTS parts of every key.

    ``wide`` names the column of ``small``, text or a list of texts, whose bytes together have a bound too; all others must have a
    fixed width. Columns of ``large`` in ``leave`` are not hashed to deal its rows.
    """
    light = small_enough(small, rows)
    if light and wide is not None:
        text = F.col(wide) if dict(small.dtypes)[wide] == "string" else F.concat_ws(" ", wide)
        light = (small.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0) <= most_bytes
    if light:
        return large.join(F.broadcast(small), on, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in large.columns if c not in leave]), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], how).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
