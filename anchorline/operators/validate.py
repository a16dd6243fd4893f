"""Checks as queries that count or list violations; none raises unless asked to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def panel_violations(df: DataFrame, keys: Sequence[str], step: str = "month") -> DataFrame:
    """Of each key: repeated dates, irregular steps, values that are not finite or not positive, and whether all are null."""
    w = Window.partitionBy(*keys).orderBy("date")
    next_date = F.add_months(F.lag("date").over(w), 1) if step == "month" else F.date_add(F.lag("date").over(w), 7)
    x = F.col("value")
    marked = df.withColumn("_before", F.lag("date").over(w)).withColumn("_next", next_date)
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("date") == F.col("_before")).alias("repeated"),
        F.count_if(F.col("_before").isNotNull() & (F.col("date") != F.col("_before")) & (F.col("date") != F.col("_next"))).alias("irregular"),
        F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite"),
        F.count_if(x <= 0).alias("not_positive"),
        (F.count(x) == 0).alias("all_null"),
    )


def start_contract(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each series' first date against the one it should have (keys, expected)."""
    first = df.filter("value is not null").groupBy(*keys).agg(F.min("date").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("actual") == F.col("expected"), "ok").otherwise("moved")
    return expected.join(first, list(keys), "full").withColumn("status", status)


def schema_problems(df: DataFrame, schema: StructType) -> list[str]:
    """What of a frame's columns, their order or types departs from the schema."""
    found, wanted = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    if found == wanted:
        return []
    out = [f"missing {n} {t}" for n, t in wanted if n not in dict(found)] + [f"unexpected {n}" for n, _ in found if n not in dict(wanted)]
    out += [f"{n} is {dict(found)[n]}, not {t}" for n, t in wanted if dict(found).get(n, t) != t]
    return out or ["columns are in another order"]


def record_problems(df: DataFrame, column: str, allowed: Sequence[str], needs: dict[str, str]) -> DataFrame:
    """problem, rows: record types that a contract does not know, and rows of a type that lack the column it ``needs``."""
    kind = F.col(column)
    unknown = df.filter(kind.isNull() | ~kind.isin(*allowed)).groupBy(F.concat(F.lit("record type "), F.coalesce(kind, F.lit("null"))).alias("problem")).agg(F.count("*").alias("rows"))
    lacking = F.lit(None).cast("string")
    for name, wanted in needs.items():
        lacking = F.when((kind == name) & F.col(wanted).isNull(), f"{name} without {wanted}").otherwise(lacking)
    return unknown.unionByName(df.select(lacking.alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("rows")))


def part_signatures(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """parts..., rows, signature of every part of a table: sums of two halves of its rows' SHA-256, so order does not matter and repeats count."""
    half = lambda at: F.sum(F.conv(F.substring("sha", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    hashed = df.select(*parts, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha"))
    return hashed.groupBy(*parts).agg(F.count("*").alias("rows"), F.concat_ws(":", half(1), half(16)).alias("signature"))


def integrity_violations(baseline: DataFrame, found: DataFrame, parts: Sequence[str]) -> DataFrame:
    """parts..., problem of what departs from a persisted baseline of part_signatures(): missing, unexpected or changed."""
    a, b = (df.select(*parts, F.col("signature").alias(name)) for df, name in ((baseline, "held"), (found, "now")))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("held").isNull(), "unexpected").when(F.col("held") != F.col("now"), "changed")
    return a.join(b, list(parts), "full").withColumn("problem", problem).filter("problem is not null").select(*parts, "problem")


def backfilled(baseline: DataFrame, found: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The baseline with signatures of the parts that it lacks; what it has stays, changed or not."""
    return baseline.unionByName(found.join(baseline.select(*parts), list(parts), "left_anti"))


def require_none(violations: DataFrame, message: str) -> None:
    if not violations.isEmpty():
        raise ValueError(f"{message}: {violations.limit(5).collect()}")
