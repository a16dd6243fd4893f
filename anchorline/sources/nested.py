"""Nested documents as relations: JSON of any depth, and statistical cubes whose dimensions their own payload names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.session import workspace


def children(text: Column) -> Column:
    """The members of a JSON object or list as (step, text): ``.key`` or ``[place]``, and the member's own JSON."""
    listed = F.transform(F.from_json(text, "array<variant>"), lambda v, k: F.struct(F.concat(F.lit("["), k.cast("string"), F.lit("]")).alias("step"), F.to_json(v).alias("text")))
    named = F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), F.to_json(e["value"]).alias("text")))
    return F.when(F.startswith(text, F.lit("[")), listed).otherwise(named)


def json_paths(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """keys..., path (``$.a.list[0]``), text of every scalar in JSON documents of any depth, lists included.

    Strings are without quotes, null is null; empty objects and lists have no row, a document that is a scalar has the path ``$``. Each
    level is exploded at once for all documents and written, so there are as many steps as the deepest document has levels.
    """
    base, level = workspace(df.sparkSession, "json-paths"), 0
    rows = df.filter(F.col(column).isNotNull()).select(*keys, F.lit("$").alias("path"), F.to_json(F.parse_json(F.col(column))).alias("text"))
    found = None
    while True:
        rows.write.mode("overwrite").parquet(f"{base}/{level}")
        rows = df.sparkSession.read.parquet(f"{base}/{level}")
        nested = F.col("text").startswith("{") | F.col("text").startswith("[")
        scalar = F.when(F.col("text") == "null", None).when(F.col("text").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "text", F.lit("}")), "v string")["v"]).otherwise(F.col("text"))
        done = rows.filter(~nested).select(*keys, "path", scalar.alias("text"))
        found = done if found is None else found.unionByName(done)
        deeper = rows.filter(nested)
        if deeper.isEmpty():
            return found
        deeper = deeper.select(*keys, "path", F.explode(children(F.col("text"))).alias("c"))
        rows, level = deeper.select(*keys, F.concat("path", "c.step").alias("path"), F.col("c.text").alias("text")), level + 1


CUBE = "id array<string>, size array<int>, dimension map<string, struct<category: struct<index: map<string, int>>>>"


def labelled_cubes(cubes: DataFrame, keys: Sequence[str], column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Of JSON cubes with ``id``, ``size``, ``dimension`` and a list or a map by position of values: their cells, and what is wrong with them.

    Cells are keys..., codes (dimension to code), value; nulls are no cells. A position counts through the dimensions in the order of ``id``, the
    last one fastest, so the order of dimensions doesn't matter to a reader by name. Violations are keys..., problem: a list that is
    not as long as the product of the sizes, positions outside it, and dimensions whose codes are not as many as their size. A cube
    with a violation still gives the cells that have a place.
    """
    raw = F.get_json_object(column, "$.value")
    dense = F.startswith(raw, F.lit("["))
    held = cubes.select(*keys, F.from_json(column, CUBE).alias("c"), dense.alias("dense"), F.when(dense, F.from_json(raw, "array<double>")).alias("list"), F.when(~dense, F.from_json(raw, "map<string,double>")).alias("map"))
    held = held.select(*keys, "c.*", "dense", "list", "map").withColumn("cells", F.aggregate("size", F.lit(1).cast("long"), lambda a, n: a * n))
    codes = F.transform("id", lambda d: F.map_from_entries(F.transform(F.map_entries(F.col("dimension")[d]["category"]["index"]), lambda e: F.struct(e["value"], e["key"]))))
    stride = F.transform("size", lambda _, k: F.aggregate(F.slice("size", k + 2, F.size("size")), F.lit(1).cast("long"), lambda a, n: a * n))
    held = held.withColumns({"codes": codes, "stride": stride})
    listed = F.transform("list", lambda v, k: F.struct(k.cast("long").alias("position"), v.alias("value")))
    mapped = F.transform(F.map_entries("map"), lambda e: F.struct(e["key"].cast("long").alias("position"), e["value"].alias("value")))
    each = held.select(*keys, "id", "size", "codes", "stride", "cells", F.explode(F.when(F.col("dense"), listed).otherwise(mapped)).alias("v")).filter("v.value is not null")
    inside = (F.col("v.position") >= 0) & (F.col("v.position") < F.col("cells"))
    at = F.transform("id", lambda d, k: F.struct(d, F.col("codes")[k][((F.col("v.position") / F.col("stride")[k]).cast("long") % F.col("size")[k]).cast("int")]))
    cells = each.filter(inside).select(*keys, F.map_from_entries(at).alias("codes"), F.col("v.value").alias("value"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    length = held.filter(F.col("dense") & (F.size("list") != F.col("cells"))).select(*keys, text(F.size("list").cast("string"), " values for ", F.col("cells").cast("string"), " cells").alias("problem"))
    outside = each.filter(~inside).select(*keys, text("position ", F.col("v.position").cast("string"), " of ", F.col("cells").cast("string")).alias("problem"))
    sizes = F.explode(F.transform("id", lambda d, k: F.struct(d.alias("d"), F.size(F.col("codes")[k]).alias("n"), F.col("size")[k].alias("size"))))
    wrong = held.select(*keys, sizes.alias("s")).filter("s.n <> s.size").select(*keys, text("dimension ", F.col("s.d"), " has ", F.col("s.n").cast("string"), " codes for ", F.col("s.size").cast("string")).alias("problem"))
    return cells, length.unionByName(outside).unionByName(wrong)
