"""The library's tables, made from the star-schema tables: indices, weights, draw cubes, taxes, runs.

INDEX is the monthly mean order price by region, WEIGHTS the regions' share of a year's sales per thousand, CUBE the index
times a factor that depends on draw, month and region by arithmetic alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRAWS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, series (region), price of each order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Nations and regions are tables of fixed size.
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("series"))
    by_customer = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "series")
    return orders.join(by_customer, F.col("o_custkey") == F.col("c_custkey")).select("date", "series", F.col("o_totalprice").alias("value"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).groupBy("series", F.trunc("date", "month").alias("date")).agg(F.avg("value").alias("value"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sales(spark, sf_dir).groupBy(F.year("date").alias("year"), "series").agg(F.sum("value").alias("s"))
    return sums.select("year", "series", (1000 * F.col("s") / F.sum("s").over(Window.partitionBy("year"))).alias("w"))


def cube(spark: SparkSession, sf_dir: str, draws: int = DRAWS) -> DataFrame:
    level = index(spark, sf_dir)
    place = F.when(F.col("series") == "AFRICA", 0).when(F.col("series") == "AMERICA", 1).when(F.col("series") == "ASIA", 2).when(F.col("series") == "EUROPE", 3).otherwise(4)
    factor = 1 + ((F.col("draw") * 31 + F.month("date") * 17 + place * 13) % 101 - 50) / 1000.0
    return level.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("series", "draw", "date", (F.col("value") * factor).alias("value"))


def line_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean line price of each line number (a model) and return flag (its series); months without a line have null values."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("line "), "l_linenumber").alias("model_id"), F.col("l_returnflag").alias("series"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"), "l_extendedprice")
    means = lines.groupBy("model_id", "series", "date").agg(F.avg("l_extendedprice").alias("value"))
    span = means.groupBy("model_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    months = span.select("model_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("date"))
    return months.join(means.select("model_id", "series").distinct(), "model_id").join(means, ["model_id", "series", "date"], "left")


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log changes of line_levels() in per cent, null where a month or the one before has no value."""
    w = Window.partitionBy("model_id", "series").orderBy("date")
    made = line_levels(spark, sf_dir).withColumn("n", F.row_number().over(w)).withColumn("value", 100 * (F.log("value") - F.log(F.lag("value").over(w))))
    return made.filter("n > 1").drop("n")


def sparse_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices less an amount that makes some of them negative, by draw = o_orderkey mod 20."""
    orders = table(spark, sf_dir, "orders")
    return orders.select((F.col("o_orderkey") % 20).cast("int").alias("draw"), F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_totalprice") - 2000.0).alias("value"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price of each priority by week, dated by its Monday."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "week").alias("date")).agg(F.avg("o_totalprice").alias("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("value"))


def tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAT percent and excise by month, of line items' tax and discount."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg((100 * F.avg("l_tax")).alias("vat"), (1000 * F.avg("l_discount")).alias("excise"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as runs: brand the model, type the vintage."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("model_id"), F.col("p_type").alias("vintage"), F.concat(F.lit("r"), "p_partkey").alias("run_id"), F.col("p_size").alias("created"), F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0).alias("promoted"))


# The same in SQL, as common table expressions.
SALES = """sales AS (SELECT CAST(o_orderdate AS DATE) AS date, r_name AS series, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
INDEX = f"""{SALES}, idx AS (SELECT series, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value FROM sales GROUP BY 1, 2)"""
WEIGHTS = f"""{INDEX}, wsum AS (SELECT CAST(year(date) AS INTEGER) AS year, series, sum(value) AS s FROM sales GROUP BY 1, 2),
  wts AS (SELECT year, series, 1000 * s / sum(s) OVER (PARTITION BY year) AS w FROM wsum)"""
CUBE = f"""{WEIGHTS}, cube AS (SELECT series, CAST(draw AS INTEGER) AS draw, date, value * (1 + ((draw * 31 + month(date) * 17 +
  CASE series WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END * 13) % 101 - 50) / 1000.0) AS value
  FROM idx, (SELECT unnest(range(0, {DRAWS})) AS draw))"""
CHAIN = """dec AS (SELECT {k} series, year(date) + 1 AS year, value AS december FROM {t} WHERE month(date) = 12),
  shr AS (SELECT year, series, w / sum(w) OVER (PARTITION BY year) AS share FROM wts),
  rat AS (SELECT {tk} {t}.series, {t}.date, year({t}.date) AS year, share, value / december AS ratio FROM {t} JOIN dec ON {on} dec.series = {t}.series AND dec.year = year({t}.date) JOIN shr ON shr.series = {t}.series AND shr.year = year({t}.date)),
  gg AS (SELECT {k} year, date, sum(share * ratio) AS g FROM rat GROUP BY ALL HAVING count(*) = 5),
  anc AS (SELECT {k} year + 1 AS year, 100 * exp(sum(ln(g)) OVER ({p} ORDER BY year)) AS anchor FROM gg WHERE month(date) = 12),
  chain AS (SELECT {gk} gg.date, coalesce(anchor, 100) * g AS value, g, coalesce(anchor, 100) AS anchor FROM gg LEFT JOIN anc ON {oa} anc.year = gg.year),
  terms AS (SELECT {rk} rat.series, rat.date, anchor * share * ratio AS term, chain.value AS total FROM rat JOIN chain ON {oc} chain.date = rat.date)"""
CHAIN_ONE = f"{WEIGHTS}, " + CHAIN.format(k="", t="idx", tk="", on="", p="", gk="", oa="", rk="", oc="")
CHAIN_DRAWS = f"{CUBE}, " + CHAIN.format(k="draw,", t="cube", tk="cube.draw,", on="dec.draw = cube.draw AND", p="PARTITION BY draw", gk="gg.draw,", oa="anc.draw = gg.draw AND", rk="rat.draw,", oc="chain.draw = rat.draw AND")
WEEKLY = "weekly AS (SELECT o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
DAILY = "daily AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY 1, 2)"
TAX = "tax AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 100 * avg(l_tax) AS vat, 1000 * avg(l_discount) AS excise FROM lineitem GROUP BY 1)"
RUNS = "runs AS (SELECT p_brand AS model_id, p_type AS vintage, 'r' || p_partkey AS run_id, p_size AS created, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS promoted FROM part)"
MODES = """modes AS (SELECT 'line ' || l_linenumber AS model_id, l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
  mch AS (SELECT a.model_id, a.series, a.date, 100 * (ln(a.value) - ln(b.value)) AS value FROM modes a JOIN modes b ON b.model_id = a.model_id AND b.series = a.series AND a.date = b.date + INTERVAL 1 MONTH),
  mn AS (SELECT model_id, count(DISTINCT series) AS n FROM modes GROUP BY 1),
  mstart AS (SELECT model_id, min(date) AS start FROM (SELECT model_id, date FROM mch JOIN mn USING (model_id) GROUP BY model_id, date, n HAVING count(*) = n) GROUP BY 1)"""
SPARSE = "sparse AS (SELECT CAST(o_orderkey % 20 AS INTEGER) AS draw, o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, o_totalprice - 2000.0 AS value FROM orders)"
