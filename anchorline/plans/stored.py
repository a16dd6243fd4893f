"""Queries of stored and nested data: documents, cubes, archives, registries, replays and contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators import align as J
from anchorline.operators import calendar as T
from anchorline.operators import models as M
from anchorline.operators import scenarios as N
from anchorline.operators import tax as W
from anchorline.operators import validate as V
from anchorline.plans import posteriors as P
from anchorline.plans import proxies as X
from anchorline.plans.queries import query, r
from anchorline.schemas import struct
from anchorline.session import workspace
from anchorline.sources import cubes, nested, store
from anchorline.sources import workbook as B


@query("""SELECT event_id, fullkey AS path, json_extract_string(atom, '$') AS text
  FROM (SELECT event_id, '{"outer":{"inner":' || props || ',"list":[' || event_id || ',{"again":' || props || '},[]]},"type":"' || event_type || '","none":null}' AS j FROM events), json_tree(j)
  WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def json_paths(s, d):
    """Every scalar of documents that hold the events' properties at two depths."""
    doc = F.format_string('{"outer":{"inner":%s,"list":[%d,{"again":%s},[]]},"type":"%s","none":null}', "props", "event_id", "props", "event_type")
    return nested.json_paths(X.table(s, d, "events").select("event_id", doc.alias("j")), "j", ["event_id"])


def payloads(s, d) -> DataFrame:
    """A cube of monthly sums by region for each order priority: dimensions in one order or the other, values as a list or by position."""
    sums = X.sales(s, d).groupBy("series", F.trunc("date", "month").alias("date")).agg(F.sum("value").alias("value"))
    sums = sums.select(F.when(F.year("date") % 2 == 0, "even").otherwise("odd").alias("cube"), F.date_format("date", "yyyy-MM").alias("time"), F.col("series").alias("geo"), "value")
    place = lambda c: (F.dense_rank().over(Window.partitionBy("cube").orderBy(c)) - 1).alias(f"{c}_at")
    rows = sums.select("cube", "time", "geo", "value", place("time"), place("geo"))
    n = rows.groupBy("cube").agg((F.max("time_at") + 1).alias("times"), (F.max("geo_at") + 1).alias("geos"))
    turned = F.col("cube") == "odd"
    rows = rows.join(n, "cube").withColumn("position", F.when(turned, F.col("geo_at") * F.col("times") + F.col("time_at")).otherwise(F.col("time_at") * F.col("geos") + F.col("geo_at")))
    # A cube is one response of an interface, some hundreds of cells.
    each = rows.groupBy("cube", "times", "geos").agg(
        F.map_from_entries(F.collect_set(F.struct("time", "time_at"))).alias("time"), F.map_from_entries(F.collect_set(F.struct("geo", "geo_at"))).alias("geo"), F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("v")
    )
    category = lambda c: F.struct(F.struct(F.col(c).alias("index")).alias("category"))
    order = F.when(turned, F.array(F.lit("geo"), F.lit("time"))).otherwise(F.array(F.lit("time"), F.lit("geo")))
    size = F.when(turned, F.array("geos", "times")).otherwise(F.array("times", "geos"))
    head = F.struct(order.alias("id"), size.alias("size"), F.create_map(F.lit("time"), category("time"), F.lit("geo"), category("geo")).alias("dimension"))
    listed = F.to_json(F.transform(F.sequence(F.lit(0), F.col("times") * F.col("geos") - 1), lambda k: F.col("v")[k]))
    values = F.when(turned, F.to_json(F.transform_keys("v", lambda k, _: k.cast("string")))).otherwise(listed)
    return each.select("cube", F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"value":'), values, F.lit("}")).alias("payload"))


@query(f"WITH {X.SALES} SELECT CASE WHEN year(date) % 2 = 0 THEN 'even' ELSE 'odd' END AS cube, strftime(date_trunc('month', date), '%Y-%m') AS time, series AS geo, {r('sum(value)', 2)} AS value FROM sales GROUP BY 1, 2, 3", digits=2)
def labelled_cubes(s, d):
    cells, _ = nested.labelled_cubes(payloads(s, d), ["cube"])
    return cells.select("cube", F.col("codes")["time"].alias("time"), F.col("codes")["geo"].alias("geo"), "value")


@query(f"WITH {X.SALES}, m AS (SELECT CASE WHEN year(date) % 2 = 0 THEN 'even' ELSE 'odd' END AS cube, count(DISTINCT date_trunc('month', date)) * count(DISTINCT series) AS n FROM sales GROUP BY 1) SELECT cube, CASE WHEN cube = 'even' THEN (n + 1) || ' values for ' || n || ' cells' ELSE 'position ' || n || ' of ' || n END AS problem FROM m UNION ALL SELECT cube, 'position ' || n || ' of ' || n FROM m WHERE cube = 'even'")
def labelled_cube_problems(s, d):
    """The same cubes with a value more than they have cells."""
    size = F.aggregate(F.from_json(F.get_json_object("payload", "$.size"), "array<int>"), F.lit(1), lambda a, n: a * n)
    more = F.when(F.col("payload").endswith("]}"), F.regexp_replace("payload", r"\]\}$", ",1.0]}")).otherwise(F.concat(F.regexp_replace("payload", r"\}\}$", ',"'), size.cast("string"), F.lit('":1.0}}')))
    return nested.labelled_cubes(payloads(s, d).select("cube", more.alias("payload")), ["cube"])[1]


@query(f"WITH {X.CUBE}, p AS (SELECT *, row_number() OVER (PARTITION BY series, draw ORDER BY date) - 1 AS place FROM cube) SELECT series, 'paths' AS array, CAST(draw AS BIGINT) AS draw, place, {r('value', 4)} AS value FROM p", digits=4)
def posterior_archive(s, d):
    """Each region's paths as an archive of arrays, and all archives read back."""
    w = Window.partitionBy("series", "draw").orderBy("date")
    rows = X.cube(s, d).select("series", F.lit("paths").alias("array"), F.col("draw").cast("long").alias("draw"), (F.row_number().over(w) - 1).cast("long").alias("place"), "value")
    made = cubes.write_archives(rows, workspace(s, "archives"), ["series"]).collect()  # a row a region
    return reduce(DataFrame.unionByName, [cubes.read_archive(s, m["uri"], rows="10").select(F.lit(m["series"]).alias("series"), "array", "draw", "place", "value") for m in made])


@query(f"WITH {X.CUBE}, p AS (SELECT *, row_number() OVER (PARTITION BY series, draw ORDER BY date) - 1 AS place FROM cube) SELECT draw + 0::BIGINT AS draw, place, {r('value', 4)} AS value FROM p WHERE series = 'ASIA' AND draw = 7", digits=4)
def posterior_archive_one_draw(s, d):
    """One draw of one archive: its own bytes."""
    w = Window.partitionBy("draw").orderBy("date")
    rows = X.cube(s, d).filter("series = 'ASIA'").select("series", F.lit("paths").alias("array"), F.col("draw").cast("long").alias("draw"), (F.row_number().over(w) - 1).cast("long").alias("place"), "value")
    (made,) = cubes.write_archives(rows, workspace(s, "archive"), ["series"]).collect()
    return cubes.read_archive(s, made["uri"], draws="7:8").select("draw", "place", "value")


@query(f"WITH {X.RUNS} SELECT model_id, vintage, run_id, created, CASE WHEN row_number() OVER (PARTITION BY model_id, vintage ORDER BY created DESC, run_id) = 1 THEN 1 ELSE 0 END AS promoted FROM runs")
def registry_commits(s, d):
    """A registry in three commits: older runs, then the others, then the newest of each key promoted."""
    root, keys = workspace(s, "commits"), ["model_id", "vintage"]
    runs = X.runs(s, d).withColumn("promoted", F.lit(0))
    store.change(s, root, lambda _: runs.filter("created <= 25"), keys)
    store.change(s, root, lambda held: J.upsert(held, runs.filter("created > 25"), [*keys, "run_id"]), keys)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created"), "run_id")) == 1
    store.change(s, root, lambda held: held.withColumn("promoted", F.when(newest, 1).otherwise(0)), keys)
    return store.read_version(s, root)


@query(f"WITH {X.INDEX}, y AS (SELECT min(year(date)) AS lo, max(year(date)) AS hi FROM idx) SELECT CAST(lo AS INTEGER) AS year, 'missing' AS problem FROM y UNION ALL SELECT CAST(hi AS INTEGER), 'changed' FROM y")
def integrity_check(s, d):
    """A persisted baseline of yearly signatures against a table whose first year is gone and whose last has one value changed."""
    held = X.index(s, d).withColumn("year", F.year("date")).withColumn("value", F.round("value", 6))
    path = workspace(s, "baseline")
    V.part_signatures(held, ["year"]).write.mode("overwrite").parquet(path)
    ends = held.agg(F.min("year").alias("lo"), F.max("date").alias("last"))  # one row
    other = held.join(F.broadcast(ends), F.col("year") > F.col("lo")).withColumn("value", F.when(F.col("date") == F.col("last"), F.col("value") + 1.0).otherwise(F.col("value"))).select(held.columns)
    return V.integrity_violations(s.read.parquet(path), V.part_signatures(other, ["year"]), ["year"])


@query(f"WITH {X.MODES}, c AS (SELECT DISTINCT model_id, series FROM modes) SELECT CAST(count(*) * {P.DRAWS} * 6 * 2 AS BIGINT) AS rows, 0::BIGINT AS alone, 0.0 AS gap, true AS same FROM c")
def replay_gap(s, d):
    """Stored forecasts, and their shocks' deviations, against the same forecasts made again from the stored posterior."""

    def made():
        paths = M.simulate(P.structural(s, d), P.ends(s, d), ["model_id"], 6, 77, spreads=True)
        return paths.select("model_id", "series", "draw", F.add_months(F.lit("2001-12-01").cast("date"), F.col("h")).alias("date"), "value")

    path = workspace(s, "forecast")
    made().write.mode("overwrite").parquet(path)
    return N.replay_gap(s.read.parquet(path), made(), ["model_id", "series"])


@query("SELECT 'missing unit string' AS problem, 0::BIGINT AS rows WHERE 'unit' NOT IN (SELECT column_name FROM (DESCRIBE events)) UNION ALL SELECT 'user_id is bigint, not string', 0 WHERE 'VARCHAR' <> (SELECT column_type FROM (DESCRIBE events) WHERE column_name = 'user_id') UNION ALL SELECT 'record type ' || event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase') GROUP BY 1")
def schema_contract(s, d):
    """What of the events' columns, types and record types departs from a contract."""
    events = X.table(s, d, "events")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    wanted = struct("event_id long, ts timestamp, user_id string, event_type string, value double, props string, unit string")
    found = events.select(*[F.col(c).cast("timestamp").alias(c) if kinds[c].startswith("timestamp") else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in events.columns])
    columns = s.createDataFrame([(p, 0) for p in V.schema_problems(found, wanted)], "problem string, rows long")
    return columns.unionByName(V.record_problems(events, "event_type", ["click", "view", "signup", "purchase"], {"purchase": "value"}))


WEEKS = "wk AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1), st AS (SELECT draw, date, CASE WHEN date < DATE '1998-01-05' THEN value ELSE value * (1 + draw / 100.0) END AS value FROM wk, (SELECT unnest(range(0, 8)) AS draw)), cal AS (SELECT CAST(date_trunc('month', x) AS DATE) AS date, count(*) AS expected FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2010-12-31', INTERVAL 1 DAY)) AS x) WHERE isodow(x) = 1 GROUP BY 1)"


@query(f"WITH {WEEKS}, m AS (SELECT draw, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value, count(*) AS n FROM st GROUP BY 1, 2) SELECT 'all' AS series, CAST(draw AS INTEGER) AS draw, m.date, {r('value')} AS value FROM m JOIN cal ON cal.date = m.date AND n = expected")
def stitched_months(s, d):
    """Weekly prices up to 1998 and draws of the weeks after, as monthly means of complete months."""
    weeks = X.table(s, d, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date")).agg(F.avg("l_extendedprice").alias("value")).withColumn("series", F.lit("all"))
    later = weeks.filter("date >= '1998-01-05'").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("value", F.col("value") * (1 + F.col("draw") / 100.0))
    return T.stitched_months(weeks, later, ["series"])


@query(f"WITH {X.INDEX}, e AS (SELECT series, max(date) AS hi FROM idx GROUP BY 1), h AS (SELECT unnest(range(1, 25)) AS h) SELECT e.series, CAST(h AS INTEGER) AS h, CASE WHEN h NOT IN (5, 17) THEN {r('b.value * (CASE WHEN h > 12 THEN (1 + (h - 12) / 100.0) ELSE 1 END) * (1 + h / 100.0)')} END AS value FROM e, h LEFT JOIN idx b ON b.series = e.series AND b.date = CAST(e.hi + (h - 12 * CAST(ceil(h / 12.0) AS INTEGER)) * INTERVAL 1 MONTH AS DATE)")
def yearly_growth_path(s, d):
    """Two years of conditions by a vector of growth over twelve months, of which one month has none."""
    rates = X.index(s, d).select("series").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(24)))).withColumn("rate", F.when(F.col("h") != 5, F.col("h").cast("double")))
    return W.yearly_growth_path(X.index(s, d), ["series"], rates)


@query(f"WITH {X.INDEX}, m AS (SELECT *, year(date) % 2 = 0 AS missing FROM idx) SELECT series AS sheet, date, 'price' AS series, CASE WHEN NOT missing THEN {r('value')} END AS value FROM m WHERE NOT missing UNION ALL SELECT series, date, 'marker', NULL FROM m WHERE missing")
def workbook_round_trip(s, d):
    """A workbook with a sheet for each region, in the newest of two vintages: dates, prices, and markers where there is none."""
    root = workspace(s, "workbooks")
    table = X.index(s, d).withColumn("missing", F.year("date") % 2 == 0)
    table = table.select("series", "date", F.when(~F.col("missing"), F.col("value")).alias("price"), F.when(F.col("missing"), "#N/A").alias("marker"))
    for vintage, rows in (("20240131", table.limit(1)), ("20240229", table)):
        path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{vintage}")
        path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        B.write_cells(B.table_cells(rows, "series", ["date"], ["date", "price", "marker"]), f"{root}/{vintage}/data.xlsx")
    cells = B.read_cells(s, B.newest_workbook(s, root, "data.xlsx"))
    return B.dated_sheet(cells, {"price": "price", "marker": "marker"}, "date")


@query(f"WITH {X.MODES} SELECT model_id, count(*) AS observations, CAST({P.DRAWS} AS BIGINT) AS draws FROM mch GROUP BY 1")
def stored_runs(s, d):
    """Panels and posteriors of all models stored by run, and one run after another rebuilt from its folders."""
    root, run = workspace(s, "runs"), {"vintage": "20240229", "run_id": "r1", "forecast_name": "baseline"}
    named = lambda df: df.withColumns({k: F.lit(v) for k, v in run.items()})
    store.save(named(X.line_changes(s, d).filter("value is not null")), root, "panel")
    store.save(named(P.structural(s, d).filter("kind in ('b', 'a', 'h', 'phi', 'outlier')")), root, "posterior")
    models = [x["model_id"] for x in X.line_changes(s, d).select("model_id").distinct().collect()]  # a row a model
    out = []
    for model in models:
        panel, draws = store.rebuild(s, root, P.DRAWS, model_id=model, run_id="r1")
        out.append(panel.groupBy("model_id").agg(F.count("*").alias("observations")).join(draws.groupBy("model_id").agg(F.count_distinct("draw").alias("draws")), "model_id"))
    return reduce(DataFrame.unionByName, out)
