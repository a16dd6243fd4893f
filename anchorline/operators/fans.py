"""Draw cubes: keys..., draw, date, value. Summaries over draws, and operators that keep draws whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]
# The quantiles of a fan.
FAN = (0.05, 0.16, 0.5, 0.84, 0.95)


def names(quantiles: Sequence[float]) -> list[str]:
    return [f"q{round(100 * q):02d}" for q in quantiles]


def fan(paths: DataFrame, keys: Keys, quantiles: Sequence[float] = FAN, value: str = "value") -> DataFrame:
    """Mean and quantiles over draws, with linear interpolation; null and NaN draws are left out.

    Keys hold a bounded number of draws each, so exact quantiles are grouped per key and need no sort of the cube.
    """
    x = F.when(~F.isnan(value), F.col(value))
    out = paths.groupBy(*keys).agg(F.avg(x).alias("mean"), F.percentile(x, F.array(*[F.lit(q) for q in quantiles])).alias("q"), F.count(x).alias("n_draws"))
    return out.select(*keys, "mean", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names(quantiles))], "n_draws")


def percentile_grid(paths: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """P01 to P99, a row each; pointwise quantiles, which are no paths of a draw."""
    grid = paths.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(i / 100) for i in range(1, 100)])).alias("q"))
    return grid.select(*keys, F.posexplode("q").alias("i", "value")).select(*keys, (F.col("i") + 1).alias("p"), "value")


def paired_fan(baseline: DataFrame, scenario: DataFrame, keys: Keys, quantiles: Sequence[float] = FAN) -> DataFrame:
    """The fan of the draw-wise differences: never the difference of two fans."""
    both = baseline.join(scenario.withColumnRenamed("value", "other"), [*keys, "draw"])
    return fan(both.withColumn("effect", F.col("other") - F.col("value")), keys, quantiles, "effect")


def admissible(paths: DataFrame, keys: Keys = ()) -> DataFrame:
    """The draws all of whose values are finite and above 0; a draw with one bad value goes as a whole."""
    good = F.coalesce((F.col("value") > 0) & ~F.isnan("value") & (F.col("value") < float("inf")), F.lit(False))
    return paths.groupBy(*keys, "draw").agg(F.bool_and(good).alias("ok")).filter("ok").drop("ok")


def keep_draws(paths: DataFrame, draws: DataFrame, keys: Keys = ()) -> DataFrame:
    return paths.join(draws, [*keys, "draw"], "left_semi")


def rejection_rate(paths: DataFrame, keys: Keys) -> DataFrame:
    all_draws = paths.select(*keys, "draw").distinct().groupBy(*keys).agg(F.count("*").alias("draws"))
    kept = admissible(paths, keys).groupBy(*keys).agg(F.count("*").alias("kept"))
    return all_draws.join(kept, list(keys), "left").select(*keys, "draws", F.coalesce("kept", F.lit(0)).alias("kept"), (1 - F.coalesce("kept", F.lit(0)) / F.col("draws")).alias("rejected"))


def shuffled_rank(keys: Keys, seed: int):
    """A rank of draws that looks random and is the same in any engine: an arithmetic mix, ties by draw."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("draw") * 7919 + seed * 104729) % 100003, "draw"))


def draw_pairing(pools: DataFrame, n: int, seed: int) -> DataFrame:
    """pair_id, model, draw: n pairs that take each model's draws in a shuffled order, round and round in a small pool."""
    ranked = pools.withColumn("rank", shuffled_rank(["model"], seed) - 1).withColumn("size", F.count("*").over(Window.partitionBy("model")))
    sizes = ranked.select("model", "size").distinct()
    wanted = sizes.withColumn("pair_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("rank", F.pmod("pair_id", "size").cast("int"))
    return wanted.join(ranked.select("model", "rank", "draw"), ["model", "rank"]).select("pair_id", "model", "draw")


def compose_pairing(final: DataFrame, first: DataFrame) -> DataFrame:
    """Draws of a final pairing whose draws are the pair numbers of an earlier one: pair_id, model, draw of the models of that."""
    return final.select("pair_id", F.col("draw").alias("middle")).join(first.select(F.col("pair_id").alias("middle"), "model", "draw"), "middle").select("pair_id", "middle", "model", "draw")


def even_subset(draws: DataFrame, k: int, keys: Keys = ()) -> DataFrame:
    """keys..., draw: k draws at even spaces from the first to the last in their order; all of them if there are no more."""
    # The distinct draws of one of the keys, some thousands at most.
    w = Window.partitionBy(*keys)
    ranked = draws.select(*keys, "draw").distinct().withColumns({"at": F.row_number().over(w.orderBy("draw")) - 1, "n": F.count("*").over(w)})
    spots = F.array(F.lit(0)) if k == 1 else F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (k - 1)).cast("int"))
    return ranked.filter((F.col("n") <= k) | F.array_contains(spots, F.col("at"))).select(*keys, "draw")


def random_subset(draws: DataFrame, k: int, seed: int, keys: Keys = ()) -> DataFrame:
    return draws.withColumn("rank", shuffled_rank(keys, seed)).filter(F.col("rank") <= k).drop("rank")


def share_where(paths: DataFrame, keys: Keys, predicate) -> DataFrame:
    return paths.groupBy(*keys).agg(F.avg(predicate.cast("double")).alias("share"))
