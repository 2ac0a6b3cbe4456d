"""Parameter tables and the exhaustive search for item neighbourhoods."""

from collections.abc import Mapping, Sequence
from itertools import product
from math import exp, log
from random import Random as Generator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sessionloom.operators.evaluation import evaluation_parts, negatives
from sessionloom.operators.scorers import (
    PLACES,
    co_occurrence,
    cosine,
    weights,
)
from sessionloom.sources.scratch import save_scratch

# The search grid of the neighbourhood scorer.
GRID_K = (10, 50, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900, 1000)
GRID_SHRINK = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0)


def tune_item_knn(
    split: DataFrame,
    ks: Sequence[int] = GRID_K,
    shrinks: Sequence[float] = GRID_SHRINK,
    cutoff: int = 10,
    n_negatives: int = 99,
    seed: int = 42,
) -> DataFrame:
    """MRR@cutoff on the validation items for every (k, shrink), best first.

    Dot products are computed once, and a pair of items stays one row: the rankings of an
    item's neighbours under all shrink values share one shuffle, and the pair carries its
    similarity and place under each. Every k is then a prefix of a ranking. Rows are
    multiplied by the grid only where a session's scores are summed, after its evidence has
    come together. Validation candidates are the target and sampled negatives. A target that
    occurs with none of its session's items has no rank at any point of the grid, so nothing
    is drawn or scored for its session, which still counts in the mean.
    """
    train, history, targets = evaluation_parts(split, "valid")
    pairs = save_scratch(co_occurrence(train), "pairs")
    near = targets.select("user_id", F.col("item_id").alias("neighbour"))
    met = weights(history).join(near, "user_id").join(
        pairs.select(F.col("item").alias("item_id"), "neighbour"), ["item_id", "neighbour"], "left_semi"
    )
    met = save_scratch(met.select("user_id").distinct(), "met")
    history, measured = (df.join(met, "user_id", "left_semi") for df in (history, targets))
    needed = save_scratch(history.select(F.col("item_id").alias("item")).distinct(), "needed")
    pairs = pairs.join(needed, "item", "left_semi")
    drawn = negatives(measured, history, split, n_negatives, seed)
    candidates = (
        measured.select("user_id", "item_id", F.lit(True).alias("is_target"))
        .unionByName(drawn.select("user_id", "item_id", F.lit(False).alias("is_target")))
        .withColumnRenamed("item_id", "neighbour")
    )
    sims = [cosine(F.col("dot"), F.col("norm"), F.col("norm_near"), F.lit(float(v))) for v in shrinks]
    placed = pairs.withColumns({f"_s{g}": sim for g, sim in enumerate(sims)})
    for g in range(len(shrinks)):
        nearest = Window.partitionBy("item").orderBy(F.col(f"_s{g}").desc(), "neighbour")
        placed = placed.withColumn(f"_p{g}", F.row_number().over(nearest))
    grid = [
        F.struct(F.lit(float(v)).alias("shrink"), F.col(f"_s{g}").alias("sim"), F.col(f"_p{g}").alias("place"))
        for g, v in enumerate(shrinks)
    ]
    similar = placed.select(
        F.col("item").alias("item_id"), "neighbour",
        F.filter(F.array(*grid), lambda point: point["place"] <= max(ks)).alias("_grid"),
    ).where(F.size("_grid") > 0)
    evidence = (
        weights(history)
        .join(candidates.select("user_id", "neighbour", "is_target"), "user_id")
        .join(similar, ["item_id", "neighbour"])
        .repartition("user_id")
        .select("user_id", "neighbour", "is_target", "x", F.inline("_grid"))
    )
    value = F.col("x") * F.col("sim")
    sums = evidence.groupBy("user_id", "neighbour", "is_target", "shrink").agg(
        *[F.round(F.sum(F.when(F.col("place") <= k, value)), PLACES).alias(f"k{k}") for k in ks]
    )
    points = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("score")) for k in ks]
    )
    scored = (
        sums.select("user_id", "neighbour", "is_target", "shrink", F.explode(points).alias("p"))
        .select("user_id", "neighbour", "is_target", "shrink", "p.*")
        .where(F.col("score").isNotNull())
    )
    best = Window.partitionBy("user_id", "shrink", "k").orderBy(F.col("score").desc(), "neighbour")
    found = (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= cutoff)
        .where("is_target")
        .groupBy("k", "shrink")
        .agg(F.sum(F.lit(1.0) / F.col("rank")).alias("_sum"))
    )
    asked = targets.agg(F.count("*").alias("n")).scalar()
    points_table = grid_table(split.sparkSession, {"k": ks, "shrink": [float(s) for s in shrinks]})
    return (
        points_table.join(F.broadcast(found), ["k", "shrink"], "left")
        .select("k", "shrink", F.coalesce(F.try_divide("_sum", asked), F.lit(0.0)).alias("mrr"))
        .orderBy(F.col("mrr").desc(), "k", "shrink")
    )


def grid_table(spark: SparkSession, space: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the listed values, one row each."""
    names = list(space)
    return spark.createDataFrame(list(product(*space.values())), names).select(
        *[F.col(c).cast("int") if all(isinstance(v, int) for v in space[c]) else F.col(c) for c in names]
    )


def _draw(spec: Mapping, rng: Generator):
    kind = spec["type"]
    if kind == "choice":
        return rng.choice(list(spec["values"]))
    low, high = spec["min"], spec["max"]
    if kind == "uniform":
        return rng.uniform(low, high)
    if kind == "loguniform":
        return exp(rng.uniform(log(low), log(high)))
    if kind == "randint":
        return rng.randrange(low, high)
    if kind == "quniform":
        return round(rng.uniform(low, high) / spec["q"]) * spec["q"]
    raise ValueError(f"unknown parameter type {kind!r}")


def random_table(spark: SparkSession, space: Mapping[str, Mapping], trials: int = 20, seed: int = 42) -> DataFrame:
    """Seeded random draws from choice, uniform, loguniform, randint and quniform specs."""
    rng = Generator(seed)
    rows = [tuple(_draw(spec, rng) for spec in space.values()) for _ in range(trials)]
    return spark.createDataFrame(rows, list(space))
