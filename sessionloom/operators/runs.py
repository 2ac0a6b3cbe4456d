"""Benchmark run tables: merge, rank and summarise."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.functions.labels import metric_cutoff, metric_name
from sessionloom.operators.quantiles import exact_quantiles


def metric_columns(runs: DataFrame) -> list[str]:
    return [c for c in runs.columns if c.startswith("test_")]


def resolve_metric(runs: DataFrame, metric: str) -> str:
    """The column of that name, else the one that differs only in case."""
    if metric in runs.columns:
        return metric
    for c in runs.columns:
        if c.lower() == metric.lower():
            return c
    raise ValueError(f"no metric column {metric!r}")


def merge_runs(runs: DataFrame) -> DataFrame:
    """One run per model and data set: the latest evaluation run, else the latest training run.

    Latest means last by name, then by id. Names and ids of both kinds are kept.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in runs.columns])
    names = F.struct("run_name", "run_id")
    is_eval = F.col("is_eval")
    rest = [c for c in runs.columns if c not in ("model", "dataset")]
    return (
        runs.groupBy("model", "dataset")
        .agg(
            F.max_by(whole, F.struct("is_eval", "run_name", "run_id")).alias("_best"),
            F.max_by(names, F.when(is_eval, names)).alias("_eval"),
            F.max_by(names, F.when(~is_eval, names)).alias("_train"),
        )
        .select(
            "model",
            "dataset",
            *[F.col("_best")[c].alias(c) for c in rest],
            F.col("_eval.run_name").alias("eval_run_name"),
            F.col("_eval.run_id").alias("eval_run_id"),
            F.col("_train.run_name").alias("train_run_name"),
            F.col("_train.run_id").alias("train_run_id"),
        )
    )


def rank_models(runs: DataFrame, metric: str = "test_MRR@10") -> DataFrame:
    """Model, data set, run and the metric, best first, runs without it last."""
    name = resolve_metric(runs, metric)
    value = F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None))
    return runs.select("model", "dataset", "run_name", value.alias(name)).orderBy(
        F.col(f"`{name}`").desc_nulls_last(), "model", "dataset"
    )


def long_metrics(runs: DataFrame, ids: Sequence[str] = ("model", "dataset", "run_name")) -> DataFrame:
    """One row per run and metric column."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias("value"))
            for c in metric_columns(runs)
        ]
    )
    return runs.select(*ids, F.explode(cells).alias("m")).select(*ids, "m.*")


def rank_models_by_k(runs: DataFrame) -> DataFrame:
    """Models ranked by mean value for each metric and cut-off, missing values last."""
    means = (
        long_metrics(runs)
        .where(F.col("name").contains("@"))
        .groupBy(metric_name(F.col("name")).alias("metric"), metric_cutoff(F.col("name")).alias("topk"), "model")
        .agg(F.avg("value").alias("value"))
    )
    best = Window.partitionBy("metric", "topk").orderBy(F.col("value").desc_nulls_last(), "model")
    return means.withColumn("rank", F.row_number().over(best)).select(
        "metric", "topk", "rank", "model", "value"
    )


def metric_means(runs: DataFrame) -> DataFrame:
    """Mean of every metric per model."""
    return runs.groupBy("model").agg(
        *[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(c) for c in metric_columns(runs)]
    )


def metric_quartiles(
    runs: DataFrame, probabilities: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)
) -> DataFrame:
    """Exact quantiles of every metric, linear between neighbours; missing values dropped."""
    found = exact_quantiles(long_metrics(runs), ["name"], "value", probabilities)
    return found.select(
        F.col("name").alias("metric"),
        "n",
        *[F.col("quantiles")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probabilities)],
    )
