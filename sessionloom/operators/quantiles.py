"""Exact quantiles of any values, without gathering a group or its distinct values in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.sources.scratch import save_scratch


def exact_quantiles(
    values: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], weight: Column | None = None
) -> DataFrame:
    """``groups``, ``n`` and the array ``quantiles`` of each group, linear between neighbours.

    Equal values are counted first, so each is one row with its weight (a count; 1 by
    default), however often it occurs. These rows are range-sorted by group and value and
    written; a value's places are the weights of the partitions before it plus a running
    sum inside its own. Only the rows that hold a quantile's places are added up. Null
    values are left out.
    """
    groups = list(groups)
    tally = values.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(
        F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("_w")
    )
    saved = save_scratch(tally.repartitionByRange(*groups, "_v").withColumn("_part", F.spark_partition_id()), "tally")
    sums = saved.groupBy(*groups, "_part").agg(F.sum("_w").alias("_sum"))  # a row per group and partition
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups, "_part", F.sum("_sum").over(whole).alias("n"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*groups, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = saved.join(offsets, [*groups, "_part"]).withColumn("_end", F.col("_before") + F.sum("_w").over(inside))
    picks = []
    for p in probabilities:
        exact = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(exact)
        has = lambda place: ((place >= F.col("_end") - F.col("_w")) & (place < F.col("_end"))).cast("double")
        share = has(low) * (F.lit(1.0) - (exact - low)) + has(low + 1) * (exact - low)
        picks.append(F.sum(F.when(share > 0, share * F.col("_v"))))
    return placed.groupBy(*groups, "n").agg(F.array(*picks).alias("quantiles"))
