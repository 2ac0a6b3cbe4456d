"""Dense numbers 1..n in a global order, without a one-partition window."""

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.sources.scratch import save_scratch

_ROW_BITS = 33  # monotonically_increasing_id(): partition number above, row number below


def row_in_partition() -> Column:
    """0-based place of a row in its partition."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def global_position(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the 1-based position of every row in a total order.

    Rows are range-partitioned and sorted, so a position is the rows in earlier
    partitions plus the row's place in its own. The partitioned rows are saved first:
    counting and numbering must see the same partitions even if a task is rerun.
    Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_at", _ROW_BITS).cast("int")
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    saved = save_scratch(placed, "positions").withColumns({"_part": part, "_row": row})
    counts = sorted(saved.groupBy("_part").count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame(
        [(p, start) for (p, _), start in zip(counts, starts)], "_part int, _offset bigint"
    )
    return saved.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_row") + 1).alias(name)
    )


def dense_key(df: DataFrame, columns: Sequence[str] | str, name: str = "key") -> DataFrame:
    """Distinct non-null ``columns`` numbered 1..n in their own order.

    The same ids always get the same numbers, however the input is partitioned.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    ids = df.select(*columns).dropna().distinct()
    return global_position(ids, columns, name)


def dense_keys(df: DataFrame, columns: Sequence[str], name: str = "key") -> dict[str, DataFrame]:
    """`dense_key` of each of several columns of one type, by a single sort.

    Distinct ids are sorted by (column, id); a column's numbers are the positions less
    those of the columns before it. Only one count per column reaches the driver.
    """
    one = F.array(*[F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_id")) for k, c in enumerate(columns)])
    ids = df.select(F.inline(one)).where(F.col("_id").isNotNull()).distinct()
    placed = global_position(ids, ["_kind", "_id"], "_place")
    sizes = dict(ids.groupBy("_kind").count().collect())
    out, before = {}, 0
    for k, c in enumerate(columns):
        out[c] = placed.where(F.col("_kind") == k).select(F.col("_id").alias(c), (F.col("_place") - before).alias(name))
        before += sizes.get(k, 0)
    return out
