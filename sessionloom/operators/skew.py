"""Ordered per-key work that stays correct and parallel when one key is huge.

A window puts each key into one task. Most keys (sessions) are tiny, so that is the
right plan for them. The rows of the few keys that hold a large share of all rows are
range-sorted by key and the whole order (time, then event id), which cuts them into
slices of about equal numbers of rows, whatever their times are: a burst in one instant
is cut as well. Each slice is windowed on its own and a small per-slice table carries the
last value, or the running count, from slice to slice. The sorted rows are written once,
so that every step sees the same slices after a lost executor.

Hot keys are looked up first by one aggregate over the key column. They are the largest
MAX_HOT_KEYS keys above HOT_FLOOR rows, so any other key has either at most HOT_FLOOR rows
or less than 1/MAX_HOT_KEYS of all rows. There are at most SLICES * MAX_HOT_KEYS slices
and MAX_HOT_KEYS cut keys more, whatever the size of the data, so the key table and the
carry tables are safe to broadcast. With no hot key the plan is the plain window.
"""

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.sources.scratch import save_scratch, shuffles_dropped

MAX_HOT_KEYS = 10_000
HOT_FLOOR = 1_000_000
SLICES = 4
SLICE = "_slice"
AUTO = "auto"


def hot_keys(df: DataFrame, key: str, floor: int | None = None) -> DataFrame | None:
    """Hot keys with the rows and slices of each; None without any."""
    floor = HOT_FLOOR if floor is None else floor
    with shuffles_dropped(df.sparkSession):
        largest = (
            df.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count("*").alias("n"))
            .where(F.col("n") > floor)
            .orderBy(F.col("n").desc(), key)
            .limit(MAX_HOT_KEYS)
            .collect()
        )
    if not largest:
        return None
    unit = max(floor, sum(r.n for r in largest) / MAX_HOT_KEYS) / SLICES
    rows = [(r[key], r.n, ceil(r.n / unit)) for r in largest]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{key}` {kind}, n bigint, parts int")


def find_hot(df: DataFrame, key: str, hot: DataFrame | str | None) -> DataFrame | None:
    """``hot`` as given, or looked up in ``df`` when it is ``"auto"``."""
    return hot_keys(df, key) if isinstance(hot, str) else hot


def split_hot(
    df: DataFrame, hot: DataFrame, key: str, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys with their slice number, which follows ``order``)."""
    small = F.broadcast(hot.select(key))
    usual = df.join(small, key, "left_anti").select(*df.columns)
    slices = hot.agg(F.sum("parts")).first()[0]
    ranged = df.join(small, key, "left_semi").repartitionByRange(slices, key, *order)
    return usual, save_scratch(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def previous_in(key: str, order: Sequence[str], value: str) -> Column:
    return F.lag(value).over(Window.partitionBy(key).orderBy(*order))


def with_previous_sliced(
    sliced: DataFrame, key: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Previous ``value`` per key over sliced rows: inside the slice, else the last of the one before."""
    inside = Window.partitionBy(key, SLICE).orderBy(*order)
    # The value is wrapped so that a NULL value is told from "no previous row".
    boxed = F.struct(F.col(value).alias("v"))
    ends = sliced.groupBy(key, SLICE).agg(F.max_by(boxed, F.struct(*order)).alias("end"))
    carry = ends.select(
        key,
        SLICE,
        F.lag("end").over(Window.partitionBy(key).orderBy(SLICE)).alias("_carry"),
    )
    return (
        sliced.withColumn("_inside", F.lag(boxed).over(inside))
        .join(F.broadcast(carry), [key, SLICE], "left")
        .withColumn(name, F.coalesce("_inside", "_carry")["v"])
        .select(*[c for c in sliced.columns if c != SLICE], name)
    )


def with_position_sliced(
    sliced: DataFrame, key: str, order: Sequence[str], name: str, descending: bool = False
) -> DataFrame:
    """1-based position per key over sliced rows: position in the slice plus the rows before it."""

    def direct(cols):
        return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]

    inside = Window.partitionBy(key, SLICE).orderBy(*direct(order))
    before = (
        Window.partitionBy(key)
        .orderBy(*direct([SLICE]))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = sliced.groupBy(key, SLICE).agg(F.count("*").alias("_n"))
    offsets = counts.select(key, SLICE, F.sum("_n").over(before).alias("_offset"))
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), [key, SLICE], "left")
        .withColumn(name, (F.coalesce("_offset", F.lit(0)) + F.col("_rn")).cast("int"))
        .select(*[c for c in sliced.columns if c != SLICE], name)
    )


def with_previous(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    name: str,
    hot: DataFrame | str | None = AUTO,
) -> DataFrame:
    """Add the previous ``value`` of the key. Pass ``hot=None`` when keys are known to be short."""
    hot = find_hot(df, key, hot)
    if hot is None:
        return df.withColumn(name, previous_in(key, order, value))
    usual, sliced = split_hot(df, hot, key, order)
    return usual.withColumn(name, previous_in(key, order, value)).unionByName(
        with_previous_sliced(sliced, key, order, value, name)
    )


def with_position(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    name: str,
    descending: bool = False,
    hot: DataFrame | str | None = AUTO,
) -> DataFrame:
    """Add the 1-based position of each row inside its key. ``hot`` as in `with_previous`."""
    ordered = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    plain = F.row_number().over(Window.partitionBy(key).orderBy(*ordered))
    hot = find_hot(df, key, hot)
    if hot is None:
        return df.withColumn(name, plain)
    usual, sliced = split_hot(df, hot, key, order)
    return usual.withColumn(name, plain).unionByName(
        with_position_sliced(sliced, key, order, name, descending)
    )


def left_lookup(df: DataFrame, table: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Left join to a table with unique keys, with NULL-key rows spread over all tasks.

    NULL keys never match, yet a plain left join sends them all to one task. They get a
    spread number from the row's own content instead; keyed rows all carry 0. The table's 0 is
    computed from its key: a literal would be folded into the join, whose rows would then be
    dealt by the key alone.
    Hot non-null keys are left to the adaptive skew join, which can split this side.
    """
    on = [on] if isinstance(on, str) else list(on)
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    hashed = [F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]]
    spread = F.when(no_key, F.pmod(F.xxhash64(*hashed), F.lit(4096)) + 1).otherwise(F.lit(0))
    zero = F.pmod(F.xxhash64(*on), F.lit(1))
    return (
        df.withColumn("_spread", spread)
        .join(table.withColumn("_spread", zero), [*on, "_spread"], "left")
        .drop("_spread")
    )
