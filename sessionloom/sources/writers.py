"""Sinks. Files are written by the tasks; nothing is collected first."""

from pyspark.sql import DataFrame, functions as F


def write_by_day(df: DataFrame, path: str, day: str = "dt") -> None:
    """Overwrite a table partitioned by day.

    The rebalance hint groups rows by day into few files and lets adaptive execution
    split a day that is much larger than the others.
    """
    df.hint("rebalance", F.col(day)).write.mode("overwrite").partitionBy(day).parquet(path)


def write_table(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    df.hint("rebalance").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def inter_rows(df: DataFrame) -> DataFrame:
    """Interaction file rows: string ids and float seconds under the typed header names."""
    return df.select(
        F.col("user_id").cast("string").alias("user_id:token"),
        F.col("item_id").cast("string").alias("item_id:token"),
        F.format_string("%.1f", F.col("timestamp").cast("double")).alias("timestamp:float"),
    )


def write_inter(df: DataFrame, path: str) -> None:
    """Tab separated interaction files in (user, timestamp) order across and inside files.

    Sorting happens on ids as text. The ties of one session and second keep the event
    order when the order columns are present.
    """
    ties = [c for c in ("event_ts", "event_id") if c in df.columns]
    order = [F.col("user_id").cast("string"), F.col("timestamp"), *ties]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inter_rows(placed).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def browse_rows(df: DataFrame) -> DataFrame:
    """Browsing table: the session id also stands as the user; time as a timestamp."""
    return df.select(
        F.col("user_id").alias("session_id"),
        F.col("item_id").cast("int").alias("item_id"),
        F.timestamp_seconds("timestamp").alias("timestamp"),
        "user_id",
    )


def write_browse_sessions(df: DataFrame, path: str) -> None:
    write_table(browse_rows(df), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, for report tables and cached sessions."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
