"""Scans. Schemas are explicit or all-string; nothing is inferred from the data."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def read_csv(
    spark: SparkSession,
    path: str,
    multiline: bool = True,
    schema: StructType | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """CSV with a header, double quotes doubled as escapes, every column a string.

    One gzip file is one task, so ``partitions`` spreads the rows after the scan.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "utf-8")
        .option("mode", "PERMISSIVE")
    )
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    rows = reader.csv(path)
    return rows if partitions is None else rows.repartition(partitions)


def read_raw_listings(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    return read_csv(spark, f"{folder}/*.csv.gz", True, partitions=partitions)


def read_raw_events(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    return read_csv(spark, f"{folder}/*.csv.gz", False, partitions=partitions)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of a few columns."""
    return spark.read.parquet(path).select(*columns)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan whose files may have different columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def scan_window(spark: SparkSession, path: str) -> DataFrame:
    """Events partitioned by ``dt``; filters on ``dt`` prune folders."""
    return spark.read.parquet(path)


# Field types of the interaction file header.
INTER_TYPES = {"token": StringType(), "float": DoubleType()}


def inter_schema(header: str) -> StructType:
    """``user_id:token<TAB>timestamp:float`` -> schema with the plain names."""
    fields = [field.split(":") for field in header.strip().split("\t")]
    return StructType([StructField(name, INTER_TYPES[kind]) for name, kind in fields])


def read_inter(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Interaction file: tab separated, typed header; only ``columns`` when given."""
    header = spark.read.text(path).where(F.col("value").contains(":token")).first()["value"]
    rows = (
        spark.read.schema(inter_schema(header))
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", True)
        .csv(path)
    )
    return rows if columns is None else rows.select(*columns)


def read_sessions_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Session table saved as CSV, timestamps parsed by the schema."""
    return read_csv(spark, path, multiline=False, schema=schema)


def read_runs(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """Exported benchmark runs; metrics as doubles, ``is_eval`` from the run name.

    A cell that is no number, or not a number by name, is NULL. Config columns beside the known ones and metrics other than ``test_*`` are dropped.
    """
    raw = spark.read.json(path) if path.endswith(".json") else read_csv(spark, path, False)
    names = ("run_name", "run_id", "group", "state", "model", "dataset")
    metrics = [c for c in raw.columns if c.startswith("test_")]
    rows = raw.select(
        *[c for c in names if c in raw.columns],
        F.col("run_name").startswith("Eval_").alias("is_eval"),
        *[F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None)).alias(c) for c in metrics],
    )
    return rows if group is None else rows.where(F.col("group") == group)
