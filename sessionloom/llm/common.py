"""Small helpers shared by the operators of this subpackage."""

import os
import shutil
import tempfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of characters other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no model may learn from; rows without id are among them."""
    rest = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5
    return F.coalesce(rest == 0, F.lit(True))


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Number of partitions that keeps each at ``rows_a_task`` rows, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_task))


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns beside ``row``, a struct of the whole row, so that no further column can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(c) for c in columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits that differ in any bit differ in about half of them afterwards."""
    # fixed values: the public multipliers of the splitmix64 finaliser
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application; Spark serves the archive to all executors."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="sessionloom-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/sessionloom", "zip", root, "sessionloom"))
        _shipped.add(app)
