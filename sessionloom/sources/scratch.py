"""Scratch tables in the cluster's shared checkpoint folder."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of what is planned while it is on

_local_folder: str | None = None
_scopes: list[list[str]] = []  # of the running jobs, the paths of their scratch tables


def scratch_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for local sessions."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="sessionloom-")
    return _local_folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that are planned and run inside are deleted as each of them ends.

    Otherwise they stay until the driver happens to collect its garbage, so a query of many steps
    holds the shuffles of all of them at once.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def save_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: fixed rows, short lineage, survives lost executors.

    What it shuffled is deleted, as only the written rows are read from then on.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`save_scratch` of what ``build()`` returns; the scratch tables made on the way are deleted."""
    with scratch_scope(spark) as made:
        saved = save_scratch(build(), name)
        kept = made.pop()  # the newest, which goes to the scope outside
    if _scopes:
        _scopes[-1].append(kept)
    return saved


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_scratch(saved: DataFrame) -> None:
    """Delete a table that `save_scratch` returned and that no other plan reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in saved.inputFiles()}:
        delete_folder(saved.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the scratch tables saved inside when the job ends, well or not.

    What the job returns must be written or collected inside. A scope inside another
    deletes its own tables only.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        # by identity: two scopes without tables are equal lists
        del _scopes[next(i for i, open_ in enumerate(_scopes) if open_ is paths)]
        for path in paths:
            delete_folder(spark, path)
