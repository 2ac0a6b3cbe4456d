"""Tables that are built once and read from then on, as long as nothing they are made of changes."""

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from sessionloom.sources.scratch import delete_folder


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def input_state(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of every file below ``path``, hidden ones left out."""
    place, system = _path(spark, path)
    files, found = system.listFiles(place, True), []
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith((".", "_")):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def cached_table(
    spark: SparkSession,
    folder: str,
    inputs: Sequence[str],
    parameters: dict,
    build: Callable[[], DataFrame],
) -> DataFrame:
    """The table in ``folder`` that was built from these inputs and parameters, else build and save it.

    A table's name is a hash of the parameters and of the inputs' files, so a changed file or
    parameter leads to a new table and never to an old one. It is written beside its place and
    renamed when it is whole: a build that breaks leaves nothing that could be read, and of
    two builds at once the second reads what the first has put there. Tables of other
    inputs stay until `drop_others`.
    """
    state = {"inputs": [input_state(spark, p) for p in inputs], "parameters": parameters}
    mark = hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()
    final = f"{folder.rstrip('/')}/{mark}"
    place, system = _path(spark, final)
    if not system.exists(place):
        draft = f"{folder.rstrip('/')}/.{mark}-{uuid.uuid4().hex}"
        try:
            build().write.parquet(draft)
            if system.exists(place) or not system.rename(_path(spark, draft)[0], place):
                if not system.exists(place):
                    raise OSError(f"{draft} cannot be renamed to {final}")
        finally:
            delete_folder(spark, draft)
    return spark.read.parquet(final)


def drop_others(spark: SparkSession, folder: str, keep: DataFrame) -> None:
    """Delete every table in ``folder`` but the one that ``keep`` reads."""
    used = {name.rsplit("/", 2)[-2] for name in keep.inputFiles()}
    place, system = _path(spark, folder)
    for status in system.listStatus(place):
        if status.getPath().getName() not in used:
            system.delete(status.getPath(), True)
