"""Binary files in the shared folder, written and read by tasks."""

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

from sessionloom.sources.scratch import scratch_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the cluster's shared one."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def new_file(folder: str, ending: str):
    """``(path, stream)`` of a file of its own name, so that attempts of one task never meet."""
    path = f"{folder}/{uuid.uuid4().hex}.{ending}"
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place, compression=None) as stream:
        yield path, stream


@contextmanager
def write_file(path: str):
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place, compression=None) as stream:
        yield stream


@contextmanager
def open_file(path: str):
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as source:
        yield source
