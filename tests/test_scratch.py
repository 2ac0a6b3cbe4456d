"""Scratch tables and what they leave on disk."""

import os
import time

from pyspark.sql import functions as F

from sessionloom.sources import scratch
from tests.conftest import rows


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, so a query held those of all its steps."""
    before = shuffle_files(spark)
    saved = scratch.save_scratch(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and saved.count() == 7
    assert spark.conf.get(scratch.CLEANUP, None) != "true"


def test_only_the_last_table_of_several_is_kept(spark, tmp_path):
    def build():
        first = scratch.save_scratch(spark.range(5), "first")
        made.extend(first.inputFiles())
        return first.where("id > 2")

    made = []
    with scratch.scratch_scope(spark), scratch.scratch_scope(spark):
        saved = scratch.save_alone(spark, build, "second")
        assert rows(saved) == [(3,), (4,)]
        assert not any(f.startswith("part-") for path in made for f in _files(path))
        kept = saved.inputFiles()
    assert kept and not any(_files(path) for path in kept)


def _files(path):
    folder = path.removeprefix("file:").rsplit("/", 1)[0]
    return os.listdir(folder) if os.path.isdir(folder) else []
