"""Keyed events -> recommender data set and browsing table."""

from pyspark.sql import DataFrame, SparkSession

from sessionloom.operators.sessions import build_sessions
from sessionloom.operators.stats import dataset_stats
from sessionloom.sources import readers, writers
from sessionloom.sources.cached import cached_table


def build_dataset(
    spark: SparkSession,
    events_path: str,
    listings_path: str | None,
    output: str,
    start: str = "2024-03-01",
    end: str = "2024-04-01",
    min_length: int = 2,
    max_length: int = 50,
    support: int = 5,
    name: str = "realestate",
) -> DataFrame:
    """Write ``<output>/sessions``, the interaction files and the browsing table.

    The sessions are written once; both exports and the returned totals read them back.
    """
    listings = readers.read_merged(spark, listings_path) if listings_path else None
    sessions = build_sessions(
        readers.scan_window(spark, events_path),
        start,
        end,
        listings,
        min_length=min_length,
        max_length=max_length,
        support=support,
    )
    writers.write_table(sessions, f"{output}/sessions")
    saved = spark.read.parquet(f"{output}/sessions")
    writers.write_inter(saved, f"{output}/{name}/{name}.inter")
    writers.write_browse_sessions(saved, f"{output}/sessions_for_api.parquet")
    return dataset_stats(saved)


def cached_sessions(
    spark: SparkSession, folder: str, events_path: str, listings_path: str | None = None, **limits
) -> DataFrame:
    """Sessions of `build_sessions` from ``folder``, built and saved there if its inputs or limits are new."""
    limits = {"start": "2024-03-01", "end": "2024-04-01", **limits}

    def build():
        listings = readers.read_merged(spark, listings_path) if listings_path else None
        return build_sessions(readers.scan_window(spark, events_path), listings=listings, **limits)

    return cached_table(spark, folder, [p for p in (events_path, listings_path) if p], limits, build)
