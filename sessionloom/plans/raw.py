"""Raw files -> clean listings, item mapping and keyed events."""

from pyspark.sql import DataFrame, SparkSession

from sessionloom.operators.events import (
    apply_identities,
    attach_items,
    clean_events,
    keyed_layout,
    numeric_keys,
    resolve_identities,
)
from sessionloom.operators.listings import (
    canonical_id,
    clean_listings,
    item_mapping,
    map_item_ids,
)
from sessionloom.operators.sessions import interaction_events
from sessionloom.sources import readers, writers
from sessionloom.sources.scratch import save_scratch, scratch_scope


def listing_tables(raw: DataFrame, precision: int = 7) -> tuple[DataFrame, DataFrame]:
    """(clean active listings with item numbers, mapping table) from raw listing rows."""
    return map_item_ids(canonical_id(clean_listings(raw), precision))


def prepare_listings(
    spark: SparkSession,
    raw_folder: str,
    listings_path: str,
    mapping_path: str,
    precision: int = 7,
    partitions: int | None = None,
) -> None:
    """Write both listing tables; the mapping is read back from the listings just written."""
    raw = readers.read_raw_listings(spark, raw_folder, partitions)
    with scratch_scope(spark):
        listings, _ = listing_tables(raw, precision)
        writers.write_table(listings, listings_path)
    writers.write_table(item_mapping(spark.read.parquet(listings_path)), mapping_path)


def keyed_events(raw: DataFrame, mapping: DataFrame, max_users: int = 7, policy: str = "min_id") -> DataFrame:
    """Raw event rows -> keyed events.

    The cleaned interaction events feed both the identity map and the event stream, so
    they are written once rather than parsed twice.
    """
    cleaned = interaction_events(clean_events(attach_items(raw, mapping)), "events")
    rows = save_scratch(cleaned, "clean-events")
    identities = resolve_identities(rows, max_users, policy)
    return keyed_layout(numeric_keys(apply_identities(rows, identities, mapping)))


def prepare_events(
    spark: SparkSession,
    raw_folder: str,
    mapping_path: str,
    events_path: str,
    partitions: int | None = None,
) -> None:
    """Write the keyed events partitioned by day."""
    raw = readers.read_raw_events(spark, raw_folder, partitions)
    mapping = readers.read_columns(
        spark, mapping_path, ["anonymized_listing_id", "listing_id_numeric"]
    )
    with scratch_scope(spark):
        writers.write_by_day(keyed_events(raw, mapping), events_path)
