"""Raw listings -> clean, canonical, deduplicated listings with item numbers."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.functions import clean, geo
from sessionloom.operators.keys import dense_key
from sessionloom.sources.scratch import save_scratch

DOUBLE_COLUMNS = ("price", "usable_areas", "total_areas", "ceiling_height")
INTEGER_COLUMNS = ("bathrooms", "bedrooms", "suites", "parking_spaces", "floors")
TIMESTAMP_COLUMNS = ("created_at", "updated_at")

# What a missing fingerprint part becomes.
UNKNOWN_GEO = "UNKNOWN_GEO"
UNKNOWN_AREA = "-1"
UNKNOWN_BEDROOMS = "0"
UNKNOWN_UNIT_TYPE = "UNKNOWN"


def clean_listings(df: DataFrame) -> DataFrame:
    """Typed listing columns; bad values become NULL, absent columns are skipped."""
    typed = {c: clean.digits_to_double(F.col(c)) for c in clean.present(df.columns, DOUBLE_COLUMNS)}
    typed |= {c: clean.whole_number(F.col(c)) for c in clean.present(df.columns, INTEGER_COLUMNS)}
    typed |= {c: F.col(c).try_cast("date") for c in clean.present(df.columns, ("dt",))}
    typed |= {
        c: F.col(c).try_cast("timestamp") for c in clean.present(df.columns, TIMESTAMP_COLUMNS)
    }
    return df.withColumns(typed)


def with_fingerprint(df: DataFrame, precision: int = 7, area_step: int = 10) -> DataFrame:
    """Add ``fingerprint``: place, area bucket, bedrooms and unit type in one string."""
    placed = df.withColumns(
        {"_lat": F.col("lat_region").try_cast("double"), "_lon": F.col("lon_region").try_cast("double")}
    )
    hashed = geo.with_geohash(placed, "_geohash", F.col("_lat"), F.col("_lon"), precision)
    bucket = F.try_divide("usable_areas", F.lit(area_step)).try_cast("int") * area_step
    parts = F.concat_ws(
        "|",
        F.coalesce("_geohash", "zip_code", F.lit(UNKNOWN_GEO)),
        F.coalesce(bucket.cast("string"), F.lit(UNKNOWN_AREA)),
        F.coalesce(F.col("bedrooms").cast("string"), F.lit(UNKNOWN_BEDROOMS)),
        F.coalesce("unit_type", F.lit(UNKNOWN_UNIT_TYPE)),
    )
    return hashed.withColumn("fingerprint", parts).drop("_lat", "_lon", "_geohash")


def canonical_id(df: DataFrame, precision: int = 7, area_step: int = 10) -> DataFrame:
    """Add ``canonical_listing_id``: one id for listings of the same physical property."""
    return (
        with_fingerprint(df, precision, area_step)
        .withColumn("canonical_listing_id", F.md5("fingerprint"))
        .drop("fingerprint")
    )


def latest_active(
    df: DataFrame,
    key: str = "anonymized_listing_id",
    version: str = "updated_at",
    ties: Sequence[str] | None = None,
) -> DataFrame:
    """Newest ACTIVE version per listing.

    ``ties`` orders versions of equal time (largest first) and should make the order
    total; by default every other column takes part. Spark keeps one row per listing and
    task before the shuffle, so a listing with very many versions is no hot spot.
    """
    if ties is None:
        ties = [c for c in sorted(df.columns) if c not in (key, version)]
    newest = Window.partitionBy(key).orderBy(
        F.col(version).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]
    )
    return (
        df.where(F.col("status") == "ACTIVE")
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def number_items(latest: DataFrame) -> DataFrame:
    """Add ``listing_id_numeric``: the rank of the canonical id, shared by its listings."""
    numbers = dense_key(latest, "canonical_listing_id", "listing_id_numeric").withColumn(
        "listing_id_numeric", F.col("listing_id_numeric").cast("int")
    )
    return latest.join(numbers, "canonical_listing_id").select(
        *latest.columns, "listing_id_numeric"
    )


def item_mapping(listings: DataFrame) -> DataFrame:
    """Listing id -> canonical id -> item number, one row per listing."""
    return listings.select(
        "canonical_listing_id", "anonymized_listing_id", "listing_id_numeric"
    )


def map_item_ids(
    df: DataFrame, version: str = "updated_at", ties: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(latest active listings with item numbers, mapping table).

    The latest versions are written once: numbering and both results read them.
    """
    latest = save_scratch(latest_active(df, version=version, ties=ties), "latest")
    listings = number_items(latest)
    return listings, item_mapping(listings)


def item_lookup(
    listings: DataFrame, item: str = "listing_id_numeric", version: str = "updated_at"
) -> DataFrame:
    """One row per item number with double coordinates ``lat`` and ``lon``.

    Several listings share an item; the latest one stands for it, then the smallest id.
    """
    first = Window.partitionBy(item).orderBy(
        F.col(version).desc_nulls_last(), F.col("anonymized_listing_id").asc()
    )
    return (
        listings.withColumns(
            {
                "lat": F.col("lat_region").try_cast("double"),
                "lon": F.col("lon_region").try_cast("double"),
                "_rn": F.row_number().over(first),
            }
        )
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )
