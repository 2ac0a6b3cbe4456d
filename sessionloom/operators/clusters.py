"""Quality checks of the canonical listing clusters."""

from pyspark.sql import DataFrame, functions as F

from sessionloom.functions.hashing import draw_32, draw_unit
from sessionloom.functions.labels import cluster_band, reduction_percent

CANONICAL = "canonical_listing_id"
LISTING = "anonymized_listing_id"


def cluster_sizes(mapping: DataFrame) -> DataFrame:
    """Rows and distinct listings per cluster."""
    return mapping.groupBy(CANONICAL).agg(
        F.count(LISTING).alias("num_listings"),
        F.count_distinct(LISTING).alias("distinct_listings"),
    )


def cluster_stats(sizes: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min and max of the cluster size."""
    size = F.col("num_listings")
    return sizes.agg(
        F.count(size).alias("count"),
        F.avg(size).alias("mean"),
        F.stddev_samp(size).alias("stddev"),
        F.min(size).alias("min"),
        F.max(size).alias("max"),
    )


def cluster_bands(sizes: DataFrame) -> DataFrame:
    """Clusters per size band."""
    return sizes.groupBy(cluster_band(F.col("num_listings")).alias("cluster_size_range")).agg(
        F.count("*").alias("count")
    )


def largest_clusters(sizes: DataFrame, n: int = 10) -> DataFrame:
    return sizes.orderBy(F.col("num_listings").desc(), CANONICAL).limit(n)


def sparsity(mapping: DataFrame) -> DataFrame:
    """Distinct listings, distinct clusters and the percentage saved."""
    counts = mapping.agg(
        F.count_distinct(LISTING).alias("original_ids"),
        F.count_distinct(CANONICAL).alias("canonical_ids"),
    )
    return counts.withColumn(
        "reduction_pct", reduction_percent(F.col("original_ids"), F.col("canonical_ids"))
    )


def interactions_per_id(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mean events per listing id and per canonical id.

    Events are counted per listing before the join, so the join sees one row per listing.
    Listings without a cluster form one group, as a NULL key does.
    """
    per_listing = events.groupBy(LISTING).agg(F.count("*").alias("n"))
    per_cluster = (
        per_listing.join(mapping.select(LISTING, CANONICAL), LISTING, "left")
        .groupBy(CANONICAL)
        .agg(F.sum("n").alias("n"))
    )

    def mean(df, level):
        return df.agg(F.avg("n").alias("mean_interactions")).select(
            F.lit(level).alias("level"), "mean_interactions"
        )

    return mean(per_listing, "original").unionByName(mean(per_cluster, "canonical"))


def price_dispersion(listings: DataFrame, price: str = "price") -> DataFrame:
    """Price spread of every cluster with more than one listing."""
    spread = listings.groupBy(CANONICAL).agg(
        F.count("*").alias("num_listings"),
        F.stddev_samp(price).alias("price_stddev"),
        F.avg(price).alias("avg_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
    )
    return spread.where(F.col("num_listings") > 1).withColumn(
        "price_cv", F.try_divide("price_stddev", "avg_price")
    )


def dispersed_clusters(dispersion: DataFrame, above: float = 0.3, n: int = 10) -> DataFrame:
    """The ``n`` clusters with the highest coefficient of variation over a limit."""
    return (
        dispersion.where(F.col("price_cv") > above)
        .orderBy(F.col("price_cv").desc(), CANONICAL)
        .limit(n)
    )


def uniform_clusters(dispersion: DataFrame, below: float = 0.1, n: int = 10) -> DataFrame:
    """The ``n`` clusters with the lowest coefficient of variation under a limit."""
    return dispersion.where(F.col("price_cv") < below).orderBy("price_cv", CANONICAL).limit(n)


def sample_clusters(
    mapping: DataFrame,
    listings: DataFrame,
    n: int = 5,
    seed: int = 42,
    fraction: float = 0.1,
    min_size: int = 2,
    max_size: int = 10,
) -> DataFrame:
    """All listings of ``n`` clusters drawn from those of medium size.

    The draw is a seeded hash of the cluster id, so it is the same on every run. Only the
    ``n`` chosen ids are broadcast to fetch their listings.
    """
    chosen = (
        mapping.groupBy(CANONICAL)
        .agg(F.count("*").alias("cluster_size"))
        .where(F.col("cluster_size").between(min_size, max_size))
        .where(draw_unit(seed, F.col(CANONICAL)) < fraction)
        .orderBy(draw_32(seed, F.col(CANONICAL)), CANONICAL)
        .limit(n)
    )
    return listings.join(F.broadcast(chosen), CANONICAL)
