"""One query per operator, each over the whole test tables."""

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionloom.functions.geo import with_geodesic_km, with_geohash
from sessionloom.operators import (
    browse,
    clusters,
    evaluation,
    events,
    keys,
    listings,
    recommendations as recs,
    runs,
    scorers,
    sessions,
    stats,
    tuning,
)
from sessionloom.plans.benchmark import benchmark_table
from sessionloom.sources.scratch import save_alone, save_scratch, scratch_folder
from sessionloom.sources.writers import browse_rows, inter_rows, write_by_day
from workload import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that make every filter bite on the test tables.
START, END = "1996-01-01", "2000-12-31"
BUSINESS = "O"
TYPES = ("AF", "AO", "NF", "NO", "RF")
MIN_LENGTH, MAX_LENGTH = 2, 6  # of the queries about these limits; others use the library's
FLAGSHIP_SUPPORT = 5
SUPPORT = 20
PRECISION = 2
NEIGHBOURS = 100
REC_K = 10
SEED = 42


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(f"`{c}`", places) for c in columns})


# ---- shared inputs -------------------------------------------------------------------


def interactions(spark, d):
    """Order lines as interactions."""
    rows = tables.lines_as_events(spark, d)
    return sessions.to_interactions(rows).select("user_id", "item_id", "timestamp", *sessions.ORDER)


def whole_sessions(spark, d):
    """Sessions with the library's own limits of length and support."""
    return sessions.sessions_from(interactions(spark, d))


def slim_sessions(spark, d):
    """The same without the time in seconds, which no scorer or analysis reads."""
    return sessions.sessions_from(interactions(spark, d).drop("timestamp"))


def split_sessions(spark, d):
    """The split session table, written once as a pipeline would."""
    split = evaluation.split_leave_one_out(slim_sessions(spark, d), hot=None)
    return save_scratch(split, "split")


def browse_table(spark, d):
    return whole_sessions(spark, d).select(
        F.col("user_id").alias("session_id"), "item_id", "timestamp", "user_id", "event_id"
    )


def canonical_parts(spark, d):
    """Parts as listings with canonical ids."""
    rows = tables.item_listings(spark, d).select(
        F.col("listing_id_numeric").alias("anonymized_listing_id"),
        F.col("lat").alias("lat_region"),
        F.col("lon").alias("lon_region"),
        F.lit(None).cast("string").alias("zip_code"),
        "usable_areas",
        "bedrooms",
        "unit_type",
        "price",
    )
    return listings.canonical_id(rows, PRECISION)


def clean_raw_events(spark, d):
    return events.clean_events(tables.raw_events(spark, d))


def canonical_versions(spark, d):
    return listings.canonical_id(listings.clean_listings(tables.raw_listings(spark, d)), PRECISION)


def part_mapping(spark, d):
    """Listing map of the parts that have a listing."""
    return tables.known_listings(spark, d).select(
        F.concat(F.lit("L"), "listing_id_numeric").alias("anonymized_listing_id"),
        "listing_id_numeric",
    )


def session_numbers(spark, d):
    """Per-session statistics over the order lines with their customers."""
    rows = tables.keyed_events(spark, d).withColumn("original_user_id", F.col("user_id"))
    return stats.session_stats(rows)


def knn(train):
    return scorers.ItemKNN(train, NEIGHBOURS)


def markov(train):
    return scorers.Markov(train, hot=None)


def recommended(spark, d, rows):
    """Top 10 neighbours of every session, fitted on all sessions."""
    return recs.recommend(rows, knn(rows), tables.known_listings(spark, d), REC_K)


def saved_recommendations(spark, d):
    """Session table and recommendations, both written once for the analyses; nothing else stays."""
    rows = slim_sessions(spark, d)
    return rows, save_alone(spark, lambda: recommended(spark, d, rows), "recommendations")


# ---- listings ------------------------------------------------------------------------


@query
def clean_listings(spark, d):
    return listings.clean_listings(tables.raw_listings(spark, d)).select(
        "source_order",
        "version",
        "price",
        "usable_areas",
        "total_areas",
        "bedrooms",
        "bathrooms",
        F.col("dt").cast("string").alias("dt"),
        F.unix_seconds("created_at").alias("created_at"),
        F.unix_seconds("updated_at").alias("updated_at"),
    )


@query
def geohash_7(spark, d):
    rows = tables.item_listings(spark, d)
    return with_geohash(rows, "geohash", F.col("lat"), F.col("lon"), 7).select(
        "listing_id_numeric", "geohash"
    )


@query
def geodesic_distance(spark, d):
    """Distance of each part to the supplier's home point of its order lines."""
    lines = tables.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = lines.join(tables.item_listings(spark, d), F.col("l_partkey") == F.col("listing_id_numeric"))
    home = (F.col("l_suppkey") * 7 % 80 - 40).cast("double"), (F.col("l_suppkey") * 13 % 360 - 180).cast("double")
    located = with_geodesic_km(rows, "km", F.col("lat"), F.col("lon"), *home)
    return rounded(located.select("l_partkey", "l_suppkey", "km"), "km")


@query
def canonical_id(spark, d):
    return canonical_versions(spark, d).select("source_order", "version", "canonical_listing_id")


@query
def latest_version(spark, d):
    rows = tables.listing_versions(spark, d)
    return listings.latest_active(rows, ties=("l_orderkey", "version")).select(
        "anonymized_listing_id", "l_orderkey", "version", "price"
    )


@query
def item_id_mapping(spark, d):
    _, mapping = listings.map_item_ids(
        canonical_versions(spark, d), ties=("source_order", "version")
    )
    return mapping


@query
def item_lookup(spark, d):
    """One listing per item number, from the numbered listings."""
    numbered, _ = listings.map_item_ids(canonical_versions(spark, d), ties=("source_order", "version"))
    return listings.item_lookup(numbered).select("listing_id_numeric", "anonymized_listing_id", "lat", "lon")


# ---- events --------------------------------------------------------------------------


@query
def clean_events(spark, d):
    return clean_raw_events(spark, d).select(
        "anonymized_session_id",
        "event_id",
        "anonymized_user_id",
        "anonymized_anonymous_id",
        F.unix_millis("event_ts").alias("event_ms"),
    )


@query
def attach_items(spark, d):
    return events.attach_items(clean_raw_events(spark, d), part_mapping(spark, d)).select(
        "anonymized_session_id", "event_id", "anonymized_listing_id", "listing_id_numeric"
    )


@query
def resolve_identities(spark, d):
    return events.resolve_identities(clean_raw_events(spark, d))


@query
def resolve_identities_mode(spark, d):
    return events.resolve_identities(clean_raw_events(spark, d), policy="most_frequent")


@query
def identity_counts(spark, d):
    counted = events.identity_counts(clean_raw_events(spark, d))
    pairs = F.transform(
        F.array_sort(F.map_entries("user_counts")), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return counted.select("anonymous_id", F.array_join(pairs, ",").alias("user_counts"))


def _resolved(spark, d):
    rows = clean_raw_events(spark, d)
    return events.apply_identities(rows, events.resolve_identities(rows), part_mapping(spark, d))


@query
def apply_identities(spark, d):
    return _resolved(spark, d).select("anonymized_session_id", "event_id", "listing_id", "user_id", "anonymous_id")


@query
def numeric_keys(spark, d):
    # written once, as the ids are read for numbering and again for the keys
    ids = ("anonymized_session_id", "event_id", "user_id", "anonymous_id")
    return events.numeric_keys(save_scratch(_resolved(spark, d).select(*ids), "resolved")).select(
        "anonymized_session_id",
        "event_id",
        "user_logged_numeric_id",
        "anonymous_numeric_id",
        "session_numeric_id",
        "unique_user_id",
    )


@query
def dense_key(spark, d):
    rows = tables.table(spark, d, "lineitem")
    return keys.dense_key(rows, ["l_partkey", "l_returnflag"], "key")


# ---- sessions ------------------------------------------------------------------------


def _event_columns(df):
    return df.select("session_id", "listing_id", "event_id", "event_type", F.col("dt").cast("string").alias("dt"))


@query
def interaction_events(spark, d):
    return _event_columns(sessions.interaction_events(tables.keyed_events(spark, d), TYPES))


@query
def load_window(spark, d):
    return _event_columns(sessions.in_window(tables.keyed_events(spark, d), START, END, BUSINESS))


@query
def window_of_days(spark, d):
    """Keyed events written by day, then only the window's folders read."""
    path = f"{scratch_folder(spark)}/keyed-events-{uuid.uuid4().hex}"
    write_by_day(tables.keyed_events(spark, d), path)
    return _event_columns(sessions.load_window(spark, path, START, END, BUSINESS))


@query
def known_items(spark, d):
    places = tables.known_listings(spark, d)
    return _event_columns(
        sessions.known_items(tables.keyed_events(spark, d), places, F.col("state") != "NATION_3")
    )


@query
def dedup_consecutive(spark, d):
    rows = tables.lines_as_events(spark, d).withColumn("shop", F.col("supplier_id") % 10)
    return sessions.prepare_sessions(rows, slim=True, item="shop").select(
        "user_id", "item_id", "timestamp", "event_id"
    )


@query
def session_length_filter(spark, d):
    return sessions.limit_sessions(interactions(spark, d), MIN_LENGTH, MAX_LENGTH).select(
        "user_id", "item_id", "timestamp", "event_id"
    )


@query
def rare_item_filter(spark, d):
    return sessions.min_support(interactions(spark, d), SUPPORT).select(
        "user_id", "item_id", "timestamp", "event_id"
    )


@query
def stable_core(spark, d):
    """Sessions and items peeled to the fixed point of both limits."""
    return sessions.stable_core(interactions(spark, d), MIN_LENGTH, SUPPORT).select(
        "user_id", "item_id", "timestamp", "event_id"
    )


@query
def build_sessions(spark, d):
    """Flagship: window, business, known items, event types, repeats, lengths, support."""
    return sessions.build_sessions(
        tables.keyed_events(spark, d),
        START,
        END,
        tables.known_listings(spark, d),
        business=BUSINESS,
        types=TYPES,
        min_length=MIN_LENGTH,
        max_length=MAX_LENGTH,
        support=FLAGSHIP_SUPPORT,
    ).select("user_id", "item_id", "timestamp")


@query
def session_funnel(spark, d):
    report = sessions.session_funnel(
        tables.keyed_events(spark, d),
        START,
        END,
        tables.known_listings(spark, d),
        business=BUSINESS,
        types=TYPES,
        min_length=MIN_LENGTH,
        max_length=MAX_LENGTH,
        support=FLAGSHIP_SUPPORT,
    )
    return rounded(report, "rows_share", "sessions_share", "items_share")


@query
def export_inter_rows(spark, d):
    rows = inter_rows(whole_sessions(spark, d))
    return rows.toDF("user_id", "item_id", "timestamp")


@query
def browse_sessions(spark, d):
    rows = browse_rows(whole_sessions(spark, d))
    return rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def dataset_stats(spark, d):
    return stats.dataset_stats(whole_sessions(spark, d))


# ---- statistics ----------------------------------------------------------------------


@query
def session_stats(spark, d):
    rows = session_numbers(spark, d)
    return rows.withColumns(
        {c: F.unix_seconds(c) for c in ("first_event", "last_event")}
    )


@query
def session_percentiles(spark, d):
    described = stats.describe_sessions(session_numbers(spark, d))
    return rounded(described, "mean", "std", "p25", "p50", "p75", "p90", "p99")


@query
def duration_percentiles(spark, d):
    described = stats.describe_sessions(session_numbers(spark, d), "duration_seconds")
    return rounded(described, "mean", "std", "p25", "p50", "p75", "p90", "p99", places=3)


@query
def user_type_counts(spark, d):
    return stats.user_type_counts(session_numbers(spark, d), MIN_LENGTH, MAX_LENGTH)


@query
def session_cdf(spark, d):
    numbers = session_numbers(spark, d).withColumn(
        "user_type", F.when(F.col("is_anonymous"), "anonymous").otherwise("logged")
    )
    return rounded(stats.cdf(numbers, max_limit=8, by="user_type"), "cdf")


# ---- clusters ------------------------------------------------------------------------


@query
def cluster_bands(spark, d):
    return clusters.cluster_bands(clusters.cluster_sizes(canonical_parts(spark, d)))


@query
def cluster_stats(spark, d):
    return rounded(
        clusters.cluster_stats(clusters.cluster_sizes(canonical_parts(spark, d))), "mean", "stddev"
    )


@query
def cluster_top(spark, d):
    return clusters.largest_clusters(clusters.cluster_sizes(canonical_parts(spark, d)))


@query
def sparsity(spark, d):
    return rounded(clusters.sparsity(canonical_parts(spark, d)), "reduction_pct")


@query
def interactions_per_id(spark, d):
    seen = tables.lines_as_events(spark, d).select(F.col("listing_id").alias("anonymized_listing_id"))
    return rounded(
        clusters.interactions_per_id(seen, canonical_parts(spark, d)), "mean_interactions"
    )


_SPREAD = ("price_stddev", "avg_price", "min_price", "max_price", "price_cv")


@query
def cluster_cv_high(spark, d):
    spread = clusters.price_dispersion(canonical_parts(spark, d))
    return rounded(clusters.dispersed_clusters(spread), *_SPREAD)


@query
def cluster_cv_low(spark, d):
    spread = clusters.price_dispersion(canonical_parts(spark, d))
    return rounded(clusters.uniform_clusters(spread), *_SPREAD)


@query
def cluster_sample(spark, d):
    parts = canonical_parts(spark, d)
    return clusters.sample_clusters(parts, parts, n=5, seed=SEED).select(
        "canonical_listing_id", "cluster_size", "anonymized_listing_id", F.round("price", 6).alias("price")
    )


# ---- browsing ------------------------------------------------------------------------


@query
def session_list(spark, d):
    return browse.list_sessions(
        browse_table(spark, d), tables.item_listings(spark, d), sort_by="event_count", page=2
    )


@query
def session_detail(spark, d):
    return rounded(
        browse.session_detail(browse_table(spark, d), tables.item_listings(spark, d), hot=None), "price"
    )


@query
def session_center(spark, d):
    return rounded(
        browse.session_center(browse_table(spark, d), tables.item_listings(spark, d)),
        "center_lat",
        "center_lon",
    )


@query
def available_items(spark, d):
    return browse.available_items(tables.item_listings(spark, d))


# ---- scoring and evaluation ----------------------------------------------------------


@query
def split_loo(spark, d):
    split = evaluation.split_leave_one_out(interactions(spark, d))
    return split.select("user_id", "item_id", "event_id", "timestamp", "part")


@query
def history_cut(spark, d):
    return evaluation.history_cut(interactions(spark, d), 3).select(
        "user_id", "item_id", "event_id", "timestamp"
    )


@query
def negatives_100(spark, d):
    split = split_sessions(spark, d)
    _, history, targets = evaluation.evaluation_parts(split)
    return evaluation.negatives(targets, history, split, 100, SEED)


def _top(build, spark, d, k=20):
    train, history, _ = evaluation.evaluation_parts(split_sessions(spark, d))
    return rounded(build(train).top(history, k).select("user_id", "item_id", "score", "rank"), "score")


@query
def score_pop(spark, d):
    return _top(scorers.Popularity, spark, d)


@query
def score_random(spark, d):
    return _top(scorers.Random, spark, d)


@query
def item_similarity(spark, d):
    train = split_sessions(spark, d).where(F.col("part") == "train")
    return rounded(
        scorers.item_similarity(train, NEIGHBOURS, 10.0).select(
            "item", "neighbour", "rank", "sim"
        ),
        "sim",
    )


@query
def score_itemknn(spark, d):
    return _top(knn, spark, d)


@query
def score_markov1(spark, d):
    return _top(markov, spark, d)


@query
def score_fossil_counts(spark, d):
    return _top(
        partial(scorers.SimilarityMarkov, k=NEIGHBOURS, order_len=2, hot=None), spark, d
    )


@query
def score_als(spark, d):
    """Rank of each session's test item among 100 sampled ones by matrix factorisation with its default parameters."""
    split = split_sessions(spark, d)
    train, history, targets = evaluation.evaluation_parts(split)
    return evaluation.ranks_uniform(scorers.Factorization(train), history, targets, split, 100, SEED, 101)


def _ranks(build, spark, d):
    train, history, targets = evaluation.evaluation_parts(split_sessions(spark, d))
    return evaluation.ranks_full(build(train), history, targets)


@query
def eval_full(spark, d):
    """Rank of every test item among all unseen items."""
    return _ranks(knn, spark, d)


@query
def eval_uni100(spark, d):
    """Rank of every test item among 100 sampled items, by popularity."""
    split = split_sessions(spark, d)
    train, history, targets = evaluation.evaluation_parts(split)
    return evaluation.ranks_uniform(scorers.Popularity(train), history, targets, split, 100, SEED)


@query
def metrics_at_k(spark, d):
    """Metrics with several positives: line numbers as ranks, orders as sessions."""
    ranks = tables.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("user_id"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 23 + 1).alias("rank"),
    )
    return rounded(evaluation.metrics_at_k(ranks), "value")


def _measured(build, spark, d, model, **protocol):
    return rounded(evaluation.evaluate(build, split_sessions(spark, d), model, **protocol), "value")


@query
def eval_pop(spark, d):
    return _measured(scorers.Popularity, spark, d, "Pop")


@query
def eval_itemknn(spark, d):
    return _measured(knn, spark, d, "ItemKNN", mode="sampled")


MODELS = {"Pop": scorers.Popularity, "Random": scorers.Random, "ItemKNN": knn, "Markov": markov}


@query
def benchmark_models(spark, d):
    split = evaluation.split_leave_one_out(whole_sessions(spark, d), hot=None)
    return rounded(benchmark_table(MODELS, split), "value")


@query
def tune_itemknn(spark, d):
    """Whole grid on the validation items."""
    return rounded(
        tuning.tune_item_knn(split_sessions(spark, d)), "mrr"
    )


# ---- recommendations -----------------------------------------------------------------


@query
def recommend_topk(spark, d):
    return rounded(recommended(spark, d, slim_sessions(spark, d)), "score")


@query
def recommend_refill(spark, d):
    """Top 10 of the items with a listing."""
    rows = slim_sessions(spark, d)
    return rounded(recs.recommend(rows, knn(rows), tables.known_listings(spark, d), REC_K, refill=True), "score")


@query
def rec_distance(spark, d):
    rows, best = saved_recommendations(spark, d)
    found = recs.recommendation_distances(rows, best, tables.item_listings(spark, d))
    return rounded(found, "score", "avg_distance_km", "min_distance_km")


@query
def feature_compare(spark, d):
    rows, best = saved_recommendations(spark, d)
    places = tables.item_listings(spark, d)
    pairs = (
        recs.recommendation_distances(rows, best, places)
        .where(F.col("closest_item").isNotNull())
        .select("user_id", "rank", F.col("closest_item").alias("item1"), F.col("item_id").alias("item2"))
    )
    return rounded(recs.compare_features(pairs, places), "value1", "value2", "diff", "pct_diff")


@query
def session_vs_recs(spark, d):
    rows, best = saved_recommendations(spark, d)
    table = recs.session_vs_recommendations(rows, best, tables.item_listings(spark, d))
    return rounded(table, "session_mean", "session_std", "rec_mean", "rec_std", "diff_pct")


@query
def top_city(spark, d):
    rows, best = saved_recommendations(spark, d)
    return recs.top_cities(rows, best, tables.item_listings(spark, d))


@query
def nearest_links(spark, d):
    rows, best = saved_recommendations(spark, d)
    return rounded(recs.nearest_links(rows, best, tables.item_listings(spark, d), top=5), "distance")


@query
def nearest_links_planar(spark, d):
    rows, best = saved_recommendations(spark, d)
    links = recs.nearest_links(rows, best, tables.item_listings(spark, d), k=1, top=None, metric="planar")
    return rounded(links, "distance")


@query
def map_points(spark, d):
    rows, best = saved_recommendations(spark, d)
    points = recs.map_points(rows, best, tables.item_listings(spark, d), hot=None)
    return rounded(points, "lat", "lon", "price", "score", "size", "min_distance_km", "center_lat", "center_lon")


# ---- benchmark runs ------------------------------------------------------------------


@query
def merge_runs(spark, d):
    return runs.merge_runs(tables.benchmark_runs(spark, d))


@query
def rank_models(spark, d):
    return runs.rank_models(runs.merge_runs(tables.benchmark_runs(spark, d)))


@query
def rank_models_by_k(spark, d):
    merged = runs.merge_runs(tables.benchmark_runs(spark, d))
    return rounded(runs.rank_models_by_k(merged), "value", places=12)


@query
def metric_means(spark, d):
    merged = runs.merge_runs(tables.benchmark_runs(spark, d))
    return rounded(runs.metric_means(merged), "test_mrr@10", "test_hit@5", "test_hit@10", places=12)


@query
def metric_quartiles_merged(spark, d):
    table = runs.metric_quartiles(runs.merge_runs(tables.benchmark_runs(spark, d)))
    return rounded(table, "p0", "p25", "p50", "p75", "p100")


@query
def metric_quartiles(spark, d):
    table = runs.metric_quartiles(tables.benchmark_runs(spark, d))
    return rounded(table, "p0", "p25", "p50", "p75", "p100")
