"""Report tables: session statistics, cluster quality and benchmark results."""

from pyspark.sql import DataFrame

from sessionloom.operators import clusters, runs, stats
from sessionloom.sources.scratch import save_scratch
from sessionloom.sources.writers import write_csv


def session_report(
    sessions: DataFrame, min_length: int = 2, max_length: int = 50
) -> dict[str, DataFrame]:
    """Statistics, counts by user type and CDFs of sessions built with ``slim=False``."""
    numbers = save_scratch(
        stats.session_stats(sessions, session="user_id", item="item_id"), "session-stats"
    )
    inside = numbers.where(numbers["n_events"].between(min_length, max_length))
    anonymous, logged = inside.where("is_anonymous"), inside.where("not is_anonymous")
    return {
        "sessions": numbers,
        "description": stats.describe_sessions(numbers),
        "user_types": stats.user_type_counts(numbers, min_length, max_length),
        "cdf": stats.cdf(numbers, max_limit=max_length),
        "cdf_anonymous": stats.cdf(anonymous, max_limit=max_length),
        "cdf_logged": stats.cdf(logged, max_limit=max_length),
    }


def cluster_report(
    mapping: DataFrame, listings: DataFrame, events: DataFrame | None = None, samples: int = 3
) -> dict[str, DataFrame]:
    """Cluster sizes, sparsity, price spread and sampled clusters."""
    sizes = clusters.cluster_sizes(mapping)
    spread = clusters.price_dispersion(listings)
    tables = {
        "size_stats": clusters.cluster_stats(sizes),
        "size_bands": clusters.cluster_bands(sizes),
        "largest": clusters.largest_clusters(sizes),
        "sparsity": clusters.sparsity(mapping),
        "dispersed": clusters.dispersed_clusters(spread),
        "uniform": clusters.uniform_clusters(spread),
        "samples": clusters.sample_clusters(mapping, listings, samples),
    }
    if events is not None:
        tables["interactions"] = clusters.interactions_per_id(events, mapping)
    return tables


def benchmark_report(
    table: DataFrame, output: str | None = None, metric: str = "test_MRR@10"
) -> dict[str, DataFrame]:
    """Merged runs, rankings and summaries; written as CSV folders when ``output`` is given."""
    merged = runs.merge_runs(table)
    tables = {
        "runs_raw": table,
        "results": merged,
        "ranking": runs.rank_models(merged, metric),
        "ranking_by_topk": runs.rank_models_by_k(merged),
        "metric_means": runs.metric_means(merged),
        "metric_quartiles": runs.metric_quartiles(merged),
    }
    if output is not None:
        for name, df in tables.items():
            write_csv(df, f"{output}/{name}")
    return tables
