"""Session statistics: per session, distribution by user type, empirical CDF."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.operators.quantiles import exact_quantiles
from sessionloom.sources.scratch import save_scratch

PROBABILITIES = (0.25, 0.5, 0.75, 0.9, 0.99)
CDF_LEVELS = (0.25, 0.5, 0.75, 0.9)


def session_stats(
    df: DataFrame,
    session: str = "session_id",
    time: str = "event_ts",
    event: str = "event_id",
    item: str = "listing_id",
    user: str = "original_user_id",
) -> DataFrame:
    """Start, end, events, distinct items, anonymity and duration of each session.

    Events are counted by non-null event id; a session is anonymous when it never has a user.
    """
    return (
        df.groupBy(session)
        .agg(
            F.min(time).alias("first_event"),
            F.max(time).alias("last_event"),
            F.count(event).alias("n_events"),
            F.count_distinct(item).alias("n_items"),
            F.every(F.col(user).isNull()).alias("is_anonymous"),
        )
        .withColumn(
            "duration_seconds",
            (F.unix_micros("last_event") - F.unix_micros("first_event")) / F.lit(1e6),
        )
    )


def _user_type():
    return F.when(F.col("is_anonymous"), "anonymous").otherwise("logged")


def describe_sessions(
    stats: DataFrame, value: str = "n_events", probabilities: Sequence[float] = PROBABILITIES
) -> DataFrame:
    """count, mean, std, min, percentiles and max for all, anonymous and logged sessions.

    Sessions are first counted per value and the counts are written, so what is read again
    is one row per distinct value and not one per session. Deviations are summed from the
    mean, so large values with a small spread keep it.
    """
    tally = stats.where(F.col(value).isNotNull()).groupBy(_user_type().alias("kind"), F.col(value).alias("v")).agg(
        F.count("*").alias("n")
    )
    tally = save_scratch(tally, "tally")
    grouped = tally.withColumn("user_type", F.explode(F.array(F.lit("all"), "kind")))
    n, v = F.col("n"), F.col("v").cast("double")
    means = grouped.groupBy("user_type").agg(
        F.sum("n").alias("count"), (F.sum(n * v) / F.sum("n")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    apart = v - F.col("mean")
    spread = grouped.join(F.broadcast(means), "user_type").groupBy("user_type", "count", "mean", "min", "max").agg(
        F.sum(n * apart * apart).alias("squares")
    )
    places = exact_quantiles(grouped, ["user_type"], "v", probabilities, F.col("n"))
    return spread.join(places.select("user_type", "quantiles"), "user_type").select(
        "user_type",
        "count",
        "mean",
        F.sqrt(F.try_divide("squares", F.col("count") - 1)).alias("std"),
        "min",
        *[F.col("quantiles")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probabilities)],
        "max",
    )


def user_type_counts(
    stats: DataFrame, min_length: int = 2, max_length: int = 50, value: str = "n_events"
) -> DataFrame:
    """Sessions per user type, all and inside the length band."""
    inside = F.col(value).between(min_length, max_length)
    return stats.groupBy(_user_type().alias("user_type")).agg(
        F.count("*").alias("sessions"), F.count_if(inside).alias("sessions_in_band")
    )


def cdf(
    df: DataFrame,
    value: str = "n_events",
    max_limit: int = 50,
    by: str | None = None,
    levels: Sequence[float] = CDF_LEVELS,
) -> DataFrame:
    """Empirical CDF of an integer column up to ``max_limit``, per ``by`` when given.

    ``level`` is the highest reference level reached. The running sum goes over one row
    per value, at most ``max_limit`` + 1 non-negative values per group.
    """
    group = F.lit("all") if by is None else F.col(by)
    tally = (
        df.where(F.col(value) <= max_limit)
        .groupBy(group.alias("group"), F.col(value).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    upto = Window.partitionBy("group").orderBy("value")
    whole = Window.partitionBy("group")
    curve = tally.withColumn("cdf", F.sum("n").over(upto) / F.sum("n").over(whole))
    reached = [F.when(F.col("cdf") >= level, F.lit(level)) for level in levels]
    return curve.withColumn("level", F.greatest(*reached))


def dataset_stats(df: DataFrame, session: str = "user_id", item: str = "item_id") -> DataFrame:
    """Interactions, sessions and items in one row."""
    return df.agg(
        F.count("*").alias("interactions"),
        F.count_distinct(session).alias("sessions"),
        F.count_distinct(item).alias("items"),
    )
