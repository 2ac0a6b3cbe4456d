"""Raw events -> cleaned events with resolved users and dense keys."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sessionloom.functions import clean
from sessionloom.operators.keys import dense_keys
from sessionloom.operators.skew import left_lookup
from sessionloom.sources.scratch import save_scratch

ID_COLUMNS = ("anonymized_user_id", "anonymized_anonymous_id", "anonymized_listing_id")
UNUSED_COLUMNS = ("usage_types", "is_bot", "event_date", "month")
LEADING_COLUMNS = (
    "listing_id",
    "unique_user_id",
    "session_id",
    "user_id",
    "anonymous_id",
    "event_type",
    "dt",
)


def clean_events(df: DataFrame) -> DataFrame:
    """Blank ids to NULL; ``event_ts`` from the collector's epoch milliseconds."""
    typed = {c: clean.blank_to_null(F.col(c)) for c in clean.present(df.columns, ID_COLUMNS)}
    if "collector_timestamp" in df.columns:
        typed["event_ts"] = clean.epoch_ms_to_timestamp(F.col("collector_timestamp"))
    return df.withColumns(typed)


def attach_items(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events of mapped listings, with their item number."""
    numbers = mapping.select("anonymized_listing_id", "listing_id_numeric")
    return events.join(numbers, "anonymized_listing_id")


def _pairs(events: DataFrame, anonymous: str, user: str) -> DataFrame:
    return events.groupBy(anonymous, user).agg(F.count("*").alias("n"))


def _chosen(policy: str, user: str) -> Column:
    if policy == "min_id":
        return F.min(user)
    if policy == "most_frequent":
        ordered = F.struct((-F.col("n")).alias("rarity"), F.col(user))
        return F.min(F.when(F.col(user).isNotNull(), ordered))[user]
    raise ValueError(f"unknown policy {policy!r}: use min_id or most_frequent")


def resolve_identities(
    events: DataFrame,
    max_users: int = 7,
    policy: str = "min_id",
    anonymous: str = "anonymized_anonymous_id",
    user: str = "anonymized_user_id",
) -> DataFrame:
    """One user id per anonymous id, or none where more than ``max_users`` shared it.

    ``min_id`` takes the smallest user id, ``most_frequent`` the one with most events
    (then the smallest). Counting (anonymous, user) pairs first keeps every group a
    number, never a list, so a bot's anonymous id is no hot spot.
    """
    return (
        _pairs(events, anonymous, user)
        .groupBy(anonymous)
        .agg(F.count(user).alias("users"), _chosen(policy, user).alias("id"))
        .where(F.col("users") <= max_users)
        .select(F.col(anonymous).alias("anonymous_id"), "id")
    )


def identity_counts(
    events: DataFrame,
    max_users: int = 7,
    anonymous: str = "anonymized_anonymous_id",
    user: str = "anonymized_user_id",
) -> DataFrame:
    """Events per user id as a map, for anonymous ids with at most ``max_users`` users."""
    pairs = _pairs(events, anonymous, user)
    small = pairs.groupBy(anonymous).agg(F.count(user).alias("users")).where(
        F.col("users") <= max_users
    )
    entry = F.when(F.col(user).isNotNull(), F.struct(F.col(user).alias("key"), F.col("n").alias("value")))
    return (
        pairs.join(small.select(F.col(anonymous).alias("_a")), F.col(anonymous).eqNullSafe(F.col("_a")), "left_semi")
        .groupBy(F.col(anonymous).alias("anonymous_id"))
        .agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("user_counts"))
    )


def apply_identities(
    events: DataFrame, identities: DataFrame, listings: DataFrame | None = None
) -> DataFrame:
    """Fill missing user ids from the identity map; keep events of known listings.

    Only events without a user id look up the map, so the many that have one, and those
    without an anonymous id, are spread evenly.
    """
    renamed = events.withColumnsRenamed(
        {
            "anonymized_user_id": "user_id",
            "anonymized_anonymous_id": "anonymous_id",
            "anonymized_listing_id": "listing_id",
        }
    ).drop(*UNUSED_COLUMNS)
    asked = renamed.withColumn("_asked", F.when(F.col("user_id").isNull(), F.col("anonymous_id")))
    ids = identities.where(F.col("anonymous_id").isNotNull()).select(
        F.col("anonymous_id").alias("_asked"), "id"
    )
    filled = (
        left_lookup(asked, ids, "_asked")
        .withColumn("user_id", F.coalesce("user_id", "id"))
        .select(*renamed.columns)
    )
    if listings is None:
        return filled
    known = listings.select(F.col("anonymized_listing_id").alias("listing_id"))
    return filled.join(known, "listing_id", "left_semi").select(*filled.columns)


def numeric_keys(
    events: DataFrame,
    user: str = "user_id",
    anonymous: str = "anonymous_id",
    session: str = "anonymized_session_id",
) -> DataFrame:
    """Add dense ``U_``/``A_``/``S_`` keys and ``unique_user_id`` (user, else anonymous).

    The three keys are numbered by one sort and put together on the distinct id triples,
    about one per session, so the wide events are shuffled once and not once per key. The
    triples are written once, because the numbering and the lookups read them. The ids must
    be of one type.
    """
    ids = [user, anonymous, session]
    triples = save_scratch(events.select(*ids).distinct(), "ids")
    numbers = dense_keys(triples, ids, "_n")
    keyed = triples
    for source, prefix, name in (
        (user, "U_", "user_logged_numeric_id"),
        (anonymous, "A_", "anonymous_numeric_id"),
        (session, "S_", "session_numeric_id"),
    ):
        named = numbers[source].select(source, F.concat(F.lit(prefix), F.col("_n")).alias(name))
        keyed = left_lookup(keyed, named, source)
    right = keyed.withColumnsRenamed({c: f"_{c}" for c in ids})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
    return (
        events.join(right, same)
        .drop(*[f"_{c}" for c in ids])
        .withColumn(
            "unique_user_id", F.coalesce("user_logged_numeric_id", "anonymous_numeric_id")
        )
    )


def keyed_layout(events: DataFrame, leading: Sequence[str] = LEADING_COLUMNS) -> DataFrame:
    """Source ids out, numeric ids under the final names, leading columns first."""
    final = events.drop(
        "listing_id", "anonymized_session_id", "user_id", "anonymous_id", "browser_family"
    ).withColumnsRenamed(
        {
            "user_logged_numeric_id": "user_id",
            "anonymous_numeric_id": "anonymous_id",
            "session_numeric_id": "session_id",
            "listing_id_numeric": "listing_id",
        }
    )
    return final.select(*leading, *[c for c in final.columns if c not in leading])
