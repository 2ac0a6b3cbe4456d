"""Keyed events -> clean, bounded sessions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.functions.labels import share
from sessionloom.operators import skew
from sessionloom.sources.readers import scan_window
from sessionloom.sources.scratch import delete_scratch, save_scratch

# Interaction event types of the session stage.
SESSION_EVENT_TYPES = (
    "ListingRendered",
    "RankingClicked",
    "LeadPanelClicked",
    "LeadClicked",
    "FavoriteClicked",
    "ShareClicked",
)
# The raw event stage also keeps gallery clicks.
EVENT_STAGE_TYPES = (
    "ListingRendered",
    "GalleryClicked",
    "RankingClicked",
    "LeadPanelClicked",
    "LeadClicked",
    "FavoriteClicked",
    "ShareClicked",
)
PRESETS = {"sessions": SESSION_EVENT_TYPES, "events": EVENT_STAGE_TYPES}

SESSION = "user_id"
ITEM = "item_id"
ORDER = ("event_ts", "event_id")


def in_window(
    df: DataFrame, start: str, end: str, business: str | None = "SALE"
) -> DataFrame:
    """Rows with ``start <= dt <= end`` (both ends count) and the business type."""
    kept = df.where(F.col("dt").between(F.lit(start), F.lit(end)))
    return kept if business is None else kept.where(F.col("business_type") == business)


def load_window(spark, path: str, start: str, end: str, business: str | None = "SALE") -> DataFrame:
    """Pruned scan of the keyed events partitioned by ``dt``."""
    return in_window(scan_window(spark, path), start, end, business)


def interaction_events(df: DataFrame, preset: str | Sequence[str] = "sessions") -> DataFrame:
    """Keep the interaction event types of a preset, or of an explicit list."""
    types = PRESETS[preset] if isinstance(preset, str) else tuple(preset)
    return df.where(F.col("event_type").isin(*types))


def known_items(
    events: DataFrame,
    listings: DataFrame,
    where: Column | None = None,
    item: str = "listing_id",
    listing: str = "listing_id_numeric",
) -> DataFrame:
    """Events whose item has a listing (optionally only listings matching ``where``)."""
    known = listings if where is None else listings.where(where)
    return events.join(known.select(F.col(listing).alias(item)), item, "left_semi")


def to_interactions(df: DataFrame, item: str = "listing_id") -> DataFrame:
    """The session becomes the user, the listing the item; time in whole seconds."""
    return df.dropna(subset=["session_id", item, "event_ts"]).withColumns(
        {
            "original_user_id": F.col("user_id"),
            "user_id": F.col("session_id"),
            "item_id": F.col(item),
            "timestamp": F.unix_seconds("event_ts"),
        }
    )


def _changed(item: str) -> Column:
    return F.col("_previous").isNull() | (F.col(item) != F.col("_previous"))


def drop_repeats(
    df: DataFrame,
    session: str = SESSION,
    item: str = ITEM,
    order: Sequence[str] = ORDER,
    hot: DataFrame | str | None = skew.AUTO,
) -> DataFrame:
    """Drop an event that shows the same item as the one before it; A,B,A stays."""
    tagged = skew.with_previous(df, session, order, item, "_previous", hot)
    return tagged.where(_changed(item)).drop("_previous")


def prepare_sessions(
    df: DataFrame,
    slim: bool = False,
    item: str = "listing_id",
    order: Sequence[str] = ORDER,
    hot: DataFrame | str | None = skew.AUTO,
) -> DataFrame:
    """Interactions without consecutive repeats; ``slim`` keeps only ids and times."""
    rows = to_interactions(df, item)
    if slim:
        rows = rows.select(SESSION, ITEM, "timestamp", *order)
    return drop_repeats(rows, order=order, hot=hot)


def limit_sessions(
    df: DataFrame,
    min_length: int = 2,
    max_length: int = 50,
    session: str = SESSION,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Drop sessions shorter than ``min_length``; keep the latest ``max_length`` events.

    The rank filter comes first: Spark then trims each session to its latest rows
    before the shuffle, so the length is only ever counted over a bounded group.
    """
    newest = Window.partitionBy(session).orderBy(*[F.col(c).desc() for c in order])
    reach = max(min_length, max_length)
    ranked = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= reach)
    sized = ranked.withColumn("_size", F.count("*").over(Window.partitionBy(session)))
    kept = sized.where(F.col("_size") >= min_length)
    if reach > max_length:
        kept = kept.where(F.col("_rn") <= max_length)
    return kept.drop("_rn", "_size")


def min_support(df: DataFrame, support: int = 5, item: str = ITEM) -> DataFrame:
    """Keep items seen at least ``support`` times.

    Counts are combined map-side, so a very popular item is never gathered in one window
    partition.
    """
    return _without_rare(df, _rare_items(df, support, item), item)


def _rare_items(df: DataFrame, support: int, item: str = ITEM) -> DataFrame:
    """Items seen less than ``support`` times, and NULL where it occurs; written, so that Spark
    sees how few they are and need not shuffle ``df`` to drop them."""
    counts = df.groupBy(item).agg(F.count("*").alias("_n"))
    return save_scratch(counts.where((F.col("_n") < support) | F.col(item).isNull()).select(item), "rare")


def _without_rare(df: DataFrame, rare: DataFrame, item: str = ITEM) -> DataFrame:
    return df.where(F.col(item).isNotNull()).join(rare, item, "left_anti").select(*df.columns)


def _frequent_in_length(limited: DataFrame, min_length: int, support: int) -> DataFrame:
    """Rare items out, then sessions that became too short; ``limited`` is written and within the limits.

    Only sessions that lose a row can become too short, so only those are counted again.
    """
    rare = _rare_items(limited, support)
    if rare.isEmpty():
        return limited
    kept = _without_rare(limited, rare)
    losing = limited.where(F.col(ITEM).isNull()).select(SESSION).unionByName(
        limited.join(rare, ITEM, "left_semi").select(SESSION)
    )
    losing = save_scratch(losing.distinct().withColumnRenamed(SESSION, "_session"), "losing")
    same = F.col(SESSION).eqNullSafe(F.col("_session"))
    sizes = kept.join(losing, same, "left_semi").groupBy(SESSION).agg(F.count("*").alias("_n"))
    long = sizes.where(F.col("_n") >= min_length).select(SESSION)
    short = save_scratch(losing.join(long, same, "left_anti"), "short")
    return save_scratch(kept.join(short, same, "left_anti").select(*limited.columns), "sessions")


def stable_core(
    df: DataFrame, min_length: int = 2, support: int = 5, session: str = SESSION, item: str = ITEM
) -> DataFrame:
    """The largest part of ``df`` where every session has ``min_length`` rows and every item ``support``.

    Dropping a short session may make an item rare and the other way round, so both are
    peeled off in rounds until nothing changes. The counted (session, item) pairs are
    written once and stay; a round looks up only the pairs of the sessions and items that
    have just fallen out, and takes them off the counts of those that remain. What falls out and
    what it takes off are written, so that Spark sees how little they are and shuffles neither
    pairs, counts nor rows where they are few. Rows without session or item belong to no core. Two numbers per round reach the driver.
    """
    pairs = save_scratch(df.dropna(subset=[session, item]).groupBy(session, item).agg(F.count("*").alias("_w")), "pairs")
    alive = {c: save_scratch(pairs.groupBy(c).agg(F.sum("_w").alias("_n")), "alive") for c in (session, item)}
    least = {session: min_length, item: support}
    every = {session: None, item: None}
    while True:
        gone = {c: save_scratch(alive[c].where(F.col("_n") < least[c]).select(c), "gone") for c in alive}
        if all(g.isEmpty() for g in gone.values()):
            break
        after = {}
        for c, other in ((session, item), (item, session)):
            every[c] = gone[c] if every[c] is None else every[c].unionByName(gone[c])
            lost = pairs.join(gone[other], other, "left_semi").groupBy(c).agg(F.sum("_w").alias("_lost"))
            lost = save_scratch(lost, "lost")
            rest = alive[c].where(F.col("_n") >= least[c]).join(lost, c, "left")
            after[c] = save_scratch(rest.select(c, (F.col("_n") - F.coalesce("_lost", F.lit(0))).alias("_n")), "alive")
        alive = after
    core = df.dropna(subset=[session, item])
    for c in (item, session):
        if every[c] is not None:
            core = core.join(every[c], c, "left_anti")
    return core.select(*df.columns)


def sessions_from(
    interactions: DataFrame,
    min_length: int = 2,
    max_length: int = 50,
    support: int = 5,
    order: Sequence[str] = ORDER,
    hot: DataFrame | str | None = skew.AUTO,
    until_stable: bool = False,
    written: bool = True,
) -> DataFrame:
    """Repeats out, length limits, rare items out, length limits again (one pass).

    The repeat removal and the first length limit share one shuffle by session. Hot
    sessions take the sliced path up to that limit, which makes every session short.
    Its result is written, and what falls out afterwards is looked up in it: the rows are not
    shuffled again where that is little. What is returned is a written table then; with
    ``written`` false it is one plan down to the scan.
    With ``until_stable`` rare items and short sessions go until none is left.
    """
    hot = skew.find_hot(interactions, SESSION, hot)
    usual = interactions
    if hot is not None:
        usual, sliced = skew.split_hot(interactions, hot, SESSION, order)
    limited = limit_sessions(
        drop_repeats(usual, order=order, hot=None), min_length, max_length, order=order
    )
    if hot is not None:
        tagged = skew.with_previous_sliced(sliced, SESSION, order, ITEM, "_previous")
        tidy = tagged.where(_changed(ITEM)).drop("_previous")
        limited = limited.unionByName(limit_sessions(tidy, min_length, max_length, order=order))
    if until_stable:
        return stable_core(limited, min_length, support)
    if not written or max_length < min_length:
        frequent = limited.groupBy(ITEM).agg(F.count("*").alias("_n")).where(F.col("_n") >= support).select(ITEM)
        limited = limited.join(frequent, ITEM, "left_semi").select(*limited.columns)
        return limit_sessions(limited, min_length, max_length, order=order)
    limited = save_scratch(limited, "limited")
    frequent = _frequent_in_length(limited, min_length, support)
    if frequent is not limited:
        delete_scratch(limited)
    return frequent


def build_sessions(
    events: DataFrame,
    start: str,
    end: str,
    listings: DataFrame | None = None,
    where: Column | None = None,
    business: str | None = "SALE",
    types: str | Sequence[str] = "sessions",
    min_length: int = 2,
    max_length: int = 50,
    support: int = 5,
    item: str = "listing_id",
    order: Sequence[str] = ORDER,
    slim: bool = True,
) -> DataFrame:
    """Keyed events -> sessions ready for a recommender.

    Columns are pruned before the first shuffle when ``slim``; hot sessions are looked up
    on the cheap event predicates, before the join to the listings.
    """
    rows = interaction_events(in_window(events, start, end, business), types)
    hot = skew.hot_keys(rows.select(F.col("session_id").alias(SESSION)), SESSION)
    if listings is not None:
        rows = known_items(rows, listings, where, item=item)
    rows = to_interactions(rows, item)
    if slim:
        rows = rows.select(SESSION, ITEM, "timestamp", *order)
    return sessions_from(rows, min_length, max_length, support, order, hot, written=False)


def funnel_report(
    steps: Sequence[tuple[str, DataFrame]], session: str = "session_id", item: str = "listing_id"
) -> DataFrame:
    """Rows, sessions and items left after each step, with shares of the step before.

    All steps are counted in one job; steps that grow out of each other share their
    shuffles. A step that keeps nothing still has its line. The share windows run over
    one row per step.
    """
    parts = None
    for number, (_, df) in enumerate(steps):
        part = df.select(
            F.lit(number).alias("step"), F.col(session).alias("session"), F.col(item).alias("item")
        )
        parts = part if parts is None else parts.unionByName(part)
    counted = parts.groupBy("step").agg(
        F.count("*").alias("rows"),
        F.count_distinct("session").alias("sessions"),
        F.count_distinct("item").alias("items"),
    )
    return _with_shares(counted, [name for name, _ in steps])


def _with_shares(counted: DataFrame, steps: Sequence[str]) -> DataFrame:
    """``step, rows, sessions, items`` with names, zeros for missing steps and shares of the step before."""
    names = counted.sparkSession.createDataFrame(list(enumerate(steps)), "step int, name string")
    counts = ("rows", "sessions", "items")
    filled = names.join(F.broadcast(counted), "step", "left").select(
        "step", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )
    before = Window.partitionBy(F.lit(0)).orderBy("step")
    return filled.withColumns(
        {f"{c}_share": share(F.col(c), F.lag(c).over(before)) for c in counts}
    )


def session_funnel(
    events: DataFrame,
    start: str,
    end: str,
    listings: DataFrame | None = None,
    business: str | None = "SALE",
    types: str | Sequence[str] = "sessions",
    min_length: int = 2,
    max_length: int = 50,
    support: int = 5,
    item: str = "listing_id",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """What each step of `build_sessions` keeps.

    Every step keeps part of the one before, so a row is marked with the last step it
    reaches, and a session or item with the last step of any of its rows. Events and
    listings are read once: the marked ids and times, and the counted (session, item) pairs
    from the repeats on, are written in between.
    """
    passed = [
        F.lit(True) if business is None else F.coalesce(F.col("business_type") == business, F.lit(False)),
        F.lit(True) if listings is None else F.col("_listed").isNotNull(),
        F.coalesce(F.col("event_type").isin(*(PRESETS[types] if isinstance(types, str) else types)), F.lit(False)),
    ]
    window = in_window(events, start, end, business=None)
    if listings is not None:
        known = listings.select(F.col("listing_id_numeric").alias(item)).distinct().withColumn("_listed", F.lit(1))
        window = skew.left_lookup(window, known, item)
    step = F.lit(3)
    for number in (2, 1, 0):
        step = F.when(passed[number], step).otherwise(F.lit(number))
    times = dict.fromkeys([*order, "event_ts"])
    marked = save_scratch(
        window.select(F.col("session_id").alias(SESSION), F.col(item).alias(ITEM), *times, step.alias("_step")), "funnel"
    )
    rows = marked.where(F.col("_step") == 3).dropna(subset=[SESSION, ITEM, "event_ts"]).drop("_step")
    distinct = drop_repeats(rows, order=order)
    sized = limit_sessions(distinct, min_length, max_length, order=order)
    both = distinct.select(SESSION, ITEM, F.lit(1).alias("_n"), F.lit(0).alias("_sized")).unionByName(
        sized.select(SESSION, ITEM, F.lit(0).alias("_n"), F.lit(1).alias("_sized"))
    )
    pairs = save_scratch(both.groupBy(SESSION, ITEM).agg(F.sum("_n").alias("_n"), F.sum("_sized").alias("_sized")), "funnel")
    in_length = pairs.where(F.col("_sized") > 0).select(SESSION, ITEM, F.col("_sized").alias("_w"))
    often = in_length.groupBy(ITEM).agg(F.sum("_w").alias("_n")).where(F.col("_n") >= support)
    frequent = in_length.join(often.select(ITEM), ITEM, "left_semi")
    long = frequent.groupBy(SESSION).agg(F.sum("_w").alias("_n")).where(F.col("_n") >= min_length)
    final = frequent.join(long.select(SESSION), SESSION, "left_semi")
    later = [pairs.select(SESSION, ITEM, F.col("_n").alias("_w")), in_length, frequent, final]
    steps = None
    for number, df in enumerate(later, 4):
        part = df.select(F.lit(number).alias("step"), SESSION, ITEM, "_w")
        steps = part if steps is None else steps.unionByName(part)
    counted = _reached(marked).unionByName(
        steps.groupBy("step").agg(
            F.sum("_w").alias("rows"), F.count_distinct(SESSION).alias("sessions"), F.count_distinct(ITEM).alias("items")
        )
    )
    return _with_shares(
        counted,
        ["window", "business", "known_items", "event_types", "repeats", "length", "support", "final_length"],
    )


def _reached(marked: DataFrame) -> DataFrame:
    """Rows, sessions and items that reach each step, from rows marked with their last ``_step``."""
    kinds = []
    for kind in ("rows", "sessions", "items"):
        key = {"sessions": SESSION, "items": ITEM}.get(kind)
        last = marked if key is None else marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("_step").alias("_step"))
        kinds.append(last.groupBy("_step").agg(F.count("*").alias("_n")).withColumn("_kind", F.lit(kind)))
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    steps = every.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_step"))))
    return steps.groupBy("step").agg(
        *[F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col("_n"))), F.lit(0)).alias(kind) for kind in ("rows", "sessions", "items")]
    )
