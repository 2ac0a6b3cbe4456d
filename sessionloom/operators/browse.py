"""Session list, session detail and item list for browsing."""

import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, functions as F

from sessionloom.functions.labels import DEFAULT_CENTER
from sessionloom.operators import skew
from sessionloom.operators.keys import row_in_partition
from sessionloom.sources.scratch import save_scratch

ORDER = ("timestamp", "event_id")
SORT_COLUMNS = ("session_id", "event_count", "first_event", "last_event")
DETAIL_COLUMNS = ("city", "neighborhood", "price", "bedrooms", "bathrooms", "usable_areas")


def summarize_sessions(
    df: DataFrame, session: str = "session_id", time: str = "timestamp", order: Sequence[str] = ORDER
) -> DataFrame:
    """First user, first and last time, events and first item of each session."""
    at = F.struct(*order)
    return df.groupBy(session).agg(
        F.min_by("user_id", at).alias("user_id"),
        F.min(time).alias("first_event"),
        F.max(time).alias("last_event"),
        F.count("item_id").alias("event_count"),
        F.min_by("item_id", at).alias("first_item"),
    )


@dataclass
class SessionPages:
    """Sorted session summaries on disk, of which a page opens only the files that hold it.

    ``parts`` has one (number, rows, file) per file, in order; that is all the driver knows.
    """

    rows: DataFrame
    parts: list[tuple[int, int, str]]

    @property
    def total(self) -> int:
        return sum(n for _, n, _ in self.parts)

    def between(self, first: int, last: int) -> DataFrame:
        """The sessions at the 0-based places ``first`` to ``last``, the end excluded, with their ``place``."""
        found, before = [], 0
        for _, n, path in self.parts:
            low, high = max(first - before, 0), min(last - before, n)
            if low < high:
                held = self.rows.sparkSession.read.schema(self.rows.schema).parquet(path)
                held = held.where((F.col("_row") >= low) & (F.col("_row") < high))
                found.append(held.withColumn("place", F.col("_row") + before))
            before += n
        out = found[0] if found else self.rows.where("false").withColumn("place", F.col("_row"))
        for more in found[1:]:
            out = out.unionByName(more)
        return out.drop("_row", "_part")


def index_sessions(
    df: DataFrame, sort_by: str = "first_event", ascending: bool = False, order: Sequence[str] = ORDER
) -> SessionPages:
    """Session summaries, range-sorted by a column (unknown: ``first_event``) and then by id, and written.

    Rows without session id are left out. One count per file reaches the driver.
    """
    if sort_by not in SORT_COLUMNS:
        sort_by = "first_event"
    main = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    by = [main, F.col("session_id").asc()]
    summary = summarize_sessions(df.where(F.col("session_id").isNotNull()), order=order)
    placed = summary.repartitionByRange(*by).sortWithinPartitions(*by)
    saved = save_scratch(
        placed.withColumns({"_part": F.spark_partition_id(), "_row": row_in_partition()}), "session-pages"
    )
    files = {int(re.search(r"part-(\d+)", path.rsplit("/", 1)[1])[1]): path for path in saved.inputFiles()}
    counts = sorted(saved.groupBy("_part").count().collect())
    return SessionPages(saved, [(part, n, files[part]) for part, n in counts])


def list_sessions(
    df: DataFrame,
    listings: DataFrame,
    sort_by: str = "first_event",
    ascending: bool = False,
    page: int = 1,
    per_page: int = 50,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """One page of the session list with the place of each session's first item.

    An unknown sort column means ``first_event``; the page is clamped to the existing ones.
    """
    return session_page(index_sessions(df, sort_by, ascending, order), listings, page, per_page)


def session_page(pages: SessionPages, listings: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    """`list_sessions` from an index: any page, however deep, reads the files that hold it.

    The page has at most ``per_page`` rows, so it is broadcast to pick its listings.
    """
    total = pages.total
    last = max(1, ceil(total / per_page))
    page = max(1, min(page, last))
    rows = pages.between((page - 1) * per_page, page * per_page)
    wanted = F.broadcast(rows.select("first_item").distinct())
    places = listings.select(F.col("listing_id_numeric").alias("first_item"), "state", "city").join(
        wanted, "first_item", "left_semi"
    )
    return rows.join(F.broadcast(places), "first_item", "left").orderBy("place").select(
        "session_id",
        "user_id",
        "state",
        "city",
        "event_count",
        "first_event",
        "last_event",
        F.lit(page).alias("page"),
        F.lit(total).cast("bigint").alias("total_sessions"),
        F.lit(last).alias("total_pages"),
        F.lit(page > 1).alias("has_prev"),
        F.lit(page < last).alias("has_next"),
    )


def session_detail(
    df: DataFrame,
    listings: DataFrame,
    ids: DataFrame | None = None,
    columns: Sequence[str] = DETAIL_COLUMNS,
    order: Sequence[str] = ORDER,
    hot: DataFrame | str | None = skew.AUTO,
) -> DataFrame:
    """Events in order with their listing, for the sessions in ``ids`` or for all.

    Positions count every event; events whose item has no listing are not shown. An
    unknown session id gives no rows.
    """
    chosen = df if ids is None else df.join(ids.select("session_id"), "session_id", "left_semi")
    placed = skew.with_position(chosen, "session_id", order, "position", hot=hot)
    shown = listings.select(F.col("listing_id_numeric").alias("item_id"), *columns)
    return placed.join(shown, "item_id").select(
        "session_id", "position", "item_id", *[c for c in df.columns if c not in ("session_id", "item_id")], *columns
    )


def session_center(df: DataFrame, listings: DataFrame) -> DataFrame:
    """Mean coordinates of each session's items, or the default centre."""
    points = listings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("listing_id_numeric").alias("item_id"), "lat", "lon"
    )
    views = df.groupBy("session_id", "item_id").agg(F.count("*").alias("views"))
    n = F.sum(F.when(F.col("lat").isNotNull(), F.col("views")))

    def mean(c, default):
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("views")), n), F.lit(default))

    return (
        skew.left_lookup(views, points, "item_id")
        .groupBy("session_id")
        .agg(
            mean("lat", DEFAULT_CENTER[0]).alias("center_lat"),
            mean("lon", DEFAULT_CENTER[1]).alias("center_lon"),
            F.coalesce(n, F.lit(0)).alias("points"),
        )
    )


def available_items(listings: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` item numbers, each with the total number of items."""
    total = listings.agg(F.count_distinct("listing_id_numeric").alias("n")).scalar()
    return (
        listings.select(F.col("listing_id_numeric").alias("item_id"))
        .distinct()
        .orderBy("item_id")
        .limit(limit)
        .withColumn("total", total)
    )
