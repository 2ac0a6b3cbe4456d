"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups of equal texts stay together. In the order of their first document they are cut into
contiguous shards whose largest holds as few bytes as possible: the smallest capacity for
which filling shards greedily needs no more shards than there are.

The groups are a sorted table of running sums. The search never holds it: each round asks
Spark for the first and last boundary in a bounded number of equal intervals, runs the greedy
check with bounds from both sides, and so narrows the capacity and, for every cut, the
stretch of the table where it can lie. Only those stretches are asked for again. After a few
rounds capacity and cuts are exact.
"""

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.llm.common import packed, tasks_for
from sessionloom.operators.keys import global_position
from sessionloom.sources.scratch import save_scratch

SHARDS = 16
BOUNDARIES = 8_192  # intervals that one round asks for
ROWS_A_TASK = 500_000


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_key(text: str = "text") -> Column:
    """Equal for equal texts; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def running_groups(sized: DataFrame) -> DataFrame:
    """Groups of ``sized (doc_id, size, key)`` in order: ``key, n, weight, end``; end sums the weights up to here."""
    groups = sized.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("weight"), F.count("*").alias("n"))
    groups = save_scratch(groups, "groups")
    parts = tasks_for(sized.sparkSession, groups.count(), ROWS_A_TASK)
    order = [F.col("first").asc_nulls_last(), F.col("key")]
    placed = groups.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = save_scratch(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "groups")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("part").agg(F.sum("weight").alias("sum")).select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    inside = F.sum("weight").over(Window.partitionBy("part").orderBy("at"))
    return save_scratch(
        placed.select("key", "n", "weight", "part", inside.alias("inside")).join(F.broadcast(offsets), "part")
        .select("key", "n", "weight", (F.col("start") + F.col("inside")).alias("end")),
        "running",
    )


class _Boundaries:
    """What is known of the boundaries in one stretch of the table: first and last of each interval."""

    def __init__(self, low: int, high: int, pairs: list[tuple[int, int]]):
        pairs = sorted({(low, low), *pairs})
        self.low, self.high = low, high
        self.firsts, self.lasts = [a for a, _ in pairs], [b for _, b in pairs]

    def reach(self, to: int) -> tuple[int, int]:
        """Bounds of the last boundary not beyond ``to``."""
        to = min(to, self.high)
        i = max(0, bisect_right(self.firsts, to) - 1)
        return (self.lasts[i],) * 2 if to >= self.lasts[i] else (self.firsts[i], to)


def _fill(capacity: int, total: int, known: list[_Boundaries], side: int) -> tuple[list[int], bool]:
    """Cuts of the greedy filling, with the lower (0) or upper (1) bound of each reach; whether the last shard holds the rest."""
    at, cuts = 0, []
    for k in known:
        at = total if at + capacity >= total else k.reach(at + capacity)[side]
        cuts.append(at)
    return cuts, at + capacity >= total


def _least(low: int, high: int, fits) -> int:
    """Smallest capacity in low..high that fits; high is taken to fit."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def _ask(running: DataFrame, stretches: list[tuple[int, int]]) -> dict[tuple[int, int], _Boundaries]:
    distinct = sorted(set(stretches))
    share = max(2, BOUNDARIES // len(distinct))
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(distinct)])
    within = F.filter(table, lambda s: (F.col("end") > s["a"]) & (F.col("end") <= s["b"]))
    some = running.where(F.col("end").between(distinct[0][0], max(b for _, b in distinct))).select("end", F.inline(within))
    step = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / share))
    found = some.groupBy("i", F.floor((F.col("end") - F.col("a")) / step).alias("bin")).agg(F.min("end"), F.max("end")).collect()
    pairs: dict[int, list[tuple[int, int]]] = {}
    for i, _, first, last in found:
        pairs.setdefault(i, []).append((first, last))
    return {s: _Boundaries(*s, pairs.get(i, [])) for i, s in enumerate(distinct)}


def minimax_cuts(running: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """Smallest capacity and the ends of the shards but the last, in running weight."""
    total, heaviest = running.agg(F.max("end"), F.max("weight")).first()
    if not total:
        return 0, [0] * (shards - 1)
    low, high = max(heaviest, -(-total // shards)), total // shards + heaviest
    stretches = [(0, total)] * (shards - 1)
    while True:
        asked = _ask(running, stretches) if stretches else {}
        known = [asked[s] for s in stretches]
        least = _least(low, high, lambda c: _fill(c, total, known, 1)[1])
        high = _least(least, high, lambda c: _fill(c, total, known, 0)[1])
        low = least
        at_low, at_high = _fill(low, total, known, 0)[0], _fill(high, total, known, 1)[0]
        if low == high and at_low == at_high:
            return high, at_high
        stretches = list(zip(at_low, at_high, strict=True))


def _sharded_groups(sized: DataFrame, shards: int) -> DataFrame:
    running = running_groups(sized)
    _, cuts = minimax_cuts(running, shards)
    beyond = F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: F.col("end") > c)
    return running.select("key", "n", "end", F.size(beyond).alias("shard"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs (doc_id, text)``.

    size is the text's UTF-8 bytes plus 1; slot numbers a shard's rows from 0 in the order of
    groups, then doc_id. Null texts count as empty, and both are one group. Groups follow by
    their smallest doc_id, groups without any come last. Repeated rows get a slot each. With
    fewer groups than shards the last shards stay empty. Other columns are not read. An empty
    table gives an empty table.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = save_scratch(docs.select("doc_id", text_size().alias("size"), crc.alias("text_crc32"), text_key().alias("key")), "sizes")
    groups = save_scratch(_sharded_groups(sized, shards), "sharded")
    counts = dict(groups.groupBy("shard").agg(F.sum("n")).collect())
    starts = [0, *accumulate(counts.get(k, 0) for k in range(shards))]
    placed = global_position(sized.join(groups.drop("n"), "key").drop("key"), ["end", "doc_id"], "place")
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - 1 - start).alias("slot"))


def with_shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs``, all columns kept, with the ``shard`` of each row; cases as in ``sharded``."""
    sized = save_scratch(docs.select("doc_id", text_size().alias("size"), text_key().alias("key")), "sizes")
    groups = _sharded_groups(sized, shards).select("key", "shard")
    rows = packed(docs, ["text"]).select("row", text_key().alias("key"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "shard"]
    return rows.join(groups, "key").select(*kept, "shard")
