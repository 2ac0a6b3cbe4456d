"""Mixing sources to target weights, in DataFrame operations only.

Every source gets a share of the budget by its weight, limited to a number of epochs of its
own size; what the limit frees goes to the other sources. A source gives whole epochs as often
as they fit, and for the rest its documents in the order of a hash-random key, cut at the exact
word. The keys are even, so equal ranges of keys are even buckets: a source is sorted in as
many key ranges as its rows need, however many of all rows it holds, and the ranges' sums,
added up along the source, turn each range's running sums into those of the whole source.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.llm.common import WORD, packed
from sessionloom.sources.scratch import save_scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 42
ROWS_A_RANGE = 8_192


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """Hexadecimal key, even over the rows; rows without id draw it from their text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), name))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, ranges, target`` of each source of ``sized (source, size)``.

    Sources in code point order, null last, get the weights in turn. With sources in the order
    of the level at which they reach their limit, those before the first that stays under the
    common level are the limited ones. The windows hold one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    limits = by_source.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(order.rowsBetween(0, Window.unboundedFollowing))
    free = F.col("level") * F.col("weight") < F.col("limit")
    common = F.max(F.when(free, F.col("level"))).over(everything)
    target = F.coalesce(F.least(F.col("limit"), F.col("weight") * F.col("common")), F.col("limit"))
    ranges = F.ceil(F.col("n") / ROWS_A_RANGE)
    return limits.withColumn("level", level).withColumn("common", common).select(
        "source", "source_size", ranges.alias("ranges"), F.round(target, 6).alias("target")
    )


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with their source's figures and their range of keys."""
    t = targets.withColumnRenamed("source", "of")
    joined = rows.join(t, rows["source"].eqNullSafe(t["of"])).drop("of")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.col("ranges")
    return joined.withColumn("range", F.shiftrightunsigned(place, 32))


def _with_taken(rows: DataFrame, narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows (doc_id, source, size, key, ...)`` with ``whole`` epochs and words of one more, ``part``."""
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = _placed(narrow, targets).groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    starts = sums.select(F.col("source").alias("of"), F.col("range").alias("of_range"), F.coalesce(F.sum("in_range").over(along), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = _placed(rows, targets).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(starts, run["source"].eqNullSafe(starts["of"]) & (run["range"] == starts["of_range"]))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - F.col("whole") * F.col("source_size") - F.col("start") - F.col("before")
    return run.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0), F.least(rest, F.col("size"))))


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), random_key(seed=seed).alias("key"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs (doc_id, text, source)``.

    taken counts the words of every repeat. Null and empty texts have size 0 and take nothing;
    a source without words has target 0; the null source is a source, the last one. Repeated
    rows count each; rows of one doc_id have one key and follow by size. Rows without id draw
    their key from the text. Other columns are not read. An empty table gives an empty table.
    """
    narrow = save_scratch(_narrow(docs, seed), "sizes")
    targets = save_scratch(source_targets(narrow, weights, share, epochs), "targets")
    taken = F.col("size") * F.col("whole") + F.col("part")
    return _with_taken(narrow, narrow, targets).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns kept, once per epoch that takes them.

    The document at a source's cut is taken in part: its first words, joined by single spaces;
    a column n_chars then holds the new length. Cases as in ``mix_plan``.
    """
    narrow = save_scratch(_narrow(docs, seed), "sizes")
    targets = save_scratch(source_targets(narrow, weights, share, epochs), "targets")
    rows = packed(docs, ["doc_id", "source", "text"]).select(
        "row", "doc_id", "source", word_count("text").alias("size"), random_key("doc_id", "text", seed).alias("key")
    )
    taken = _with_taken(rows, narrow, targets)
    copies = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = taken.where(copies > 0).select("row", "size", "part", F.explode(F.sequence(F.lit(1), copies)).alias("copy"), (F.col("whole") + 1).alias("last"))
    cut = (F.col("copy") == F.col("last")) & (F.col("part") < F.col("size"))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("row.text"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return each.select(*[v.alias(c) for c, v in out.items()])
