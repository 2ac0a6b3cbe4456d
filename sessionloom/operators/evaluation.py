"""Leave-one-out split, candidate modes and ranking metrics."""

from collections.abc import Callable, Sequence
from math import log2

from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.operators import skew
from sessionloom.operators.keys import dense_key
from sessionloom.operators.sampled_ranks import ranks_of_places
from sessionloom.operators.sampling import draw_items, draw_places
from sessionloom.operators.scorers import seen_items, top_k
from sessionloom.sources.scratch import save_scratch

ORDER = ("event_ts", "event_id")
CUTOFFS = (5, 10, 20)
METRICS = ("recall", "mrr", "ndcg", "hit")


def split_leave_one_out(
    df: DataFrame, order: Sequence[str] = ORDER, hot: DataFrame | str | None = skew.AUTO
) -> DataFrame:
    """Add ``part``: the last item tests, the one before validates, the rest trains.

    A session keeps at least one training item, so two items give no validation and a
    single one trains.
    """
    hot = skew.find_hot(df, "user_id", hot)
    newest = Window.partitionBy("user_id").orderBy(*[F.col(c).desc() for c in order])

    def label(ranked):
        part = (
            F.when((F.col("_back") == 1) & F.col("_older"), "test")
            .when((F.col("_back") == 2) & F.col("_older"), "valid")
            .otherwise("train")
        )
        return ranked.withColumn("part", part).drop("_back", "_older")

    def plain(rows):
        older = F.lead(F.lit(True), 1, False).over(newest)
        return label(rows.withColumns({"_back": F.row_number().over(newest), "_older": older}))

    if hot is None:
        return plain(df)
    usual, sliced = skew.split_hot(df, hot, "user_id", order)
    long = skew.with_position_sliced(sliced, "user_id", order, "_back", descending=True)
    return plain(usual).unionByName(label(long.withColumn("_older", F.lit(True))))


def history_cut(df: DataFrame, n: int = 50, session: str = "user_id", order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``n`` rows per session; trimmed before the shuffle."""
    newest = Window.partitionBy(session).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")
    )


def evaluation_parts(split: DataFrame, on: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, history, targets): validation items are history when testing."""
    train = split.where(F.col("part") == "train").drop("part")
    known = ["train", "valid"] if on == "test" else ["train"]
    history = split.where(F.col("part").isin(known)).drop("part")
    targets = split.where(F.col("part") == on).select("user_id", "item_id")
    return train, history, targets


def negatives(
    targets: DataFrame, history: DataFrame, catalogue: DataFrame, n: int = 100, seed: int = 42
) -> DataFrame:
    """Uniform negatives per target session: never the target, never a seen item."""
    excluded = seen_items(history).unionByName(targets.select("user_id", "item_id"))
    return draw_items(targets.select("user_id").distinct(), catalogue, excluded, n, seed)


def target_ranks(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Rank of each target, NULL when it is not among the ranked items."""
    return targets.select("user_id", "item_id").join(
        ranked.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left"
    )


def ranks_full(scorer, history: DataFrame, targets: DataFrame, depth: int = max(CUTOFFS)) -> DataFrame:
    """Ranks among all unseen items, down to ``depth``."""
    asked = history.join(targets.select("user_id"), "user_id", "left_semi")
    if hasattr(scorer, "ranks"):
        return target_ranks(scorer.ranks(asked, targets, depth), targets)
    return target_ranks(scorer.top(asked, depth), targets)


def ranks_sampled(
    scorer, history: DataFrame, targets: DataFrame, drawn: DataFrame, depth: int = max(CUTOFFS)
) -> DataFrame:
    """Ranks among the target and its sampled negatives."""
    candidates = targets.select("user_id", "item_id").unionByName(drawn.select("user_id", "item_id"))
    asked = history.join(targets.select("user_id"), "user_id", "left_semi")
    return target_ranks(top_k(scorer.score(asked, candidates), depth), targets)


def with_evidence(scorer, history: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets of the sessions where any of them has a score.

    The others have no rank whatever is drawn beside them, so nothing need be drawn there.
    """
    scored = save_scratch(scorer.score(history, targets).select("user_id").distinct(), "scored")
    return targets.join(scored, "user_id", "left_semi")


def ranks_uniform(
    scorer,
    history: DataFrame,
    targets: DataFrame,
    catalogue: DataFrame,
    n: int = 100,
    seed: int = 42,
    depth: int = max(CUTOFFS),
) -> DataFrame:
    """`ranks_sampled` among ``n`` `negatives`, drawn only where and in the form that they are needed.

    Scorers with ``factors()`` look their scores up by place, so no draw is shuffled; ``catalogue``
    must hold the targets. Of scorers that are ``sparse`` the sessions whose targets have no score
    are set aside first.
    """
    if hasattr(scorer, "factors"):
        return target_ranks(_ranks_by_factors(scorer, history, targets, catalogue, n, seed, depth), targets)
    measured = targets
    if getattr(scorer, "sparse", False):
        asked = history.join(targets.select("user_id"), "user_id", "left_semi")
        measured = save_scratch(with_evidence(scorer, asked, targets), "measured")
    known = history.join(measured.select("user_id"), "user_id", "left_semi")
    drawn = negatives(measured, known, catalogue, n, seed)
    ranks = ranks_sampled(scorer, known, measured, drawn, depth)
    return ranks if measured is targets else target_ranks(ranks, targets)


def _ranks_by_factors(scorer, history, targets, catalogue, n, seed, depth):
    numbered = save_scratch(dense_key(catalogue, "item_id", "_at"), "numbered")
    sessions, items = scorer.factors()
    excluded = seen_items(history).unionByName(targets.select("user_id", "item_id"))
    placed = targets.select("user_id", "item_id").distinct().join(numbered, "item_id")
    beside = placed.groupBy("user_id").agg(F.collect_list(F.struct("_at", "item_id")).alias("_of"))
    beside = beside.select("user_id", F.col("_of._at").alias("targets"), F.col("_of.item_id").alias("names"))
    if sessions is not None:
        beside = beside.join(sessions, "user_id")
    drawn = draw_places(targets.select("user_id").distinct(), numbered, excluded, n, seed, beside)
    return ranks_of_places(
        drawn.withColumnRenamed("_kept", "drawn"),
        items.join(numbered, "item_id").select(F.col("_at").alias("place"), "vector"),
        depth,
    )


def _ideal(k: int, positives):
    """Best possible DCG with that many positives."""
    sums, total = [], 0.0
    for place in range(1, k + 1):
        total += 1 / log2(place + 1)
        sums.append(F.lit(total))
    return F.get(F.array(*sums), F.least(positives, F.lit(k)).cast("int") - 1)


def metrics_at_k(ranks: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """(metric, k, value) from one row per positive item and its rank.

    With one positive per session Hit = Recall = [rank <= k], MRR = 1/rank and
    NDCG = 1/log2(rank + 1); several positives use the general forms.
    """
    per_session = []
    names = []
    for k in cutoffs:
        found = F.col("rank") <= k
        hits = F.count_if(found)
        gain = F.sum(F.when(found, F.lit(1.0) / F.log2(F.col("rank") + 1)))
        per_session += [
            (hits / F.count("*")).alias(f"recall_{k}"),
            F.coalesce(F.lit(1.0) / F.min(F.when(found, F.col("rank"))), F.lit(0.0)).alias(f"mrr_{k}"),
            F.coalesce(gain / _ideal(k, F.count("*")), F.lit(0.0)).alias(f"ndcg_{k}"),
            F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
        names += [(m, k, f"{m}_{k}") for m in METRICS]
    means = ranks.groupBy("user_id").agg(*per_session).agg(
        *[F.avg(c).alias(c) for _, _, c in names]
    )
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(c).alias("value")) for m, k, c in names]
    )
    return means.select(F.explode(rows).alias("r")).select("r.*")


def evaluate(
    build: Callable[[DataFrame], object],
    split: DataFrame,
    model: str,
    dataset: str = "sessions",
    on: str = "test",
    mode: str = "full",
    n_negatives: int = 100,
    seed: int = 42,
    cutoffs: Sequence[int] = CUTOFFS,
) -> DataFrame:
    """Fit on the training part and measure one scorer under one protocol."""
    train, history, targets = evaluation_parts(split, on)
    scorer = build(train)
    depth = max(cutoffs)
    if mode == "full":
        ranks, protocol = ranks_full(scorer, history, targets, depth), "full"
    elif mode == "sampled":
        ranks, protocol = ranks_uniform(scorer, history, targets, split, n_negatives, seed, depth), f"uni{n_negatives}"
    else:
        raise ValueError(f"unknown mode {mode!r}: use full or sampled")
    return metrics_at_k(ranks, cutoffs).select(
        F.lit(model).alias("model"),
        F.lit(dataset).alias("dataset"),
        F.lit(protocol).alias("protocol"),
        "metric",
        "k",
        "value",
    )
