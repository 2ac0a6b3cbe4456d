"""Next-item scorers as Spark jobs.

A scorer is fitted on training interactions (user_id = session, item_id) and answers
``top(history, k, only)``: the k best unseen items per session, of the items in ``only``
if that is given (the neighbourhood scorers also take ``hidden``: items that are left out
after the cut to k), and ``score(history, candidates)``: scores of given (user_id, item_id)
pairs. A scorer whose scores are products of vectors gives these by ``factors()``: (user_id,
vector), or None where an item scores the same everywhere, and (item_id, vector); one that
leaves most items without a score is ``sparse``. One with ``ranks(history, targets, k)`` gives the
rows of ``top`` that are targets without making the others. Items without a score are left out. Scores are rounded to 9 places so that ties are the same on every
run, and ties go to the smaller item id.
"""

from dataclasses import dataclass
from math import ceil

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionloom.functions.hashing import draw_unit
from sessionloom.operators import skew
from sessionloom.operators.inner_products import largest_products
from sessionloom.operators.keys import dense_key
from sessionloom.operators.ranked_lists import best_unseen, rank_lists
from sessionloom.operators.sampling import draw_items
from sessionloom.operators.session_blocks import best_sums, in_blocks, split_long
from sessionloom.sources.scratch import save_scratch, scratch_folder, shuffles_dropped

ORDER = ("event_ts", "event_id")
PLACES = 9
LONG_SESSION = 128  # distinct items per block when a longer session is paired
ROWS_A_TASK = 262_144  # rows of sessions whose pairs a task adds up


def seen_items(history: DataFrame) -> DataFrame:
    return history.select("user_id", "item_id").distinct()


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows per session, ranked from 1; trimmed before the shuffle."""
    best = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "item_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def unseen(scores: DataFrame, history: DataFrame) -> DataFrame:
    return scores.join(seen_items(history), ["user_id", "item_id"], "left_anti")


def among(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    return scores.join(candidates.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def listed(df: DataFrame, only: DataFrame | None, item: str = "item_id") -> DataFrame:
    """Rows whose item is in ``only (item_id)``; all rows without it."""
    if only is None:
        return df
    return df.join(only.select(F.col("item_id").alias(item)), item, "left_semi").select(*df.columns)


def unlisted(train: DataFrame, only: DataFrame | None) -> DataFrame | None:
    """Trained items that are not in ``only (item_id)``; None without it.

    Written, so that Spark sees how few they are: lists of neighbours lose them where they lie,
    instead of being shuffled by neighbour to be compared with all listed items.
    """
    if only is None:
        return None
    return save_scratch(train.select("item_id").distinct().join(only.select("item_id"), "item_id", "left_anti"), "unlisted")


def without(df: DataFrame, dropped: DataFrame | None, item: str) -> DataFrame:
    """Rows whose item is not in ``dropped (item_id)``; all rows without it."""
    if dropped is None:
        return df
    return df.join(dropped.select(F.col("item_id").alias(item)), item, "left_anti").select(*df.columns)


def last_item(history: DataFrame, lag: int = 1, order=ORDER) -> DataFrame:
    """The ``lag``-th newest item of each session."""
    newest = Window.partitionBy("user_id").orderBy(*[F.col(c).desc() for c in order])
    return (
        history.withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= lag)
        .where(F.col("_rn") == lag)
        .select("user_id", "item_id")
    )


def popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(F.count("*").cast("double").alias("score"))


def weights(df: DataFrame) -> DataFrame:
    """The session x item matrix: views per (session, item)."""
    return df.groupBy("user_id", "item_id").agg(F.count("*").alias("x"))


def cosine(dot: Column, norm_i: Column, norm_j: Column, shrink) -> Column:
    return F.try_divide(dot.cast("double"), F.sqrt(norm_i) * F.sqrt(norm_j) + shrink)


def longest_session(train: DataFrame) -> int:
    """Rows of the longest session; the only value fetched."""
    with shuffles_dropped(train.sparkSession):
        return train.groupBy("user_id").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def co_occurrence(train: DataFrame) -> DataFrame:
    """Dot products of item columns, both ways: (item, neighbour, dot, norm, norm_near).

    A session's items come together in one row, and each of them takes the others along to
    its own partition as arrays, so a pair costs three numbers in one shuffle and is added
    up, and later ranked, where it arrives. The longest session is measured. Sessions of more
    than LONG_SESSION rows are cut into blocks of items, and each pair of blocks is its own
    join key, so no long session is paired inside one task and no pair is lost. Items with more
    than HOT_FLOOR rows are dealt by pair instead, so that none fills a task.
    """
    matrix = weights(train)
    norms = save_scratch(
        matrix.groupBy("item_id").agg(F.sum(F.col("x") * F.col("x")).alias("norm"), F.count("*").alias("_rows")), "norms"
    )
    mine = F.struct(F.col("item_id"), F.col("x"), F.col("norm"))
    events, most = norms.agg(F.sum("_rows"), F.max("norm")).first()
    kind = "int" if (most or 0) < 1 << 31 else "bigint"  # of norms beside a pair
    if longest_session(train) <= LONG_SESSION:
        count = "smallint"  # a product of views is at most the square of LONG_SESSION
        # norms first, so that views are counted and gathered after one shuffle by session
        rows = train.select("user_id", "item_id").join(norms.select("item_id", "norm"), "item_id").repartition("user_id")
        rows = rows.groupBy("user_id", "item_id", "norm").agg(F.count("*").alias("x"))
        gathered = rows.groupBy("user_id").agg(F.collect_list(mine).alias("_all"))
    else:
        count = "bigint"
        rows = matrix.join(norms, "item_id").select("user_id", "item_id", "x", "norm")
        sizes = matrix.groupBy("user_id").agg(F.ceil(F.count("*") / LONG_SESSION).cast("int").alias("_blocks"))
        cut = rows.join(sizes, "user_id").withColumn("_b", F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int"))
        gathered = cut.groupBy("user_id", "_b", "_blocks").agg(F.collect_list(mine).alias("_all"))
        other = gathered.select("user_id", F.col("_b").alias("_c"), F.col("_all").alias("_near"))
        every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        gathered = gathered.select("user_id", "_all", every.alias("_c")).join(other, ["user_id", "_c"])
    near = "_near" if "_near" in gathered.columns else "_all"
    sent = gathered.select(F.explode("_all").alias("_i"), F.col(near).alias("_near")).select(
        F.col("_i.item_id").alias("item"), F.col("_i.x").alias("_x"), F.col("_i.norm").alias("norm"),
        F.filter("_near", lambda o: o["item_id"] != F.col("_i.item_id")).alias("_near"),
    ).where(F.size("_near") > 0)
    sent = sent.select(
        "item", "norm", F.col("_near.item_id").alias("_item"),
        F.transform("_near.x", lambda x: (x * F.col("_x")).cast(count)).alias("_dot"), F.col("_near.norm").cast(f"array<{kind}>").alias("_norm"),
    )
    spark = train.sparkSession
    # never less than Spark's own number, so that later joins by item keep this partitioning
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((events or 0) / ROWS_A_TASK))
    hot = norms.where(F.col("_rows") > skew.HOT_FLOOR).select(F.col("item_id").alias("item"))
    if hot.isEmpty():
        return _dots(sent.repartition(tasks, "item"))
    usual, hot = sent.join(hot, "item", "left_anti"), sent.join(hot, "item", "left_semi")
    return _dots(usual.select(*sent.columns).repartition(tasks, "item")).unionByName(_dots(hot))


def _dots(sent: DataFrame) -> DataFrame:
    pair = F.arrays_zip("_item", "_dot", "_norm")
    return (
        sent.select("item", "norm", F.explode(pair).alias("_p"))
        .groupBy("item", F.col("_p._item").alias("neighbour"))
        .agg(F.sum("_p._dot").alias("dot"), F.max("norm").alias("norm"), F.max("_p._norm").cast("bigint").alias("norm_near"))
    )


def item_similarity(train: DataFrame, k: int = 100, shrink: float = 0.0) -> DataFrame:
    """The k most similar items of every item by (shrunk) cosine."""
    sim = cosine(F.col("dot"), F.col("norm"), F.col("norm_near"), shrink)
    nearest = Window.partitionBy("item").orderBy(F.col("sim").desc(), "neighbour")
    return (
        co_occurrence(train)
        .select("item", "neighbour", sim.alias("sim"))
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
    )


def transitions(
    train: DataFrame, order=ORDER, hot: DataFrame | str | None = skew.AUTO, lag: int = 1
) -> DataFrame:
    """Counts and probabilities P(item_j | item_i ``lag`` steps before)."""
    moves = train.select("user_id", "item_id", *order).withColumn("item_i", F.col("item_id"))
    for _ in range(lag):
        kept = moves.select("user_id", "item_id", *order, F.col("item_i").alias("_from"))
        moves = skew.with_previous(kept, "user_id", order, "_from", "item_i", hot)
    moves = moves.where(F.col("item_i").isNotNull())
    counts = moves.groupBy("item_i", F.col("item_id").alias("item_j")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("item_i").agg(F.sum("n").alias("total"))
    return counts.join(totals, "item_i").select(
        "item_i", "item_j", "n", (F.col("n") / F.col("total")).alias("p")
    )


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "item_id").agg(
        F.round(F.sum("score"), PLACES).alias("score")
    )


def neighbour_scores(history: DataFrame, similarity: DataFrame) -> DataFrame:
    """Sum of similarities to the session's items, repeats counted."""
    sims = similarity.select(F.col("item").alias("item_id"), "neighbour", "sim")
    return _summed(
        weights(history)
        .join(sims, "item_id")
        .select("user_id", F.col("neighbour").alias("item_id"), (F.col("x") * F.col("sim")).alias("score"))
    )


def candidate_scores(history: DataFrame, similarity: DataFrame, candidates: DataFrame) -> DataFrame:
    """`neighbour_scores` of given (user_id, item_id) pairs only.

    A session's items meet its candidates first, and each such pair is looked up in the list
    of the item; no row is made for the other neighbours.
    """
    entries = F.collect_list(F.struct("neighbour", "sim"))
    lists = similarity.groupBy(F.col("item").alias("item_id")).agg(entries.alias("_list"))
    asked = candidates.select("user_id", F.col("item_id").alias("_asked")).distinct()
    found = (
        weights(history)
        .join(asked, "user_id")
        .join(lists, "item_id")
        .withColumn("_place", F.array_position("_list.neighbour", F.col("_asked")))
        .where(F.col("_place") > 0)
    )
    sim = F.get("_list", (F.col("_place") - 1).cast("int"))["sim"]
    return _summed(found.select("user_id", F.col("_asked").alias("item_id"), (F.col("x") * sim).alias("score")))


def _as_lists(rows: DataFrame, kind: int, item: str, near: str, value: str, hidden: DataFrame | None = None) -> DataFrame:
    """(kind, item_id, near, value): the rows of each item as arrays side by side, with ``hidden`` if items are."""
    columns = [F.col(near).alias("near"), F.col(value).alias("value")]
    if hidden is not None:
        rows = rows.join(hidden.select(F.col("item_id").alias(near), F.lit(True).alias("_hidden")), near, "left")
        columns.append(F.col("_hidden").isNotNull().alias("hidden"))
    lists = rows.groupBy(F.col(item).alias("item_id")).agg(F.collect_list(F.struct(*columns)).alias("_list"))
    names = ("near", "value") if hidden is None else ("near", "value", "hidden")
    return lists.select(F.lit(kind).alias("kind"), "item_id", *[F.col(f"_list.{c}").alias(c) for c in names])


def best_of_blocks(
    history: DataFrame, similar: DataFrame, k: int, scale=None, more=(), plain=None, hidden: DataFrame | None = None
) -> DataFrame:
    """The ``k`` best unseen items by sums of similarities, sessions taken in blocks.

    Items in ``hidden (item_id)`` take their places among the ``k`` but are not returned.
    ``scale``: factor of a session's sum by its number of rows; ``more``: pairs of
    (history -> (user_id, item_id, x), (item_i, item_j, p) lists) whose products are added.
    Sessions longer than a block are scored by ``plain(history)``, pair by pair.
    """
    usual, long = split_long(history)
    blocks = None
    if not more:  # in blocks from the start, so that views are counted where they stay
        usual, blocks = in_blocks(usual.select("user_id", "item_id"))
    factor = F.lit(1.0) if scale is None else scale(F.sum("x").over(Window.partitionBy("user_id")))
    events = weights(usual).select(
        "user_id", F.lit(0).alias("kind"), "item_id", F.col("x").cast("double").alias("x"), factor.alias("scale")
    )
    lists = [_as_lists(similar, 0, "item", "neighbour", "sim", hidden)]
    for kind, (steps, nexts) in enumerate(more, 1):
        of_step = steps(usual).join(events.select("user_id", "scale").distinct(), "user_id")
        events = events.unionByName(
            of_step.select("user_id", F.lit(kind).alias("kind"), "item_id", F.col("x").cast("double").alias("x"), "scale")
        )
        lists.append(_as_lists(nexts, kind, "item_i", "item_j", "p", hidden))
    # written, so that what the pairs of items shuffled is gone before the lists are sent
    best = best_sums(events, [save_scratch(table, "lists") for table in lists], k, blocks)
    if long is None:
        return best
    long = save_scratch(long, "long-sessions")
    rest = top_k(unseen(plain(long), long), k)
    if hidden is not None:
        rest = top_k(rest.drop("rank").join(hidden, "item_id", "left_anti"), k)
    return best.unionByName(rest.select(best.columns))


@dataclass
class Popularity:
    """Items by number of training interactions."""

    train: DataFrame

    def score(self, history, candidates):
        return candidates.select("user_id", "item_id").join(popularity(self.train), "item_id")

    def factors(self):
        return None, popularity(self.train).select("item_id", F.array("score").alias("vector"))

    def top(self, history, k, only=None, wanted=None):
        lists = rank_lists(listed(popularity(self.train), only).withColumn("list_id", F.lit(0)))
        asked = history.select("user_id").distinct().withColumn("list_id", F.lit(0))
        return best_unseen(asked, lists, history.select("user_id", "item_id"), k, shared_list=True, wanted=wanted)

    def ranks(self, history, targets, k):
        return self.top(history, k, wanted=targets)


@dataclass
class Random:
    """A seeded hash of (session, item)."""

    train: DataFrame
    seed: int = 42

    def score(self, history, candidates):
        drawn = draw_unit(self.seed, F.col("user_id"), F.col("item_id"))
        return candidates.select("user_id", "item_id", drawn.alias("score"))

    def top(self, history, k, only=None):
        drawn = draw_items(
            history.select("user_id").distinct(), listed(self.train, only), seen_items(history), k, self.seed
        )
        return drawn.select(
            "user_id",
            "item_id",
            (F.lit(1.0) / F.col("draw")).alias("score"),
            F.col("draw").alias("rank"),
        )


@dataclass
class ItemKNN:
    """Cosine item neighbourhoods (Sarwar et al. 2001)."""

    train: DataFrame
    k: int = 100
    shrink: float = 0.0
    sparse = True

    def all_scores(self, history, only=None):
        similar = item_similarity(self.train, self.k, self.shrink)
        return neighbour_scores(history, listed(similar, only, "neighbour"))

    def score(self, history, candidates):
        return candidate_scores(history, item_similarity(self.train, self.k, self.shrink), candidates)

    def top(self, history, k, only=None, hidden=None):
        similar = without(item_similarity(self.train, self.k, self.shrink), unlisted(self.train, only), "neighbour")
        return best_of_blocks(history, similar, k, plain=lambda long: neighbour_scores(long, similar), hidden=hidden)


@dataclass
class Markov:
    """First-order transitions from the last item."""

    train: DataFrame
    order: tuple = ORDER
    hot: DataFrame | str | None = skew.AUTO

    def _lists(self):
        return transitions(self.train, self.order, self.hot).select(
            F.col("item_i").alias("list_id"),
            F.col("item_j").alias("item_id"),
            F.round("p", PLACES).alias("score"),
        )

    def score(self, history, candidates):
        asked = last_item(history, order=self.order).withColumnRenamed("item_id", "list_id")
        return (
            candidates.select("user_id", "item_id")
            .join(asked, "user_id")
            .join(self._lists(), ["list_id", "item_id"])
            .select("user_id", "item_id", "score")
        )

    def top(self, history, k, only=None, wanted=None):
        asked = last_item(history, order=self.order).withColumnRenamed("item_id", "list_id")
        lists = rank_lists(listed(self._lists(), only))
        return best_unseen(asked, lists, history.select("user_id", "item_id"), k, wanted=wanted)

    def ranks(self, history, targets, k):
        return self.top(history, k, wanted=targets)


@dataclass
class SimilarityMarkov:
    """Item similarity fused with order-L transitions, by counts.

    score = |history|^-alpha * sum of similarities
          + sum over lags l of (1/l) * P(item | item l steps back).
    Similarities are those to the k nearest neighbours; transitions are counted at their own
    lag and are all used.
    """

    train: DataFrame
    k: int = 100
    alpha: float = 0.2
    order_len: int = 1
    order: tuple = ORDER
    hot: DataFrame | str | None = skew.AUTO

    def all_scores(self, history, only=None):
        base = neighbour_scores(history, listed(item_similarity(self.train, self.k), only, "neighbour"))
        length = history.groupBy("user_id").agg(F.count("*").alias("_len"))
        parts = base.join(length, "user_id").select(
            "user_id", "item_id", (F.col("score") * F.pow("_len", F.lit(-self.alpha))).alias("score")
        )
        for lag in range(1, self.order_len + 1):
            nexts = listed(transitions(self.train, self.order, self.hot, lag), only, "item_j")
            steps = last_item(history, lag, self.order).withColumnRenamed("item_id", "item_i")
            parts = parts.unionByName(
                steps.join(nexts, "item_i").select(
                    "user_id", F.col("item_j").alias("item_id"), (F.col("p") / lag).alias("score")
                )
            )
        return _summed(parts)

    def score(self, history, candidates):
        return among(self.all_scores(history), candidates)

    def top(self, history, k, only=None, hidden=None):
        dropped = unlisted(self.train, only)
        similar = without(item_similarity(self.train, self.k), dropped, "neighbour")
        more = []
        for lag in range(1, self.order_len + 1):
            nexts = without(transitions(self.train, self.order, self.hot, lag), dropped, "item_j")

            def steps(rows, lag=lag):
                return last_item(rows, lag, self.order).withColumn("x", F.lit(1.0) / lag)

            more.append((steps, nexts))
        return best_of_blocks(
            history, similar, k, lambda n: F.pow(n, F.lit(-self.alpha)), more, lambda long: self.all_scores(long, only), hidden
        )


class Factorization:
    """Implicit-feedback matrix factorisation (ALS).

    A session is a user of the model, so only sessions with training rows get scores. The
    whole catalogue is ranked by a search for the largest inner products, which leaves a
    session's search as soon as no further item can be among its best.
    """

    def __init__(self, train: DataFrame, rank: int = 64, iterations: int = 10, seed: int = 42):
        self.users = dense_key(train, "user_id", "_user").withColumn("_user", F.col("_user").cast("int"))
        self.items = dense_key(train, "item_id", "_item").withColumn("_item", F.col("_item").cast("int"))
        ratings = weights(train).join(self.users, "user_id").join(self.items, "item_id")
        als = ALS(
            rank=rank,
            maxIter=iterations,
            implicitPrefs=True,
            userCol="_user",
            itemCol="_item",
            ratingCol="x",
            seed=seed,
            coldStartStrategy="drop",
            checkpointInterval=1,
        )
        # Item factors written in every iteration cut the lineage, so that an iteration's shuffles
        # of factors are deleted instead of staying on disk to the end of the fit.
        context = train.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(scratch_folder(train.sparkSession))
        self.model = als.fit(ratings.select("_user", "_item", F.col("x").cast("float")))

    def score(self, history, candidates):
        asked = candidates.select("user_id", "item_id").join(self.users, "user_id").join(self.items, "item_id")
        return self.model.transform(asked).select(
            "user_id", "item_id", F.col("prediction").cast("double").alias("score")
        )

    def factors(self):
        sessions = self.users.join(self.model.userFactors, F.col("_user") == F.col("id"))
        items = self.items.join(self.model.itemFactors, F.col("_item") == F.col("id"))
        return sessions.select("user_id", F.col("features").alias("vector")), items.select("item_id", F.col("features").alias("vector"))

    def top(self, history, k, only=None):
        seen = seen_items(history)
        # as many more as the session has seen, which are left out afterwards
        asked = seen.groupBy("user_id").agg((F.count("*") + k).alias("wanted")).join(self.users, "user_id")
        queries = asked.join(self.model.userFactors, F.col("_user") == F.col("id")).select(
            F.col("user_id").alias("query"), F.col("features").alias("vector"), "wanted"
        )
        items = self.model.itemFactors.join(listed(self.items, only), F.col("_item") == F.col("id")).select(
            F.col("item_id").alias("item"), F.col("features").alias("vector")
        )
        found = largest_products(queries, items).select(F.col("query").alias("user_id"), F.col("item").alias("item_id"), "score")
        return top_k(unseen(found, history), k)


@dataclass
class ScoreTable:
    """Scores computed elsewhere: (user_id, item_id, score)."""

    scores: DataFrame

    def score(self, history, candidates):
        return among(self.scores, candidates)

    def top(self, history, k, only=None):
        return top_k(unseen(listed(self.scores, only), history), k)
