"""Sums of item lists, sessions taken in blocks."""

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import scorers, session_blocks
from tests.conftest import rows


def history(spark):
    return spark.range(900).select(
        (F.col("id") % 61).alias("user_id"),
        F.concat(F.lit("i"), F.pmod(F.xxhash64("id"), F.lit(40))).alias("item_id"),
        F.timestamp_seconds("id").alias("event_ts"),
        F.col("id").alias("event_id"),
    ).unionByName(  # a session longer than the blocks of the tests
        spark.range(150).select(
            F.lit(1000).cast("bigint").alias("user_id"), F.concat(F.lit("i"), F.col("id") % 25).alias("item_id"),
            F.timestamp_seconds("id").alias("event_ts"), (F.col("id") + 1000).alias("event_id"),
        )
    )


@pytest.mark.parametrize("block, only", [(40, True), (131_072, False)])
def test_blocks_give_the_sums_of_all_pairs(spark, monkeypatch, block, only):
    monkeypatch.setattr(session_blocks, "ROWS_A_BLOCK", block)
    monkeypatch.setattr(session_blocks, "ENTRIES_AT_ONCE", 50)
    seen = history(spark)
    known = seen.select("item_id").distinct().where("item_id < 'i30'") if only else None
    for scorer in (scorers.ItemKNN(seen, 7), scorers.SimilarityMarkov(seen, 7, order_len=2, hot=None)):
        plain = scorers.top_k(scorers.unseen(scorer.all_scores(seen, known), seen), 5)
        columns = ("user_id", "item_id", "score", "rank")
        assert rows(scorer.top(seen, 5, known), *columns) == rows(plain, *columns)


def test_entries_of_lists_are_not_shuffled(spark):
    """A row per session, item and neighbour went through two shuffles."""
    seen = history(spark)
    best = scorers.ItemKNN(seen, 30).top(seen, 5)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_no_sessions_and_no_lists(spark):
    seen = history(spark)
    assert scorers.ItemKNN(seen).top(seen.where("false"), 5).count() == 0
    assert scorers.ItemKNN(seen.where("false")).top(seen, 5).count() == 0


def test_hidden_items_take_their_places(spark, monkeypatch):
    """They were taken out by a join and a ranking over all recommendations."""
    monkeypatch.setattr(session_blocks, "ROWS_A_BLOCK", 100)
    seen = history(spark)
    hidden = seen.select("item_id").distinct().where("item_id < 'i15'")
    for scorer in (scorers.ItemKNN(seen, 7), scorers.SimilarityMarkov(seen, 7, order_len=2, hot=None)):
        plain = scorers.top_k(scorers.unseen(scorer.all_scores(seen), seen), 5).drop("rank")
        plain = scorers.top_k(plain.join(hidden, "item_id", "left_anti"), 5)
        columns = ("user_id", "item_id", "score", "rank")
        assert rows(scorer.top(seen, 5, hidden=hidden), *columns) == rows(plain, *columns)


@pytest.mark.parametrize("known", ["item_id < 'i13'", "true"])
def test_merged_blocks_give_the_same_sums(spark, monkeypatch, known):
    """Every block of ROWS_A_BLOCK got its own copy of an item's list; few items let blocks be merged."""
    seen = history(spark).where("user_id < 1000").where(known)
    want = rows(scorers.ItemKNN(seen, 7).top(seen, 5))
    monkeypatch.setattr(session_blocks, "ROWS_A_BLOCK", 10)
    monkeypatch.setattr(scorers, "split_long", lambda history: (history, None))
    assert rows(scorers.ItemKNN(seen, 7).top(seen, 5)) == want


@pytest.mark.parametrize("long", [128, 3])
def test_pairs_cross_in_one_shuffle_and_hot_items_too(spark, monkeypatch, long):
    """Pairs were shuffled by pair and then, both ways round, by item."""
    monkeypatch.setattr(scorers, "LONG_SESSION", long)
    seen = history(spark).where("user_id < 1000")
    usual = rows(scorers.item_similarity(seen, 5))
    plan = scorers.co_occurrence(seen)._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in plan
    monkeypatch.setattr(scorers.skew, "HOT_FLOOR", 20)
    assert rows(scorers.item_similarity(seen, 5)) == usual
