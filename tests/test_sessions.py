import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import sessions, skew
from sessionloom.operators.evaluation import split_leave_one_out
from tests.conftest import rows

EVENTS = "user_id string, item_id int, event_ts timestamp, event_id bigint"


def events(spark, data):
    df = spark.createDataFrame(data, "user_id string, item_id int, ms bigint, event_id bigint")
    return df.select("user_id", "item_id", F.timestamp_millis("ms").alias("event_ts"), "event_id")


def test_only_consecutive_repeats_go(spark):
    items = [1, 1, 2, 1, 1, 3]
    df = events(spark, [("s", item, i * 1000, i) for i, item in enumerate(items)])
    kept = sessions.drop_repeats(df, hot=None).orderBy("event_id")
    assert [r.item_id for r in kept.collect()] == [1, 2, 1, 3]


def test_milliseconds_and_event_id_order_one_second(spark):
    df = events(spark, [("s", 1, 900, 5), ("s", 2, 100, 9), ("s", 1, 50, 1), ("s", 2, 100, 8)])
    assert rows(sessions.drop_repeats(df, hot=None), "event_id") == [(1,), (5,), (8,)]


def test_interactions_drop_null_items_and_keep_user(spark):
    df = spark.createDataFrame(
        [("s", "u", 7, 1500, 1), ("s", "u", None, 1600, 2), (None, "u", 8, 1700, 3)],
        "session_id string, user_id string, listing_id int, ms bigint, event_id bigint",
    ).withColumn("event_ts", F.timestamp_millis("ms"))
    got = sessions.prepare_sessions(df, hot=None).collect()
    assert [(r.user_id, r.original_user_id, r.item_id, r.timestamp) for r in got] == [("s", "u", 7, 1)]


def sized(spark, sizes):
    return events(spark, [(f"s{n}", i, i * 1000, i) for n in sizes for i in range(n)])


def test_length_limits_keep_the_newest(spark):
    kept = sessions.limit_sessions(sized(spark, [1, 2, 50, 51]))
    counts = {r.user_id: (r.n, r.first) for r in kept.groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("item_id").alias("first")).collect()}
    assert counts == {"s2": (2, 0), "s50": (50, 0), "s51": (50, 1)}


def test_minimum_above_maximum_judges_the_whole_session(spark):
    kept = sessions.limit_sessions(sized(spark, [3, 5]), min_length=4, max_length=2)
    assert rows(kept, "user_id", "item_id") == [("s5", 3), ("s5", 4)]


def test_rare_item_may_leave_a_repeat_behind(spark):
    data = [("a", 1, 0, 0), ("a", 9, 1, 1), ("a", 1, 2, 2), ("b", 1, 0, 3), ("b", 2, 1, 4), ("c", 2, 0, 5), ("c", 1, 1, 6)]
    kept = sessions.sessions_from(events(spark, data), 2, 50, 2, hot=None)
    assert rows(kept.where("user_id = 'a'"), "item_id", "event_id") == [(1, 0), (1, 2)]


def test_presets_differ_by_gallery(spark):
    df = spark.createDataFrame([("GalleryClicked",), ("LeadClicked",), ("RankingRendered",)], "event_type string")
    assert sessions.interaction_events(df, "events").count() == 2
    assert sessions.interaction_events(df, "sessions").count() == 1


def test_window_is_inclusive(spark):
    df = spark.createDataFrame(
        [("2024-03-01", "SALE"), ("2024-04-01", "SALE"), ("2024-04-02", "SALE"), ("2024-03-05", "RENT")],
        "dt string, business_type string",
    )
    assert sessions.in_window(df, "2024-03-01", "2024-04-01").count() == 2


def skewed(spark, seed, n=3000):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        user = "hot" if rng.random() < 0.6 else f"u{rng.randrange(200)}"
        data.append((user, rng.randrange(4), rng.randrange(50) ** 2 * 40, i))
    return events(spark, data)


@pytest.mark.parametrize("floor", [20, 300])
def test_sliced_sessions_equal_plain_windows(spark, floor):
    df = skewed(spark, floor)
    hot = skew.hot_keys(df, "user_id", floor=floor)
    assert "hot" in {r.user_id for r in hot.collect()}
    order = ("event_ts", "event_id")
    for descending in (False, True):
        plain = skew.with_position(df, "user_id", order, "at", descending, hot=None)
        sliced = skew.with_position(df, "user_id", order, "at", descending, hot=hot)
        assert rows(plain) == rows(sliced)
    assert rows(sessions.drop_repeats(df, hot=None)) == rows(sessions.drop_repeats(df, hot=hot))
    assert rows(sessions.sessions_from(df, 2, 50, 5, hot=None)) == rows(
        sessions.sessions_from(df, 2, 50, 5, hot=hot)
    )
    assert rows(split_leave_one_out(df, hot=None)) == rows(split_leave_one_out(df, hot=hot))


def test_sliced_lag_keeps_null_values(spark):
    df = events(spark, [("hot", None if i % 3 else i % 2, i * 1000, i) for i in range(60)])
    hot = skew.hot_keys(df, "user_id", floor=10)
    order = ("event_ts", "event_id")
    plain = skew.with_previous(df, "user_id", order, "item_id", "prev", hot=None).orderBy("event_id")
    sliced = skew.with_previous(df, "user_id", order, "item_id", "prev", hot=hot).orderBy("event_id")
    assert plain.collect() == sliced.collect()


def test_a_burst_in_one_instant_is_cut_too(spark):
    df = events(spark, [("hot", i % 3, 7_000, i) for i in range(20_000)] + [("u", 1, 7_000, 30_000), ("u", 1, 7_000, 30_001)])
    hot = skew.hot_keys(df, "user_id", floor=4_000)
    order = ("event_ts", "event_id")
    _, sliced = skew.split_hot(df, hot, "user_id", order)
    sizes = [r["count"] for r in sliced.groupBy(skew.SLICE).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4_000
    assert rows(skew.with_position(df, "user_id", order, "at", hot=None)) == rows(skew.with_position(df, "user_id", order, "at", hot=hot))
    assert rows(sessions.drop_repeats(df, hot=None)) == rows(sessions.drop_repeats(df, hot=hot))


def test_core_is_peeled_to_its_fixed_point(spark):
    rng = random.Random(3)
    data = [(f"u{rng.randrange(60)}", rng.randrange(40), i, i) for i in range(260)] + [(f"v{k}", 100 + k + j, k, 1_000 + 2 * k + j) for k in range(12) for j in (0, 1)]
    df = events(spark, data)
    want = [(u, i, e) for u, i, _, e in data]
    while True:
        users, items = Counter(u for u, _, _ in want), Counter(i for _, i, _ in want)
        kept = [(u, i, e) for u, i, e in want if users[u] >= 3 and items[i] >= 4]
        if len(kept) == len(want):
            break
        want = kept
    got = sessions.stable_core(df, 3, 4)
    assert got.columns == df.columns
    assert rows(got, "user_id", "item_id", "event_id") == sorted(want) and want
    assert rows(sessions.stable_core(df, 2, 2), "event_id")  # a chain that goes link by link
    assert sessions.stable_core(df, 2, 2).where("user_id like 'v%'").count() == 0
    assert sessions.stable_core(df, 50, 50).count() == 0


def test_hot_key_table_stays_small(spark):
    df = skewed(spark, 1)
    hot = skew.hot_keys(df, "user_id", floor=100).collect()
    assert len(hot) == 1 and hot[0].parts <= skew.SLICES * 3000 / 100
    assert skew.hot_keys(df, "user_id") is None


def test_no_adjacent_repeats_and_lengths_in_range(spark):
    kept = sessions.sessions_from(skewed(spark, 5), 2, 10, 1)
    sizes = [r["count"] for r in kept.groupBy("user_id").count().collect()]
    assert all(2 <= n <= 10 for n in sizes)
    order = ("event_ts", "event_id")
    again = skew.with_previous(kept, "user_id", order, "item_id", "prev", hot=None)
    assert again.where("prev = item_id").count() == 0


def test_repeats_and_lengths_share_one_shuffle(spark):
    df = skewed(spark, 2)
    plan = sessions.limit_sessions(sessions.drop_repeats(df, hot=None))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in text


def test_left_lookup_spreads_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(200)] + [("a", 1), ("z", 2)], "k string, v int")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "k string, w int")
    got = skew.left_lookup(df, table, "k")
    assert got.count() == 202
    assert rows(got.where("k is not null"), "k", "w") == [("a", 10), ("z", None)]


def test_funnel_counts_each_step(spark):
    first = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "session_id int, listing_id int")
    report = sessions.funnel_report([("all", first), ("one", first.where("session_id = 1")), ("none", first.where("false"))])
    got = [(r.step, r.rows, r.sessions, r["items"], r.rows_share) for r in report.orderBy("step").collect()]
    assert got[0] == (0, 3, 2, 2, None)
    assert got[1][:4] == (1, 2, 1, 2) and abs(got[1][4] - 2 / 3) < 1e-12
    assert got[2] == (2, 0, 0, 0, 0.0)


def test_funnel_of_sessions_equals_its_steps(spark):
    rng = random.Random(5)
    events = [
        (
            rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(["SALE", "SALE", "RENT", None]),
            rng.choice(["a", "a", "b", None]), rng.choice(["2024-01-01", "2024-01-02", "2024-02-01"]), n // 3 if n % 17 else None, n,
        )
        for n in range(1200)
    ]
    df = spark.createDataFrame(
        events, "session_id int, listing_id int, business_type string, event_type string, dt string, ts int, event_id int"
    ).select("*", F.timestamp_seconds("ts").alias("event_ts"), F.lit(None).cast("string").alias("user_id"))
    listings = spark.createDataFrame([(i,) for i in (*range(8), 3)], "listing_id_numeric int")
    got = sessions.session_funnel(df, "2024-01-01", "2024-01-31", listings, types=("a",), min_length=3, max_length=6, support=7)
    window = sessions.in_window(df, "2024-01-01", "2024-01-31", None)
    sale = window.where("business_type = 'SALE'")
    known = sale.where("listing_id < 8")
    typed = known.where("event_type = 'a'")
    distinct = sessions.drop_repeats(sessions.to_interactions(typed))
    sized = sessions.limit_sessions(distinct, 3, 6)
    frequent = sessions.min_support(sized, 7)
    final = sessions.limit_sessions(frequent, 3, 6)
    want = []
    for step in (window, sale, known, typed, distinct, sized, frequent, final):
        want.append((step.count(), step.agg(F.count_distinct("session_id")).first()[0], step.agg(F.count_distinct("listing_id")).first()[0]))
    assert [(r["rows"], r["sessions"], r["items"]) for r in got.orderBy("step").collect()] == want
    assert len(set(want)) == 8
    plain = sessions.session_funnel(df.where("false"), "2024-01-01", "2024-01-31", business=None)
    assert [r["rows"] for r in plain.collect()] == [0] * 8


@pytest.mark.parametrize("support", [1, 7, 40, 1_000])
def test_rare_items_are_looked_up_and_not_shuffled(spark, support):
    """The second limit sorted and shuffled all sessions again."""
    df = spark.range(900).select(
        F.when(F.col("id") % 11 != 0, F.col("id") % 61).alias("user_id"),
        F.when(F.col("id") % 13 != 0, F.floor(F.sqrt(F.pmod(F.xxhash64("id"), F.lit(900))))).alias("item_id"),
        F.timestamp_seconds("id").alias("event_ts"),
        F.col("id").alias("event_id"),
    )
    for low, high in ((2, 9), (9, 9), (4, 3)):
        want = sessions.sessions_from(df, low, high, support, hot=None, written=False)
        got = sessions.sessions_from(df, low, high, support, hot=None)
        assert rows(got.fillna(-1)) == rows(want.fillna(-1))
        if low <= high:
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_what_falls_out_is_looked_up_without_a_shuffle_of_the_rows(spark):
    """All rows were shuffled by item and by session to be held against everything that stays."""
    views = [(f"s{u}", (u + i) % 5, i, 10 * u + i) for u in range(9) for i in range(1 + u % 4)] + [("s1", 99, 5, 900), (None, 1, 0, 901)]
    df = spark.createDataFrame(views, "user_id string, item_id int, event_ts int, event_id int")
    core = sessions.stable_core(df, 2, 3)
    assert "Exchange hashpartitioning" not in core._jdf.queryExecution().executedPlan().toString()
    left = views[:-1]
    while True:
        many, long = Counter(v[1] for v in left), Counter(v[0] for v in left)
        kept = [v for v in left if many[v[1]] >= 3 and long[v[0]] >= 2]
        if len(kept) == len(left):
            break
        left = kept
    assert left and rows(core) == sorted(left)
