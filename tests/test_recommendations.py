import pytest
from pyspark.sql import functions as F

from sessionloom.operators import browse, recommendations as recs, runs, scorers, session_blocks
from sessionloom.plans.report import benchmark_report
from tests.conftest import rows

SESSION = "user_id string, item_id int, event_ts int, event_id int"


@pytest.fixture(scope="module")
def places(spark):
    data = [
        (1, -20.0, -40.0, 100.0, 2, "A", "x"), (2, -20.1, -40.0, 0.0, 3, "B", "x"), (3, -29.0, -40.0, 300.0, None, None, "y"),
        (4, None, -40.0, 50.0, 1, "A", "x"), (5, -20.05, -40.0, 120.0, 2, "A", "x"),
    ]
    df = spark.createDataFrame(data, "listing_id_numeric int, lat double, lon double, price double, bedrooms int, city string, unit_type string")
    return df.withColumns({c: F.lit(None).cast("double") for c in ("usable_areas", "bathrooms", "parking_spaces", "suites")}).withColumns(
        {"neighborhood": F.lit("n"), "state": F.lit("s")}
    )


def test_last_items_mask_and_cut_before_listing(spark, places):
    history = spark.createDataFrame([("s", 100 + i % 25, i, i) for i in range(25)], SESSION)
    table = spark.createDataFrame(
        [("s", 104, 9.0), ("s", 105, 8.0), ("s", 1, 7.0), ("s", 77, 6.0), ("s", 2, 5.0)], "user_id string, item_id int, score double"
    )
    got = recs.recommend(history, scorers.ScoreTable(table), places, k=3)
    # 105 is masked, 104 is older than the last 20 and takes a place, 104 and 77 have no listing
    assert rows(got, "rank", "item_id") == [(1, 1)]
    full = recs.recommend(history, scorers.ScoreTable(table), places, k=3, refill=True)
    assert rows(full, "rank", "item_id") == [(1, 1), (2, 2)]


@pytest.mark.parametrize("last_n", [4, 20])
def test_sessions_are_cut_only_where_one_is_longer(spark, monkeypatch, last_n):
    """They were ranked by time and shuffled for it even if none is longer."""
    views = [(f"s{u}", (u + i * i) % 7, i, 10 * u + i) for u in range(20) for i in range(2 + u % 5)]
    sessions, cuts, real = spark.createDataFrame(views, SESSION), [], recs.history_cut
    monkeypatch.setattr(recs, "history_cut", lambda rows, n, **by: cuts.append(n) or real(rows, n, **by))
    scorer = scorers.ItemKNN(sessions, 5)
    got = recs.recommend(sessions, scorer, k=3, last_n=last_n)
    assert cuts == ([4] if last_n == 4 else [])
    recent = sessions.where(F.col("event_ts") >= 0) if last_n == 20 else real(sessions, 4)
    assert rows(got, "user_id", "item_id", "rank") == rows(scorer.top(recent, 3), "user_id", "item_id", "rank")


def test_views_are_counted_in_their_block(spark):
    """One shuffle of the events by session and one by block; views were counted in another before."""
    sessions = spark.createDataFrame([(f"s{u}", (u + i) % 5, i, 10 * u + i) for u in range(9) for i in range(3)], SESSION)
    asked, blocks = session_blocks.in_blocks(sessions)
    plan = scorers.weights(asked)._jdf.queryExecution().executedPlan().toString()
    assert blocks == 1 and plan.count("Exchange") == 1


def sample(spark):
    sessions = spark.createDataFrame([("s", 1, 0, 0), ("s", 2, 1, 1), ("s", 1, 2, 2), ("s", 4, 3, 3), ("t", 4, 0, 4)], SESSION)
    best = spark.createDataFrame([("s", 1, 3, 0.9), ("s", 2, 5, 0.5), ("s", 3, 4, 0.1), ("t", 1, 1, 0.3)], "user_id string, rank int, item_id int, score double")
    return sessions, best


def test_distances(spark, places):
    sessions, best = sample(spark)
    got = {(r.user_id, r["rank"]): r for r in recs.recommendation_distances(sessions, best, places).collect()}
    near = got["s", 2]
    assert near.closest_item in (1, 2) and 5.4 < near.min_distance_km < 5.7
    assert 5.4 < near.avg_distance_km < 5.7
    assert 980 < got["s", 1].min_distance_km < 1000 and got["s", 1].closest_item == 2
    far = got["s", 1]
    assert far.avg_distance_km == pytest.approx((2 * (far.min_distance_km + 11.07) + far.min_distance_km) / 3, rel=1e-3)
    assert got["s", 3].avg_distance_km is None and got["t", 1].min_distance_km is None


def test_feature_comparison(spark, places):
    pairs = spark.createDataFrame([(2, 1), (1, 3), (3, 3)], "item1 int, item2 int")
    got = {(r.item1, r.item2, r.feature): r for r in recs.compare_features(pairs, places).collect()}
    assert got[2, 1, "price"].pct_diff == 0.0 and got[2, 1, "price"]["diff"] == 100.0
    assert got[1, 3, "price"].pct_diff == 200.0
    assert (1, 3, "bedrooms") not in got and (1, 3, "suites") not in got
    assert got[3, 3, "city"].match is True and got[1, 3, "city"].match is False


def test_session_against_recommendations(spark, places):
    sessions, best = sample(spark)
    got = {(r.user_id, r.feature): r for r in recs.session_vs_recommendations(sessions, best, places).collect()}
    price = got["s", "price"]
    assert price.session_mean == pytest.approx((100 + 0 + 100 + 50) / 4)
    assert price.session_std == pytest.approx((sum((v - 62.5) ** 2 for v in (100, 0, 100, 50)) / 4) ** 0.5)
    assert price.rec_mean == pytest.approx(470 / 3)
    assert ("s", "parking_spaces") not in got
    cities = {r.user_id: tuple(r)[1:] for r in recs.top_cities(sessions, best, places).collect()}
    assert cities["s"] == ("A", 3, "A", 2)


def test_links_and_points(spark, places):
    sessions, best = sample(spark)
    links = recs.nearest_links(sessions, best, places, k=1)
    assert rows(links, "user_id", "item_id", "views", "rec_item") == [("s", 1, 2, 5), ("s", 2, 1, 5)]
    planar = recs.nearest_links(sessions, best, places, k=1, top=None, metric="planar")
    assert rows(planar, "item_id", "rec_item") == [(1, 5), (2, 5)]
    with pytest.raises(ValueError):
        recs.nearest_links(sessions, best, places, metric="other")
    points = recs.map_points(sessions, best, places)
    assert rows(points.where("kind = 'session' and user_id = 's'"), "place", "item_id") == [(1, 1), (2, 2), (3, 1)]
    first = points.where("kind = 'recommendation' and place = 1 and user_id = 's'").first()
    assert (first.tier, first.page_tier, first["size"], first.radius) == ("red", "green", 600.0, 15.0)


def test_session_list_pages(spark, places):
    data = [(f"s{i:02d}", 1 + i % 5, i * 10 + j, f"u{i}", j) for i in range(12) for j in range(2)]
    df = spark.createDataFrame(data, "session_id string, item_id int, timestamp int, user_id string, event_id int")
    page = browse.list_sessions(df, places, "nonsense", page=99, per_page=5).collect()
    assert [r.session_id for r in page] == ["s01", "s00"]  # clamped to page 3, newest first
    assert (page[0].page, page[0].total_pages, page[0].has_prev, page[0].has_next) == (3, 3, True, False)
    assert page[1].city == "A" and page[1].event_count == 2
    chosen = spark.createDataFrame([("s03",), ("nobody",)], "session_id string")
    detail = browse.session_detail(df, places, chosen)
    assert rows(detail, "session_id", "position", "item_id") == [("s03", 1, 4), ("s03", 2, 4)]


@pytest.mark.parametrize("sort_by", browse.SORT_COLUMNS)
@pytest.mark.parametrize("ascending", [True, False])
def test_pages_are_stretches_of_the_whole_list(spark, places, sort_by, ascending):
    data = [(f"s{i * 37 % 101:03d}" if i else None, 1 + i % 5, i // 7 * 10 + j, f"u{i}", j) for i in range(101) for j in range(1 + i % 3)]
    df = spark.createDataFrame(data, "session_id string, item_id int, timestamp int, user_id string, event_id int")
    index = browse.index_sessions(df, sort_by, ascending)
    assert index.total == 100
    whole = browse.summarize_sessions(df.where("session_id is not null")).collect()
    whole.sort(key=lambda r: r.session_id)
    whole.sort(key=lambda r: r[sort_by], reverse=not ascending)
    if sort_by == "session_id" and not ascending:
        assert whole[0].session_id > whole[1].session_id
    got = [r.session_id for page in range(1, 9) for r in browse.session_page(index, places, page, 13).collect()]
    assert got == [r.session_id for r in whole]
    held = [index.between(a, a + 1) for a in range(100)]
    assert all(len(one.inputFiles()) == 1 for one in held)
    assert index.between(90, 200).count() == 10 and index.between(100, 200).count() == 0


def test_no_sessions_have_one_empty_page(spark, places):
    df = spark.createDataFrame([], "session_id string, item_id int, timestamp int, user_id string, event_id int")
    assert browse.list_sessions(df, places).count() == 0


def test_center_defaults_without_coordinates(spark, places):
    df = spark.createDataFrame([("s", 4), ("t", 1), ("t", 2), ("t", 1)], "session_id string, item_id int")
    got = {r.session_id: (r.center_lat, r.points) for r in browse.session_center(df, places).collect()}
    assert got["s"] == (-14.235, 0)
    assert got["t"] == (pytest.approx(-20.1 / 3 - 40.0 / 3), 3)


def run_table(spark):
    data = [
        ("A_1", "r1", "A", "d", False, 0.1, 0.2), ("A_2", "r2", "A", "d", False, None, None), ("Eval_A_1", "r3", "A", "d", True, 0.3, 0.4),
        ("B_1", "r4", "B", "d", False, 0.2, 0.9), ("B_2", "r5", "B", "d", False, 0.5, 0.1), ("C_1", "r6", "C", "d", False, None, None),
    ]
    return spark.createDataFrame(data, "run_name string, run_id string, model string, dataset string, is_eval boolean, `test_mrr@10` double, `test_hit@5` double")


def test_merge_and_rank_runs(spark, tmp_path):
    tables = benchmark_report(run_table(spark), str(tmp_path))
    merged = {r.model: r for r in tables["results"].collect()}
    assert (merged["A"].run_id, merged["A"].eval_run_id, merged["A"].train_run_id) == ("r3", "r3", "r2")
    assert (merged["B"].run_id, merged["B"].eval_run_id) == ("r5", None)
    assert [r.model for r in tables["ranking"].collect()] == ["B", "A", "C"]
    assert rows(tables["ranking_by_topk"].where("metric = 'hit'"), "rank", "model", "topk") == [(1, "A", 5), (2, "B", 5), (3, "C", 5)]
    with pytest.raises(ValueError):
        runs.rank_models(run_table(spark), "test_none@1")
    assert (tmp_path / "ranking").is_dir()


def test_quartiles_are_exact(spark):
    import numpy as np

    values = [((i * 7919) % 101) / 10 for i in range(53)]
    df = spark.createDataFrame([("m", "d", f"r{i}", v) for i, v in enumerate(values)], "model string, dataset string, run_name string, `test_x@1` double")
    got = runs.metric_quartiles(df).first()
    assert [got[f"p{p}"] for p in (0, 25, 50, 75, 100)] == pytest.approx(list(np.percentile(values, [0, 25, 50, 75, 100])))


def test_pairs_are_no_rows_of_a_shuffle_or_sort(spark, places):
    """Every pair was a row, sorted by recommendation or item, and recommendations were joined twice."""
    sessions, best = sample(spark)
    distances = recs.recommendation_distances(sessions, best, places)
    links = recs.nearest_links(sessions, best, places, k=1, top=None, metric="planar")
    for df in (distances, links):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan
    assert {(r.user_id, r.rank): r.closest_item for r in distances.collect()} == {("s", 1): 2, ("s", 2): 1, ("s", 3): None, ("t", 1): None}
    assert rows(links, "user_id", "item_id", "views", "link", "rank", "rec_item") == [("s", 1, 2, 1, 2, 5), ("s", 2, 1, 1, 2, 5)]


def test_refill_drops_the_few_unlisted_items_instead_of_keeping_the_listed(spark, monkeypatch):
    """Lists of neighbours were shuffled to be compared with all listed items."""
    views = [(f"s{u}", (u + i * i) % 9, i, 10 * u + i) for u in range(30) for i in range(2 + u % 5)]
    sessions, saved, real = spark.createDataFrame(views, SESSION), {}, scorers.save_scratch
    monkeypatch.setattr(scorers, "save_scratch", lambda df, name: saved.setdefault(name, real(df, name)))
    only = spark.range(2, 50).select(F.col("id").cast("int").alias("item_id"))
    scorer = scorers.ItemKNN(sessions, 5)
    got = scorer.top(sessions, 3, only)
    assert rows(saved["unlisted"]) == [(0,), (1,)]
    plain = scorers.top_k(scorers.unseen(scorer.all_scores(sessions, only), sessions), 3)
    assert rows(got, "user_id", "item_id", "rank") == rows(plain, "user_id", "item_id", "rank")


def test_sides_are_shuffled_once_by_session(spark):
    """Rows were counted by session and item, and every feature's row was shuffled once more by value."""
    sessions = spark.createDataFrame([(u, i, 0, 0) for u in range(3) for i in (1, 2, 2)], "user_id long, item_id long, event_ts long, event_id long")
    best = spark.createDataFrame([(u, 1, 3, 1.0) for u in range(3)], "user_id long, rank int, item_id long, score double")
    places = spark.createDataFrame([(i, float(i), i, i, i, float(i), f"c{i}") for i in (1, 2, 3)], f"{recs.LISTING} long, price double, bedrooms int, bathrooms int, parking_spaces int, usable_areas double, city string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (recs.session_vs_recommendations(sessions, best, places), recs.top_cities(sessions, best, places)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 4, plan
            assert found.where("user_id = 1").count() == found.count() / 3 > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    city = recs.top_cities(sessions, best, places).first()
    assert (city.session_city, city.session_count, city.rec_city, city.rec_count) == ("c2", 2, "c3", 1)
