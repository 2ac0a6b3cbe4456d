import math
import random
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import evaluation, inner_products, ranked_lists, sampled_ranks, scorers, tuning
from sessionloom.operators.sampling import STEP, draw_items
from sessionloom.plans.benchmark import benchmark_table
from tests.conftest import rows

SCHEMA = "user_id bigint, item_id bigint, event_ts bigint, event_id bigint"


@pytest.fixture(scope="module")
def clicks():
    rng = random.Random(11)
    out = []
    for u in range(60):
        for i in range(rng.randrange(1, 9)):
            out.append((u, int(rng.random() ** 2 * 25), i, u * 100 + i))
    return out


@pytest.fixture(scope="module")
def frame(spark, clicks):
    return spark.createDataFrame(clicks, SCHEMA)


def histories(clicks):
    found = defaultdict(list)
    for u, item, _, _ in sorted(clicks, key=lambda c: (c[0], c[2], c[3])):
        found[u].append(item)
    return found


def brute_similarity(clicks, k, shrink):
    counts = Counter((u, i) for u, i, _, _ in clicks)
    norm = defaultdict(float)
    by_user = defaultdict(dict)
    for (u, i), x in counts.items():
        norm[i] += x * x
        by_user[u][i] = x
    dot = defaultdict(float)
    for items in by_user.values():
        for i, x in items.items():
            for j, y in items.items():
                if i != j:
                    dot[i, j] += x * y
    near = defaultdict(list)
    for (i, j), d in dot.items():
        near[i].append((-d / (math.sqrt(norm[i]) * math.sqrt(norm[j]) + shrink), j))
    return {i: [(j, -s) for s, j in sorted(v)[:k]] for i, v in near.items()}


def ordered(scores, seen, k):
    best = sorted((-round(s, 9), i) for i, s in scores.items() if i not in seen)[:k]
    return [(i, round(-s, 6)) for s, i in best]


def as_lists(top):
    found = defaultdict(list)
    for r in top.orderBy("user_id", "rank").collect():
        found[r.user_id].append((r.item_id, round(r.score, 6)))
    return dict(found)


@pytest.mark.parametrize("longest", [8, None])
def test_item_similarity_equals_brute_force(spark, clicks, frame, longest, monkeypatch):
    monkeypatch.setattr(scorers, "LONG_SESSION", 3)  # several blocks per session
    got = defaultdict(list)
    if longest:
        monkeypatch.setattr(scorers, "LONG_SESSION", 100)
    for r in scorers.item_similarity(frame, 5, 2.0).orderBy("item", "rank").collect():
        got[r["item"]].append((r.neighbour, round(r.sim, 9)))
    want = {i: [(j, round(s, 9)) for j, s in v] for i, v in brute_similarity(clicks, 5, 2.0).items()}
    assert dict(got) == want


def test_neighbour_scorer_equals_brute_force(spark, clicks, frame):
    near = brute_similarity(clicks, 6, 0.0)
    want = {}
    for u, items in histories(clicks).items():
        scores = defaultdict(float)
        for i in items:
            for j, s in near.get(i, []):
                scores[j] += s
        best = ordered(scores, items, 4)
        if best:
            want[u] = best
    assert as_lists(scorers.ItemKNN(frame, 6).top(frame, 4)) == want


@pytest.mark.parametrize(
    "build",
    [
        scorers.Popularity, lambda t: scorers.ItemKNN(t, 6), scorers.Markov,
        lambda t: scorers.SimilarityMarkov(t, 6, order_len=2), lambda t: scorers.Factorization(t, 4, 2),
        lambda t: scorers.ScoreTable(t.select("user_id", (F.col("item_id") + 1).alias("item_id")).distinct().withColumn("score", F.lit(1.0))),
    ],
    ids=["pop", "knn", "markov", "fused", "als", "table"],
)
def test_only_some_items_are_ranked(spark, clicks, frame, build):
    some = sorted({i for _, i, _, _ in clicks})[::3]
    only = spark.createDataFrame([(i,) for i in some], frame.select("item_id").schema)
    scorer = build(frame)
    want = {u: kept for u, all_of in as_lists(scorer.top(frame, 1_000)).items() if (kept := [r for r in all_of if r[0] in some][:4])}
    assert want and as_lists(scorer.top(frame, 4, only)) == want


def test_only_some_items_are_drawn(spark, clicks, frame):
    some = sorted({i for _, i, _, _ in clicks})[::3]
    only = spark.createDataFrame([(i,) for i in some], frame.select("item_id").schema)
    got = as_lists(scorers.Random(frame).top(frame, 1_000, only))
    for user, items in histories(clicks).items():
        assert sorted(i for i, _ in got.get(user, [])) == sorted(set(some) - set(items))


def test_popularity_lists_equal_brute_force(spark, clicks, frame):
    counts = Counter(i for _, i, _, _ in clicks)
    want = {u: ordered(counts, items, 5) for u, items in histories(clicks).items()}
    assert as_lists(scorers.Popularity(frame).top(frame, 5)) == want


def test_popularity_beyond_the_broadcast_head(spark, clicks, frame, monkeypatch):
    from sessionloom.operators import ranked_lists

    want = as_lists(scorers.Popularity(frame).top(frame, 5))
    monkeypatch.setattr(ranked_lists, "HEAD", 3)
    assert as_lists(scorers.Popularity(frame).top(frame, 5)) == want


def test_markov_lists_equal_brute_force(spark, clicks, frame):
    moves = defaultdict(Counter)
    for items in histories(clicks).values():
        for a, b in zip(items, items[1:]):
            moves[a][b] += 1
    want = {}
    for u, items in histories(clicks).items():
        total = sum(moves[items[-1]].values())
        best = ordered({j: n / total for j, n in moves[items[-1]].items()}, items, 3)
        if best:
            want[u] = best
    assert as_lists(scorers.Markov(frame).top(frame, 3)) == want


def test_draws_follow_the_hash_and_skip_excluded(spark, clicks, frame):
    items = sorted({i for _, i, _, _ in clicks})
    want = set()
    for u, seen in histories(clicks).items():
        kept = []
        for j in range(11):
            at = int(md5(f"7|{u}|{j}".encode()).hexdigest()[:8], 16) % len(items)
            if items[at] not in seen and items[at] not in kept:
                kept.append(items[at])
        start = int(md5(f"7|{u}|walk".encode()).hexdigest()[:8], 16) % len(items)
        for i in range(len(items)):
            item = items[(start + i * STEP) % len(items)]
            if item not in seen and item not in kept:
                kept.append(item)
        assert len(kept) == len(set(items) - set(seen))
        want |= {(u, i, n + 1) for n, i in enumerate(kept[:5])}
    got = draw_items(frame.select("user_id").distinct(), frame, scorers.seen_items(frame), 5, seed=7)
    assert set(rows(got, "user_id", "item_id", "draw")) == want


def test_split_sizes(spark):
    data = [(n, i, i, i) for n in (1, 2, 3, 5) for i in range(n)]
    got = evaluation.split_leave_one_out(spark.createDataFrame(data, SCHEMA))
    parts = {n: [] for n in (1, 2, 3, 5)}
    for r in got.orderBy("user_id", "item_id").collect():
        parts[r.user_id].append(r.part)
    assert parts == {
        1: ["train"],
        2: ["train", "test"],
        3: ["train", "valid", "test"],
        5: ["train", "train", "train", "valid", "test"],
    }


def test_metrics_of_known_ranks(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, 6), (4, 20), (5, 21), (6, None)], "user_id int, rank int")
    got = {(r.metric, r.k): r.value for r in evaluation.metrics_at_k(df).collect()}
    assert [got["hit", k] for k in (5, 10, 20)] == [2 / 6, 3 / 6, 4 / 6]
    assert all(got["hit", k] == got["recall", k] for k in (5, 10, 20))
    assert got["mrr", 10] == pytest.approx((1 + 1 / 5 + 1 / 6) / 6)
    assert got["ndcg", 20] == pytest.approx(sum(1 / math.log2(r + 1) for r in (1, 5, 6, 20)) / 6)
    for m in evaluation.METRICS:
        assert 0 <= got[m, 5] <= got[m, 10] <= got[m, 20] <= 1


def test_several_positives(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (1, None)], "user_id int, rank int")
    got = {(r.metric, r.k): r.value for r in evaluation.metrics_at_k(df, (2, 5)).collect()}
    assert got["recall", 2] == pytest.approx(1 / 3) and got["recall", 5] == pytest.approx(2 / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert got["ndcg", 5] == pytest.approx((1 + 1 / 2) / ideal)


def test_external_scores_and_modes(spark, frame):
    split = evaluation.split_leave_one_out(frame)
    _, _, targets = evaluation.evaluation_parts(split)
    perfect = targets.withColumn("score", F.lit(1.0))
    for mode in ("full", "sampled"):
        table = evaluation.evaluate(lambda train: scorers.ScoreTable(perfect), split, "external", mode=mode)
        seen_before = targets.join(split.where("part <> 'test'").select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
        values = {r.value for r in table.collect()}
        if mode == "sampled":
            assert values == {1.0}
        else:  # a target the session has seen before is masked
            share = 1 - seen_before.select("user_id").distinct().count() / targets.count()
            assert all(v == pytest.approx(share) for v in values)


def test_a_failing_model_is_a_row(spark, frame):
    def broken(train):
        raise RuntimeError("no model")

    table = benchmark_table({"Broken": broken, "Pop": scorers.Popularity}, evaluation.split_leave_one_out(frame))
    bad = table.where("status = 'failed'").collect()
    assert [(r.model, r.error) for r in bad] == [("Broken", "no model")]
    assert table.where("model = 'Pop'").count() == 12


def test_als_under_the_sampled_protocol(spark, frame):
    split = evaluation.split_leave_one_out(frame)
    table = evaluation.evaluate(
        lambda train: scorers.Factorization(train, rank=4, iterations=2), split, "ALS", mode="sampled", n_negatives=10
    )
    assert all(0 <= r.value <= 1 for r in table.collect())


def test_als_ranks_equal_brute_force_from_the_factors(spark, clicks, frame):
    """Ranks of the test items among sampled ones, and the ranking of the whole catalogue."""
    split = evaluation.split_leave_one_out(frame)
    train, history, targets = evaluation.evaluation_parts(split)
    model = scorers.Factorization(train, rank=4, iterations=3)
    users, items = ({r[0]: r[1] for r in t.collect()} for t in (model.users, model.items))
    factors = [{r.id: np.array(r.features) for r in t.collect()} for t in (model.model.userFactors, model.model.itemFactors)]

    def product(u, i):
        return float(factors[0][users[u]] @ factors[1][items[i]])

    drawn = evaluation.negatives(targets, history, split, 10)
    offered = defaultdict(list)
    for r in targets.union(drawn.select("user_id", "item_id")).collect():
        if r.user_id in users and r.item_id in items:
            offered[r.user_id].append((-round(product(r.user_id, r.item_id), 5), r.item_id))
    got = evaluation.ranks_sampled(model, history, targets, drawn, 11).collect()
    wrong = 0
    for r in got:
        order = [i for _, i in sorted(offered[r.user_id])]
        want = order.index(r.item_id) + 1 if r.item_id in order else None
        wrong += want != r["rank"]
    assert len(got) == targets.count() and wrong <= 1  # predictions are of single precision

    seen = histories([(r.user_id, r.item_id, r.event_ts, r.event_id) for r in history.collect()])
    want = {}
    for u in users:
        order = sorted((-round(product(u, i), 9), i) for i in items if i not in seen[u])[:3]
        want[u] = [i for _, i in order]
    found = defaultdict(list)
    for r in model.top(history, 3).orderBy("user_id", "rank").collect():
        found[r.user_id].append(r.item_id)
    assert dict(found) == {u: x for u, x in want.items() if x}


@pytest.mark.parametrize("blocks", [(4096, 256), (3, 2)])
def test_largest_products_equal_brute_force_and_stop_early(spark, blocks):
    draw = np.random.default_rng(4)
    items = [(i, (draw.integers(-3, 4, 5) * (10.0 if i < 20 else 0.1)).tolist()) for i in range(200)]
    queries = [(f"q{i}", draw.integers(-3, 4, 5).astype(float).tolist(), int(draw.integers(0, 12))) for i in range(30)]
    queries += [("none", [0.0] * 5, 4), ("all", [1.0] * 5, 300)]
    got = defaultdict(list)
    found = inner_products.largest_products(
        spark.createDataFrame(queries, "query string, vector array<double>, wanted int"),
        spark.createDataFrame(items, "item bigint, vector array<double>").repartition(3), *blocks,
    )
    for r in found.collect():
        got[r.query].append((-r.score, r.item))
    for name, q, wanted in queries:
        want = sorted((-round(float(np.dot(q, v)), 9) + 0.0, i) for i, v in items)[:wanted]
        assert sorted((s + 0.0, i) for s, i in got[name]) == want


@pytest.mark.parametrize("build", [
    scorers.Popularity, lambda train: scorers.ItemKNN(train, 3), scorers.Markov, scorers.Random,
    lambda train: scorers.Factorization(train, rank=4, iterations=2),
])
def test_uniform_ranks_equal_those_of_written_draws(spark, frame, build):
    split = evaluation.split_leave_one_out(frame)
    train, history, targets = evaluation.evaluation_parts(split)
    model = build(train)
    drawn = evaluation.negatives(targets, history, split, 10)
    want = rows(evaluation.ranks_sampled(model, history, targets, drawn, 4), "user_id", "item_id", "rank")
    assert rows(evaluation.ranks_uniform(model, history, targets, split, 10, depth=4), "user_id", "item_id", "rank") == want


def test_draws_of_factors_are_not_shuffled_and_sparse_scorers_draw_little(spark, tmp_path):
    """Draws were rows that met their items in a shuffle, and were made for sessions without evidence."""
    item = lambda u, i: 1_000 + 5 * u + i if u % 10 else (u // 10 + i) % 5
    views = [(u, item(u, i), f"2024-01-01 00:00:0{i}", 5 * u + i) for u in range(200) for i in range(5)]
    frame = spark.createDataFrame(views, "user_id bigint, item_id bigint, event_ts string, event_id bigint")
    split = evaluation.split_leave_one_out(frame, hot=None)
    train, history, targets = evaluation.evaluation_parts(split)
    plan = evaluation.ranks_uniform(scorers.Popularity(train), history, targets, split, 50)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan.lower()
    seen = []
    real = evaluation.negatives
    evaluation.negatives = lambda asked, *a: seen.append(asked.count()) or real(asked, *a)
    try:
        ranks = evaluation.ranks_uniform(scorers.ItemKNN(train), history, targets, split, 50).collect()
    finally:
        evaluation.negatives = real
    assert len(ranks) == 200 and seen == [20] and sum(r["rank"] is not None for r in ranks) == 20


@pytest.mark.parametrize("entries", [1, 7, 1_000])
def test_places_are_ranked_in_pieces(spark, entries, monkeypatch):
    for name, value in (("ITEM_BLOCK", 3), ("PRODUCTS_AT_ONCE", 2), ("ITEMS_A_FILE", 4)):
        monkeypatch.setattr(sampled_ranks, name, value)
    draw = np.random.default_rng(1)
    items = [(p, [float(draw.integers(0, 4)), float(draw.integers(0, 4))]) for p in range(1, 21) if p % 6]
    asked = []
    for u in range(30):
        places = draw.permutation(20)[: draw.integers(1, 12)] + 1
        at = int(draw.integers(0, 3))
        asked.append((f"u{u}", [1.0, float(u % 3)], places[:at].tolist(), [f"i{p}" for p in places[:at]], places[at:].tolist()))
    table = spark.createDataFrame(asked, "user_id string, vector array<double>, targets array<bigint>, names array<string>, drawn array<bigint>")
    known = spark.createDataFrame(items, "place bigint, vector array<double>").repartition(3)
    want, vectors = [], dict(items)
    for u, q, own, names, other in asked:
        order = sorted((p for p in own + other if p in vectors), key=lambda p: (-np.dot(q, vectors[p]), p))[:3]
        want += [(u, f"i{p}", order.index(p) + 1) for p in own if p in order]
    assert rows(sampled_ranks.ranks_of_places(table.repartition(2), known, 3, entries)) == sorted(want)


def test_grid_draws_only_for_sessions_with_evidence(spark, monkeypatch):
    item = lambda u, i: 1_000 + 5 * u + i if u % 10 else (u // 10 + i) % 5
    views = [(u, item(u, i), f"2024-01-01 00:00:0{i}", 5 * u + i) for u in range(100) for i in range(5)]
    frame = spark.createDataFrame(views, "user_id bigint, item_id bigint, event_ts string, event_id bigint")
    split, seen, real = evaluation.split_leave_one_out(frame, hot=None), [], tuning.negatives
    monkeypatch.setattr(tuning, "negatives", lambda asked, *a: seen.append(asked.count()) or real(asked, *a))
    best = tuning.tune_item_knn(split, ks=(5,), shrinks=(0.0,), n_negatives=10).first()
    one = evaluation.evaluate(lambda train: scorers.ItemKNN(train, 5), split, "m", on="valid", mode="sampled", n_negatives=10, cutoffs=(10,))
    assert seen == [10] and best.mrr == pytest.approx(one.where("metric = 'mrr'").first().value) and 0 < best.mrr <= 0.1


def test_grid_equals_single_evaluations(spark, frame):
    split = evaluation.split_leave_one_out(frame)
    grid = tuning.tune_item_knn(split, ks=(2, 5), shrinks=(0.0, 10.0), n_negatives=10)
    got = {(r.k, r.shrink): r.mrr for r in grid.collect()}
    for (k, shrink), value in got.items():
        one = evaluation.evaluate(
            lambda train: scorers.ItemKNN(train, k, shrink), split, "m", on="valid", mode="sampled",
            n_negatives=10, cutoffs=(10,),
        )
        assert value == pytest.approx(one.where("metric = 'mrr'").first().value)
    assert len(got) == 4


def test_random_parameter_table(spark):
    space = {
        "k": {"type": "choice", "values": [10, 50]},
        "rate": {"type": "loguniform", "min": 0.001, "max": 0.1},
        "drop": {"type": "uniform", "min": 0.1, "max": 0.5},
        "depth": {"type": "randint", "min": 1, "max": 4},
        "step": {"type": "quniform", "min": 0, "max": 1, "q": 0.25},
    }
    table = tuning.random_table(spark, space, 30)
    assert table.collect() == tuning.random_table(spark, space, 30).collect()
    for r in table.collect():
        assert r.k in (10, 50) and 0.001 <= r.rate <= 0.1 and 0.1 <= r.drop <= 0.5
        assert r.depth in (1, 2, 3) and r.step * 4 == int(r.step * 4)
    with pytest.raises(ValueError):
        tuning.random_table(spark, {"x": {"type": "other", "min": 0, "max": 1}})


@pytest.mark.parametrize("long", [2, 10_000])
def test_draws_of_long_sessions_and_small_catalogues(spark, clicks, frame, long, monkeypatch):
    monkeypatch.setattr("sessionloom.operators.sampling.LONG", long)
    got = draw_items(frame.select("user_id").distinct(), frame, scorers.seen_items(frame), 9, seed=3)
    seen = {u: set(i) for u, i in histories(clicks).items()}
    items = {i for _, i, _, _ in clicks}
    drawn = defaultdict(dict)
    for r in got.collect():
        drawn[r.user_id][r.draw] = r.item_id
    for u, of in seen.items():
        assert set(drawn[u]) == set(range(1, min(9, len(items - of)) + 1))
        assert not of & set(drawn[u].values()) and len(set(drawn[u].values())) == len(drawn[u])


def test_draws_are_not_written(spark, frame, monkeypatch):
    """201 places of a session were written, and its array went through two more shuffles."""
    from sessionloom.operators import sampling

    saved, save = [], sampling.save_scratch
    monkeypatch.setattr(sampling, "save_scratch", lambda df, name: saved.append(df.columns) or save(df, name))
    draw_items(frame.select("user_id").distinct(), frame, scorers.seen_items(frame), 5, seed=7)
    assert all("_places" not in columns and "_kept" not in columns for columns in saved)


@pytest.mark.parametrize("build", [scorers.Popularity, scorers.Markov])
def test_listed_ranks_are_no_rows_of_a_shuffle(spark, monkeypatch, build):
    """Each session's ranks were rows, shuffled to leave seen items out and again to be counted."""
    rng = random.Random(3)
    views = [
        (None if u == 7 else f"s{u}", None if rng.random() < 0.03 else int(rng.paretovariate(0.8)) % 40, i, 100 * u + i)
        for u in range(40) for i in range(rng.randrange(1, 20))
    ]
    history = spark.createDataFrame(views, "user_id string, item_id int, event_ts int, event_id int")
    targets = spark.createDataFrame([(f"s{u}", i) for u in range(45) for i in (u % 5, 9)], "user_id string, item_id int")
    scorer = build(history)

    def results():
        best = scorer.top(history, 5)
        return best, [sorted(map(repr, df.collect())) for df in (best, evaluation.ranks_full(scorer, history, targets, 8))]

    best, short = results()
    assert "LeftAnti" not in best._jdf.queryExecution().executedPlan().toString()
    assert any("rank=1" in r for r in short[1]) and any("rank=None" in r for r in short[1])
    monkeypatch.setattr(ranked_lists, "HEAD", 6)
    assert results()[1] == short


def test_a_fit_does_not_keep_the_shuffles_of_its_iterations(spark):
    """Shuffles of factors stayed on disk to the end: 10 iterations held 20 of them."""
    seen = spark.range(600).select((F.col("id") % 50).alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(30)).alias("item_id"))
    model = scorers.Factorization(seen, rank=4, iterations=3).model
    lineage = model.userFactors._jdf.queryExecution().toRdd().toDebugString()
    assert "ReliableCheckpointRDD" in lineage and "itemFactors-2" not in lineage


def test_draws_are_named_without_a_shuffle(spark):
    """Each draw went to its item's place in a shuffle."""
    items = spark.range(1, 30).select(F.concat(F.lit("i"), F.col("id")).alias("item_id"))
    asked = spark.range(20).select(F.col("id").alias("user_id"))
    none = asked.where("false").select("user_id", F.lit("").alias("item_id"))
    drawn = draw_items(asked, items, none, 7)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    found = drawn.groupBy("user_id").agg(F.count_distinct("item_id").alias("n"), F.array_sort(F.collect_list("draw")).alias("d")).collect()
    assert len(found) == 20 and all(r.n == 7 and r.d == list(range(1, 8)) for r in found)
