import numpy as np
import pytest

import corpus_pipeline
from sessionloom.llm import decontaminate, quality_knn, simhash, vptree


def brute(points, ids, queries, k):
    """Ids of the k largest inner products, smallest id first where they are equal."""
    score = queries @ points.T
    order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k]
    return ids[order]


def clustered(rng, rows, width, groups, spread=0.02):
    """Directions in tight groups; ``spread`` is the deviation of the logarithm of the lengths."""
    middles = rng.normal(size=(groups, width))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True) / width**0.5
    x = middles[rng.integers(groups, size=rows)] + 0.1 * rng.normal(size=(rows, width))
    return x * np.exp(spread * rng.normal(size=(rows, 1)))


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.5, 0.9), (1e9, 0.05)])
def test_factor_one_is_exact(factor, least):
    rng = np.random.default_rng(1)
    points = np.concatenate((rng.normal(size=(900, 12)), np.repeat(rng.normal(size=(1, 12)), 150, 0)))
    ids = rng.permutation(len(points)) * 3
    tree = vptree.VantageTree(points, ids, 32)
    asked = np.arange(0, len(points), 20)
    rows, scores = tree.search(points[asked], 10, factor)
    want = brute(points, ids, points[asked], 10)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows, want, strict=True)]) >= least
    if factor == 1:
        assert (np.sort(rows) == np.sort(want)).all()
        floor = np.sort(scores, axis=1)[:, 4]
        some, above = tree.search(points[asked], 10, 1.0, floor)
        assert all((x[np.isfinite(s)] == y[:n]).all() for x, s, y, n in zip(some, above, rows, np.isfinite(above).sum(1), strict=True))
        assert (np.isfinite(above).sum(1) >= 6).all()


@pytest.mark.parametrize("factor,share", [(1.0, 0.3), (2.0, 0.15)])
def test_most_pairs_of_grouped_vectors_are_left_out(factor, share):
    rng = np.random.default_rng(5)
    points = clustered(rng, 8_000, 16, 40)
    ids = np.arange(len(points))
    tree = vptree.VantageTree(points, ids, 32)
    rows, _ = tree.search(points[::40], 20, factor)
    want = brute(points, ids, points[::40], 20)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows, want, strict=True)]) >= (1.0 if factor == 1 else 0.9)
    assert tree.compared < share * len(points) * len(points[::40])


def test_trees_are_read_back_as_written(tmp_path):
    rng = np.random.default_rng(6)
    points, ids = rng.normal(size=(500, 5)), np.arange(500)
    tree = vptree.VantageTree(points, ids, 16)
    tree.write(f"file://{tmp_path}/tree.npz")
    again = vptree.VantageTree.read(f"file://{tmp_path}/tree.npz")
    for x, y in zip(tree.search(points, 3), again.search(points, 3), strict=True):
        assert (x == y).all()


def test_a_very_long_row_and_extreme_lengths_leave_the_search_exact(spark):
    rng = np.random.default_rng(7)
    x = clustered(rng, 1_200, 8, 10, 1.0)
    x[33] *= 1e8
    x[40:60] *= 1e-170
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in vptree.nearest_neighbours(table, shard_rows=100, leaf=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(len(x))
    for q in range(0, len(x), 20):
        score = np.where(ids == q, -np.inf, x @ x[q])
        assert got[q] == set(np.lexsort((ids, -score))[:20].tolist())


def test_copies_of_one_vector_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate((np.repeat(rng.normal(size=(1, 6)), 900, 0), rng.normal(size=(600, 6))))
    ids = rng.permutation(len(x))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    visits, found = [], vptree._found
    monkeypatch.setattr(vptree, "_found", lambda sent, *rest: (visits.append(sent), found(sent, *rest))[1])
    got = {}
    for r in vptree.nearest_neighbours(table, shard_rows=70, leaf=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for at in np.flatnonzero(ids % 20 == 0):
        score = np.where(ids == ids[at], -np.inf, np.round(x @ x[at], 9))
        assert [got[ids[at]][n] for n in range(1, 21)] == ids[np.lexsort((ids, -score))[:20]].tolist()
    assert len(got) == 75
    assert visits[0].count() < 60


def test_queries_go_to_few_shards_of_grouped_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = clustered(rng, 4_000, 16, 40)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    visits, found = [], vptree._found
    monkeypatch.setattr(vptree, "_found", lambda sent, *rest: (visits.append(sent), found(sent, *rest))[1])
    assert vptree.nearest_neighbours(table, shard_rows=100).count() == 200 * 20
    assert visits[0].count() < 1.2 * 200
    assert visits[1].count() < 0.3 * 200 * 40


@pytest.mark.parametrize("shard,block", [(8_192, 1_024), (60, 7)])
def test_largest_inner_products_over_shards(spark, shard, block):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, (400, 1))).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(1000, None, "x"), (1020, [0.0] * 8, "x"), (1040, [float("nan")] * 8, "x"), (1060, [float("inf")] + [1.0] * 7, "x"), (1080, [None] + [1.0] * 7, "x"), (None, [1.0] * 8, "x"), (1100, [], "x")]
    short = [(2000, [1.0, 2.0], "x"), (2001, [2.0, 2.0], "x"), (2020, [1.0], "x"), (40, x[40].tolist(), "x")]
    table = spark.createDataFrame(rows + bad + short, "vec_id bigint, embedding array<float>, shard string").repartition(3)
    got = {}
    for r in sorted(vptree.nearest_neighbours(table, factor=1.0, shard_rows=shard, block_rows=block).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = x.astype(float)
    for q in range(0, 400, 20):
        score = np.einsum("ij,j->i", y, y[q])
        order = [i for i in np.lexsort((np.arange(400), -np.round(score, 9))) if i != q][:20]
        assert [v for _, v, _ in got[q]] == order
        assert [n for n, _, _ in got[q]] == list(range(1, 21))
        assert [s for _, _, s in got[q]] == pytest.approx(score[order])
    assert got[2000] == [(1, 2001, 6.0)]
    assert set(got) == {*range(0, 400, 20), 2000}
    assert vptree.nearest_neighbours(table.where("false")).count() == 0


@pytest.mark.parametrize("lengths", ["one", "outlier", "mixed"])
def test_default_search_finds_all_whatever_the_lengths(spark, lengths):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1_500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "outlier":
        x[7] *= 10
    elif lengths == "mixed":
        x *= np.exp(rng.normal(size=(len(x), 1)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in vptree.nearest_neighbours(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert got[q] == set(np.argsort(-score)[:20].tolist())


def test_pipeline_applies_every_decision(spark, docs, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    good = [(i, text(80), f"s{i % 3}") for i in range(60)]
    junk = [(i, text(60).upper().replace(" ", "!! "), "s0") for i in range(100, 130)]
    copies = [(i, good[i - 200][1], "s1") for i in range(200, 210)]
    item = " ".join(word() for _ in range(30))
    dirty = [(i, f"{text(40)} {item} {text(40)}", "s2") for i in range(300, 304)]
    table = docs(good + junk + copies + dirty)
    folder = str(tmp_path)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in [*range(60), *range(100, 130)]], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*table.columns, "shard"]
    rows = got.collect()
    kept = {i for i, _, _ in good}
    assert {r.doc_id for r in rows} <= kept
    words = {}
    for r in rows:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert abs(sum(words.values()) - 1.5 * 60 * 80) <= 3
    assert {r.shard for r in rows} <= set(range(16))
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    # the filtering stages alone, each on its own input
    assert {r.doc_id for r in simhash.keep_one(docs(good + copies)).collect()} == kept
    assert {r.doc_id for r in decontaminate.without_leaks(docs(good + dirty), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()} == kept
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    assert {r.doc_id for r in quality_knn.keep_good(docs(good + junk), marks).collect()} == kept


def test_stages_take_empty_tables(spark, docs, tmp_path):
    for name, kind in (("labels", "doc_id bigint, quality int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = docs([(1, "a")]).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        assert name == "shard" or out.columns == empty.columns
