import random

import pytest

from sessionloom.llm import minimax, mixing


def capacity(weights, shards):
    def need(c):
        n, held = 1, 0
        for w in weights:
            n, held = (n + 1, w) if held + w > c else (n, held + w)
        return n

    low, high = max(weights), sum(weights)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if need(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed,bins", [(1, 8_192), (2, 16), (3, 45)])
def test_capacity_is_the_smallest_and_filled_greedily(docs, monkeypatch, seed, bins):
    monkeypatch.setattr(minimax, "BOUNDARIES", bins)
    rng = random.Random(seed)
    texts = ["é" * rng.randint(0, 40) + str(k) for k in range(120)] + ["z" * 900]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(k, "z" * 900) for k in range(300, 310)] + [(None, None), (500, ""), (17, texts[0])]
    got = minimax.sharded(docs(rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i if i is not None else 1 << 60)
    order = sorted(groups, key=lambda t: min(groups[t]))
    weights = [len(groups[t]) * (len(t.encode()) + 1) for t in order]
    most = capacity(weights, 16)
    want, shard, held = {}, 0, 0
    for t, w in zip(order, weights, strict=True):
        shard, held = (shard + 1, w) if held + w > most else (shard, held + w)
        want[t] = shard
    by_id = dict(rows[:310])
    assert all(r.shard == want[by_id[r.doc_id]] for r in got if r.doc_id in by_id and r.doc_id != 17)
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
    assert max(sums.values()) == most


def test_sharding_empty_single_and_clashing_columns(docs):
    assert minimax.sharded(docs([(1, "a")]).where("false")).count() == 0
    assert [(r.shard, r.slot) for r in minimax.sharded(docs([(1, "a")])).collect()] == [(0, 0)]
    table = docs([(1, "a"), (2, "b")]).selectExpr("*", "'q' AS key", "9 AS shard")
    out = minimax.with_shard(table)
    assert out.columns == [*[c for c in table.columns if c != "shard"], "shard"]
    assert {r.key for r in out.collect()} == {"q"}


def filled(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by repeated sharing, source by source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], 2 * sizes[s])
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
    return target


@pytest.mark.parametrize("a_range", [8_192, 5])
def test_mix_meets_targets_and_repeats(spark, docs, monkeypatch, a_range):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", a_range)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "a", "a", "é", None])) for i in range(200)]
    rows += [(900, None, "a"), (901, "", "zero"), (None, "no id here", "b"), (None, "no id here", "b"), (5, rows[5][1], rows[5][2]), (902, "w\x0b w \n w", "b")]
    got = mixing.mix_plan(docs(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = filled(sizes)
    source = {i: s for i, _, s in rows if i is not None}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source.get(r.doc_id, "b")
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-4)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(int(want[s] + 1e-6) == taken[s] for s in sizes)
    again = mixing.mix_plan(docs(rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed(docs(rows))
    assert out.columns == docs(rows).columns
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text or "") or r.text is None
        words[r.source] = words.get(r.source, 0) + len((r.text or "").encode().split())
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in words.items() if n}


def test_mix_of_nothing(docs):
    assert mixing.mix_plan(docs([(1, "a")]).where("false")).count() == 0
    assert mixing.mixed(docs([(1, None), (2, "")])).count() == 0


def test_mixing_stays_native(docs):
    plan = mixing.mix_plan(docs([(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
