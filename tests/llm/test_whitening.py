from decimal import Decimal

import numpy as np
import pytest

from sessionloom.llm import singular, whitening


def matrices():
    draw = np.random.default_rng(0)
    turn = lambda n: np.linalg.qr(draw.normal(size=(n, n)))[0]
    for n in (1, 2, 3, 8, 40):
        yield np.triu(draw.normal(size=(n, n)))
        yield np.linalg.qr(draw.normal(size=(n, n)) * np.logspace(0, -8, n))[1]
        yield turn(n) * np.where(np.arange(n) < n // 2, 2 + 1e-9 * np.arange(n), 1.0) @ turn(n)  # clusters
        yield draw.normal(size=(n, 3)) @ draw.normal(size=(3, n))  # low rank
        yield np.diag([3.0] * min(3, n) + list(range(max(n - 3, 0))))  # equal values in parts of their own
        yield np.zeros((n, n))


@pytest.mark.parametrize("r", list(matrices()))
def test_singular_values_and_vectors(r):
    squares, v = singular.right_singular(r, 8)
    want = np.linalg.svd(r)[1] ** 2
    scale = max(want[0], 1e-300)
    assert np.abs(squares - want).max() <= 1e-13 * scale
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs(r.T @ (r @ v) - v * squares[: v.shape[1]]).max() <= 1e-13 * scale


def test_small_values_keep_their_digits():
    a, b = np.array([1.0, 1e-6, 1e-12, 1e-15]), np.array([1e-4, 1e-9, 1e-16])
    got = np.sqrt(singular.singular_squares(a, b))
    # one-sided reference: the product of all values is the determinant, to relative precision
    assert np.prod(got) == pytest.approx(np.prod(a), rel=1e-13)


def table(spark, rows):
    return spark.createDataFrame([(i, x, "v") for i, x in rows], "vec_id bigint, embedding array<float>, vector string").repartition(3)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    n, total = len(x), [sum(int(v) for v in c) for c in x.T]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    c = x - np.array([float(Decimal(s) / n) for s in total])
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, deviation, c, e[::-1], v[:, ::-1]


def test_whitened_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 1).astype(np.float32).tolist()
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12), (904, [1.0]), (905, [])]
    rows = [(i if i else None, x) for i, x in enumerate(vectors)]
    got = whitening.whitened(table(spark, rows + odd + [rows[7]])).collect()
    n, deviation, c, e, v = brute([*vectors, vectors[7]])
    assert len(got) == 301 * 8
    per = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-10
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        per.setdefault((r.vec_id, r.component), []).append(r)
    want = c @ v[:, :8] / np.sqrt(e[:8])
    for k in range(1, 9):
        sign = np.sign(per[(5, k)][0].whitened * want[5, k - 1])
        for i in range(300):
            for r in per[(i if i else None, k)]:
                assert r.whitened == pytest.approx(sign * want[i, k - 1], abs=1e-9)
                assert r.deviation == deviation[i]
    assert len(per[(7, 1)]) == 2


def test_few_dimensions_equal_vectors_and_nothing(spark):
    got = whitening.whitened(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 5, 0, None, None, None), (2, 5, 0, None, None, None)}
    line = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True}
    assert max(r.identity_error for r in line) < 1e-12
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).collect() == []


def test_very_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * i), 1.0]) for i in range(4)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(table(spark, rows)).where("component = 1").collect()}
    assert got == {i: None for i in range(4)}  # beyond 64 bits
    rows = [(i, [float(2**18 * i), 1.0]) for i in range(4)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(table(spark, rows)).where("component = 1").collect()}
    assert got == {i: (4 * (2**28 * i) - 6 * 2**28) ** 2 for i in range(4)}


def test_many_triangles(spark):
    draw = np.random.default_rng(6)
    rows = [(i, x) for i, x in enumerate(draw.normal(size=(200, 3)).tolist())]
    frame = table(spark, rows).repartition(40)
    model = whitening.fit(frame)
    e = brute([x for _, x in rows])[3]
    assert model.variances == pytest.approx(e, rel=1e-10)
