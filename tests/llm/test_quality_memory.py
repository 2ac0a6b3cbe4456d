import tracemalloc

import numpy as np

from sessionloom.llm.quality_knn import Terms


def test_products_of_long_rows_need_little_memory():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(9_000, 4_000, replace=False)).astype(np.int32), rng.random(4_000, np.float32), 0.0) for _ in range(256)]
    terms, right, left = Terms.of(rows), rng.random((9_000, 48), np.float32), rng.random((256, 48), np.float32)
    dense = np.zeros((256, 9_000), np.float32)
    for r, (columns, values, _) in enumerate(rows):
        dense[r, columns] = values
    tracemalloc.start()
    got, back = terms.times(right), terms.transposed_times(left, 9_000)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert np.allclose(got, dense @ right, rtol=1e-4) and np.allclose(back, dense.T @ left, rtol=1e-4)
    assert peak < 120  # 256 rows at a time made tables of 188 MB, three at once
