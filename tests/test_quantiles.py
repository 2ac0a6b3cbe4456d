import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators.quantiles import exact_quantiles
from sessionloom.operators.stats import describe_sessions

POINTS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def test_quantiles_equal_numpy(spark):
    """Many equal values, single rows, nulls, negative and fractional values, and weights."""
    draw = random.Random(8)
    rows = [("a", draw.choice([-1.5, 0.0, 2.25, 1e9]), 1) for _ in range(3_000)]
    rows += [("b", draw.gauss(0, 1), draw.randrange(1, 4)) for _ in range(500)]
    rows += [("one", 3.5, 1), ("none", None, 1), (None, 7.0, 2), ("b", None, 5)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(3)
    got = {r.g: (r.n, r.quantiles) for r in exact_quantiles(df, ["g"], "v", POINTS, F.col("w")).collect()}
    values = {}
    for g, v, w in rows:
        if v is not None:
            values.setdefault(g, []).extend([v] * w)
    values.pop(None)  # rows without a group belong to none
    assert set(got) - {None} == set(values)
    for g, x in values.items():
        assert got[g][0] == len(x)
        assert got[g][1] == pytest.approx(np.quantile(x, POINTS).tolist())


def test_deviation_of_large_values(spark):
    df = spark.range(1_000).select(F.lit(False).alias("is_anonymous"), (F.lit(1e9) + F.col("id") % 2).alias("n_events"))
    r = describe_sessions(df).where("user_type = 'all'").first()
    assert r["std"] == pytest.approx(0.50025, abs=1e-4) and r["p50"] == 1e9 + 0.5 and r["count"] == 1_000
