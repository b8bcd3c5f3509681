import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import sketches as S


def exact(ref, cur, bins=10):
    ref, cur = np.sort(ref), np.sort(cur)
    cuts = np.unique([ref[int(np.ceil(i / bins * len(ref))) - 1] for i in range(1, bins)])
    share = lambda x: np.diff(np.concatenate([[0], np.searchsorted(x, cuts, "right") / len(x), [1]])) + 1e-6
    a, e = share(cur), share(ref)
    return float(((a - e) * np.log(a / e)).sum())


def long(spark, values):
    return spark.createDataFrame([(f, i % 5, float(v)) for f, vs in values.items() for i, v in enumerate(vs)], "feature string, day int, value double")


@pytest.mark.parametrize("n, k, error", [(300, 4096, 1e-9), (20000, 4096, 0.01), (20000, 400, 0.05)])
def test_index_from_merged_days(spark, n, k, error):
    """Days are sketched apart and merged; up to k rows the index is exact, beyond that within the stated error."""
    rng = np.random.default_rng(n)
    ref = {"same": rng.normal(size=n), "moved": rng.normal(size=n), "ties": rng.integers(0, 4, n)}
    cur = {"same": rng.normal(size=n), "moved": rng.normal(size=n) + 0.8, "ties": rng.integers(1, 5, n), "new": [1.0]}
    days = S.value_sketches(long(spark, ref), ["day"], k)
    assert days.count() == 15
    got = {r.feature: r for r in S.stability(S.merged_sketches(days, k), S.merged_sketches(S.value_sketches(long(spark, cur), [], k), k)).collect()}
    assert set(got) == set(ref)
    for f in ref:
        assert got[f].n == n and got[f].psi == pytest.approx(exact(ref[f], cur[f]), abs=error)
    assert not got["same"].drift and got["moved"].drift


def test_missing_values_take_no_part(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None)], "feature string, value double")
    assert [(r.feature, r.n) for r in S.value_sketches(df).collect()] == [("a", 1)]
    assert S.value_sketches(df.where(F.lit(False))).count() == 0
