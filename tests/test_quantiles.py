"""Exact quantiles by selection against NumPy, with skew, ties, missing values and brackets that are narrowed several times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.operators import quantiles


def disc(x, p):
    return np.sort(x)[max(int(np.ceil(round(p * len(x), 9))) - 1, 0)]


@pytest.mark.parametrize("k,within", [(1024, 10_000), (64, 40)])
def test_exact_quantiles(spark, k, within):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.normal(size=3000).round(2), np.full(2000, 0.25)])
    groups = {"hot": hot, "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "tied": np.full(300, 7.0), "wide": rng.exponential(size=500) * 1e9}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("none", None)]
    d = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, x double").repartition(5)
    shares = {"p01": 0.01, "p25": 0.25, "med": 0.5, "low": (0.5, "disc"), "p99": 0.99, "max": 1.0, "min": (0.0, "disc")}
    got = {r.g: r for r in quantiles.exact_quantiles(d, ["g"], "x", shares, k, within).collect()}
    for g, x in groups.items():
        want = {n: disc(x, s[0]) if isinstance(s, tuple) else np.quantile(x, s) for n, s in shares.items()}
        assert all(abs(got[g][n] - v) <= 1e-12 * max(1, abs(v)) for n, v in want.items()), (g, got[g], want)
    assert got["none"].med is None and len(got) == 6
    whole = quantiles.exact_quantiles(d, [], "x", {"med": 0.5}, k, within).collect()
    assert len(whole) == 1 and abs(whole[0].med - np.median(np.concatenate(list(groups.values())))) < 1e-12
    assert quantiles.exact_quantiles(d.limit(0), ["g"], "x", {"med": 0.5}, k, within).count() == 0


def test_bracket_shrinks_what_a_task_holds(spark):
    """With `within` values to walk, no group of the last step has more rows, whatever the group's size."""
    d = spark.range(0, 60_000, 1, 4).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"))
    got = quantiles.exact_quantiles(d, ["g"], "x", {"med": 0.5, "p9": 0.9}, 64, 200).first()
    x = np.array([r.x for r in d.collect()])
    assert abs(got.med - np.median(x)) < 1e-3 and abs(got.p9 - np.quantile(x, 0.9)) < 1e-3
