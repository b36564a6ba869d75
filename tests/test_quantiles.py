"""Ranks by multi-selection and by ranges, against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import aggregates, quantiles, stats, timeseries


def _values(kind, n=3000):
    r = random.Random(kind)
    return {"ties": [float(r.randrange(7)) for _ in range(n)], "skew": [r.random() ** 40 * 1e9 for _ in range(n)], "one": [2.5] * n, "mixed": [r.choice([0.0, -1.5, r.gauss(0, 1)]) for _ in range(n)], "few": [3.0, 1.0]}[kind]


@pytest.mark.parametrize("kind", ["ties", "skew", "one", "mixed", "few"])
def test_quantiles_of_several_columns_in_rounds(spark, kind):
    x = _values(kind)
    df = spark.createDataFrame([(v, -v if i % 3 else None) for i, v in enumerate(x)], "a double, b double").repartition(4)
    at = [0, 0.01, 0.25, 0.5, 0.77, 0.99, 1]
    got, n = quantiles.quantiles(df, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None)}, at, gather=20)
    b = [-v for i, v in enumerate(x) if i % 3]
    assert np.allclose(got["a"], np.quantile(x, at), rtol=1e-12) and np.allclose(got["b"], np.quantile(b, at), rtol=1e-12)
    assert n == {"a": len(x), "b": len(b), "none": 0} and got["none"] == [None] * len(at)


def test_kth_value_keeps_its_type(spark):
    days = spark.range(500).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 500).cast("int")).alias("d"))
    assert str(quantiles.kth_value(days, "d", 31, gather=5)) == "2020-02-01"
    assert quantiles.kth_value(days, "d", 500, gather=5) is None
    assert quantiles.kth_value(days.limit(0), "d", 0) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_sorting(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None, "c"]), r.choice([None, r.gauss(0, 1), float(r.randrange(4))])) for _ in range(2000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g, _ in rows}
    for x in aggregates.quantile_profile(df, "v", ["g"]).collect():
        want = by[x.g]
        assert x.n == len(want)
        if want:
            assert np.allclose([x.q25, x.q50, x.q75], np.quantile(want, [0.25, 0.5, 0.75])) and abs(x.iqr - (x.q75 - x.q25)) < 1e-12
        else:
            assert x.q50 is None
    medians = {x.g: (x.upper_median, x.n) for x in aggregates.upper_median(df, "v", ["g"]).collect()}
    assert medians == {g: (v[len(v) // 2], len(v)) for g, v in by.items() if v}
    d = stats.stratified_difference(df.withColumn("f", (F.col("v") > 0).cast("int")), F.col("g"), "f", "v").collect()
    for x in d:
        up = [v for v in by[x.stratum] if v > 0]
        assert x.n1 == len(up) and (x.median1 is None if not up else abs(x.median1 - np.median(up)) < 1e-12)


def test_whole_columns_without_groups(spark):
    x = _values("mixed")
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double")
    p = aggregates.quantile_profile(df, "v").first()
    assert np.allclose([p.q25, p.q50, p.q75], np.quantile(x, [0.25, 0.5, 0.75])) and p.n == len(x)
    w = stats.winsorize(df, "v", 0.1, 0.9).collect()
    lo, hi = np.quantile(x, [0.1, 0.9])
    assert all(r.winsorized is None if r.v is None else abs(r.winsorized - min(max(r.v, lo), hi)) < 1e-12 for r in w)
    order = sorted(x)
    ranks = {r.v: r.avg_rank for r in timeseries.average_rank(df, "v").collect()}
    assert ranks == {v: (np.searchsorted(order, v) + 1 + np.searchsorted(order, v, side="right")) / 2 for v in set(x)}
