"""The segmented scan against brute force, and a busy entity."""

import bisect
import datetime
import math
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import aggregates, scan, timeseries

DAY0 = datetime.date(2020, 1, 1)


def _rows(seed, n=200):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.05 else DAY0 + datetime.timedelta(days=r.randrange(200))
    who = lambda: r.choice([None, 1, 1, 1, 1, 2, 3])
    series = [(who(), day(), i, r.choice([None, 1.5, 2.0, 0.5])) for i in range(n)]
    targets = [(who(), day(), r.choice(["a", "b"])) for _ in range(n)]
    return series, targets + targets[:5]


def _frames(spark, seed):
    series, targets = _rows(seed)
    return series, targets, spark.createDataFrame(series, "e int, d date, k int, v double").repartition(3), spark.createDataFrame(targets, "e int, t date, tag string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_of_against_brute_force(spark, seed):
    series, targets, s, t = _frames(spark, seed)
    mine = lambda e: [x for x in series if e is not None and x[0] == e and x[1] is not None]
    back, ahead, slack = [], [], []
    for e, d, tag in targets:
        hit = max((x for x in mine(e) if d and x[1] <= d), key=lambda x: (x[1], x[2]), default=None)
        back.append((e, d, tag, hit and hit[2], hit and hit[3]))
        hit = min((x for x in mine(e) if d and x[1] >= d), key=lambda x: (x[1], x[2]), default=None)
        ahead.append((e, d, tag, *((hit[1], hit[2]) if hit and (hit[1] - d).days <= 9 else (None, None))))
        hit = min((x for x in mine(e) if d and x[3] is not None and x[1] >= d - datetime.timedelta(days=2)), key=lambda x: (x[1], x[2]), default=None)
        slack.append((e, d, tag, hit[1] if hit and abs((hit[1] - d).days) <= 7 else None))
    same = lambda df, want: sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert same(timeseries.asof_backward(t, s, "e", "t", ["d", "k"], ["k", "v"]), back)
    assert same(timeseries.asof_forward(t, s, "e", "t", "d", "k", reach=9), ahead)
    assert same(timeseries.asof_slack(t, s, "e", "t", "d", "v").select("e", "t", "tag", "slack_day"), slack)


@pytest.mark.parametrize("seed", [4, 5])
def test_split_factor_and_intervals_against_brute_force(spark, seed):
    series, targets, s, t = _frames(spark, seed)
    want = [(e, d, tag, math.prod(x[3] for x in series if e is not None and x[0] == e and x[3] and x[1] and d and x[1] > d)) for e, d, tag in targets]
    got = map(tuple, aggregates.split_factor(t, s, "e", "t", "d", "v").collect())
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    spans = s.where("d is not null and e is not null").select("e", F.col("d").alias("lo"), F.date_add("d", F.col("k") % 9).alias("hi"))
    days, isles = {}, {}
    for e in (1, 2, 3):
        mine = {(x[1], x[1] + datetime.timedelta(days=x[2] % 9)) for x in series if x[0] == e and x[1] and x[2] % 9}
        days[e] = {a + datetime.timedelta(days=i) for a, b in mine for i in range((b - a).days)}
        isles[e] = len({d for d in days[e] if d - datetime.timedelta(days=1) not in days[e]})
    assert {x.e: (x.covered_days, x.islands) for x in timeseries.interval_union_days(spans, "e", "lo", "hi").collect()} == {e: (len(days[e]), isles[e]) for e in days}


def test_running_equals_a_window(spark):
    _, _, s, _ = _frames(spark, 6)
    s = s.withColumn("k", F.col("k") * 7 % 200)
    kinds = ["last", "first", "sum", "max", "min"]
    for backward in (False, True):
        for upto in (0, -1):
            w = Window.partitionBy("e").orderBy(*[F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in ("d", "k")]).rowsBetween(Window.unboundedPreceding, upto)
            plain = s.select("e", "d", "k", *[scan._INNER[k](F.col("v")).over(w).alias(k) for k in kinds])
            got = scan.running(s, "e", scan.month(F.col("d")), ["d", "k"], {k: (k, F.col("v")) for k in kinds}, backward, upto).select(plain.columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_a_busy_entity_is_linear(spark):
    """A million bars of one entity and ten thousand targets: what joins make is no more than what came in."""
    bars = spark.range(1_000_000).select(F.lit(1).alias("e"), F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int") % 300_000).alias("d"), F.col("id").alias("v"))
    targets = spark.range(10_000).select(F.lit(1).alias("e"), F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int") * 29 + 3).alias("t"))
    began = time.monotonic()
    got = timeseries.asof_backward(targets, bars, "e", "t", ["d", "v"], ["v"])
    wrong = got.where((F.col("asof_v") % 300_000) != F.datediff("t", F.lit("1000-01-01").cast("date"))).count()
    assert wrong == 0 and got.count() == 10_000 and time.monotonic() - began < 120
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_index_by_bisection_agrees(spark):
    """Sessions along a series of many buckets."""
    days = [DAY0 + datetime.timedelta(days=3 * i) for i in range(400)]
    bars = spark.createDataFrame([(7, d, float(i + 1)) for i, d in enumerate(days)], "issuer_id int, day date, close double").repartition(5)
    for x in timeseries.sessions(bars, within=90).collect():
        assert x.session == bisect.bisect_left(days, x.day) and x.first_day == days[0] and x.in_window == (x.session < 90) and abs(x.since_first - x.session) < 1e-9
    ahead = {x.day: x.next_close for x in timeseries.forward_return(bars).collect()}
    assert ahead == {d: (float(i + 2) if i + 1 < len(days) else None) for i, d in enumerate(days)}
