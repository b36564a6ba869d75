"""Permutations made by tasks that hold all rows, and by shuffle: the same counts."""

import math
import random

from compare import connect, differences
from lodestar.operators import stats
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


def test_held_and_shuffled_agree(spark, monkeypatch):
    r = random.Random(9)
    # Ids of one to four digits and below 0.
    df = spark.createDataFrame([(i * i - 50, r.randrange(7), float(r.randrange(11))) for i in range(8, 80)], "id long, x long, y double")
    held = stats.permutation_test(df, "id", "x", "y", 120).first()
    monkeypatch.setattr(stats, "PERM_HELD", 0)
    assert held == stats.permutation_test(df, "id", "x", "y", 120).first()


def test_a_constant_side_is_no_error(spark):
    got = stats.permutation_test(spark.createDataFrame([(i, 5, float(i)) for i in range(9)], "id long, x long, y double"), "id", "x", "y", 20).first()
    assert (got.n, got.extreme, got.p) == (9, 20, 1.0) and math.isnan(got.rho)


def test_held_permutations_need_no_shuffle_of_them(spark, monkeypatch):
    monkeypatch.setattr(stats, "PERM_CHUNK", None)  # what the shuffle reads
    assert differences(registry.queries()["permutation_test"](spark, SF), connect(SF), registry.oracle_sql()["permutation_test"]) is None
