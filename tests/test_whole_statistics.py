"""The rank and outcome statistics over all rows, on small fixtures."""

import hashlib
import random

import numpy as np
import pytest

from compare import connect, differences
from lodestar.operators import stats
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


def _ranks(v):
    return [sum(o < x for o in v) + (sum(o == x for o in v) + 1) / 2 for x in v]


def _by_hand(rows, permutations):
    rows = sorted(rows)
    rx, ry = np.array(_ranks([r[1] for r in rows])), np.array(_ranks([r[2] for r in rows]))
    centre, obs, extreme = len(rows) * rx.mean() * ry.mean(), (rx * ry).sum(), 0
    for k in range(permutations):
        order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"p{k}:{rows[i][0]}".encode()).hexdigest())
        extreme += abs((rx[order] * ry).sum() - centre) >= abs(obs - centre) - 1e-9
    return len(rows), np.corrcoef(rx, ry)[0, 1], extreme, (extreme + 1) / (permutations + 1)


@pytest.mark.parametrize("part", [4096, 7])
def test_permutations_by_hand(spark, monkeypatch, part):
    monkeypatch.setattr(stats, "PERM_PART", part, raising=False)
    r = random.Random(4)
    rows = [(7 * i - 20, r.randrange(9), float(r.randrange(30))) for i in range(60)]
    got = stats.permutation_test(spark.createDataFrame(rows, "id long, x long, y double"), "id", "x", "y", 50, chunk=20).first()
    want = _by_hand(rows, 50)
    assert (got.n, got.extreme) == (want[0], want[2]) and got.rho == pytest.approx(want[1]) and got.p == pytest.approx(want[3])


def test_permutation_query_takes_all_issuers_and_10000_permutations(spark, tmp_path):
    # Issuers above 400 too.
    rows = [(i, 390 + (i if i < 20 else i * i) % 20, kind, f"2024-01-{1 + i % 20:02d} 10:00:00", float(i % 13)) for i, kind in enumerate(["signup"] * 20 + ["view"] * 60)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").selectExpr("event_id", "user_id", "event_type", "timestamp(ts) ts", "value", "'{}' props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["permutation_test"](spark, str(tmp_path)).first()
    assert got.n == 20 and got.p == round((got.extreme + 1) / 10_001, 6)


def test_permutation_query_equals_its_sql_without_the_cuts(spark):
    sql = registry.oracle_sql()["permutation_test"].replace(" where issuer_id < 400", "").replace("range(0, 200)", "range(0, 10000)")
    assert differences(registry.queries()["permutation_test"](spark, SF), connect(SF), sql) is None
