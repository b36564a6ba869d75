"""Queries of returns and ranks against their SQL where prices are 0 and ranks are constant."""

import pytest

from compare import connect, differences
from lodestar.plans import registry


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Issuers whose first price or listing price is 0 (1, 2, 3, 7), with constant mentions or returns (4, 5, 6) or two days (8), others varied."""
    rows = []

    def add(issuer, day, kind, value, hour=10):
        rows.append((len(rows), issuer, kind, f"2024-01-{day:02d} {hour:02d}:00:00", float(value)))

    for issuer in range(1, 40):
        add(issuer, 1, "signup", 0 if issuer in (1, 2, 7) else issuer)
        for day in [1, 2] if issuer == 8 else range(1, 30):
            for n in range(1 if issuer in (4, 5, 8) else 1 + (issuer * day * day) % 4):
                add(issuer, day, "view", 3, 11 + n)
            close = {1: 0 if day in (1, 9, 15, 21, 26) else 5 + day, 2: day, 3: 0 if day == 1 else -day, 5: 2**day, 6: 7, 7: -day % 9}.get(issuer, 1 + (issuer * day) % 17)
            add(issuer, day, "purchase", close, 20)
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, value double").selectExpr("event_id", "user_id", "event_type", "timestamp(ts) ts", "value", "'{}' props")
    at = str(tmp_path_factory.mktemp("odd"))
    e.write.parquet(f"{at}/events.parquet")
    return at


@pytest.fixture(scope="module")
def duck(odd):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute(f"create view events as select * from '{odd}/events.parquet/*.parquet'")
    return c


QUERIES = "asof_forward_return calendar_returns event_study_report fisher_ci session_index session_returns sign_consistency spearman_by_entity spearman_pooled".split()


@pytest.mark.parametrize("name", QUERIES)
def test_odd_prices(spark, odd, duck, name):
    assert differences(registry.queries()[name](spark, odd), duck, registry.oracle_sql()[name]) is None
