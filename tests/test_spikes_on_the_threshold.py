"""Spikes whose z is 1 or next to it: the deviation's rounding decides them as in the SQL."""

import itertools

import duckdb
from compare import differences
from lodestar.plans import registry


def test_weeks_in_every_order(spark, tmp_path):
    # Every order of some histories of a week, then a day on the threshold.
    weeks = [h for start in ((3, 3, 1, 2, 1, 3, 1), (3, 3, 2, 1, 1)) for h in sorted(set(itertools.permutations(start)))]
    days = [(i, day, n) for i, h in enumerate(weeks) for day, n in enumerate([*h, 3], 1)]
    e = spark.createDataFrame(days, "user_id long, day int, n int").selectExpr("user_id", "timestamp(date_add(date'2024-01-01', day)) ts", "explode(sequence(1, n)) k")
    e = e.selectExpr("(user_id * 100 + dayofmonth(ts)) * 10 + k event_id", "ts", "user_id", "'view' event_type", "1d value", "'{}' props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert differences(registry.queries()["mention_spikes"](spark, str(tmp_path)), c, registry.oracle_sql()["mention_spikes"]) is None
