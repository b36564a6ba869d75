"""Retention with many issuers in one key: each leaves by its own rollup, and keys don't grow with the issuers."""

import datetime

from pyspark.sql import functions as F

from lodestar.streaming import stateful, streams


def test_issuers_of_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "PARTS", 1, raising=False)
    first, later = datetime.datetime(2024, 1, 1, 5), datetime.datetime(2024, 1, 30)
    # Issuers 1 to 40, of which the even ones are rolled up; one without an issuer; a mark of another source rolls nothing up.
    rows = [(i, i, "hn", first, None) for i in range(1, 41)] + [(90, None, "hn", first, None), (99, 1, "hn", later, None)]
    rows += [(None, i, "hn" if i % 2 == 0 else "x", first, first.date()) for i in range(1, 41)]
    spark.createDataFrame(rows, "mention_id long, issuer_id long, source string, posted_at timestamp, day date").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.read_stream(spark, str(tmp_path / "in"))
    out = stateful.expired_mentions(s.where("day is null").drop("day"), s.where("day is not null").withColumn("rolled_at", F.col("posted_at")), 10)
    keys = out._jdf.queryExecution().analyzed()
    assert keys.groupingAttributesLen() == 3  # day, part, salt: four with the issuer and the source
    got = sorted(r[0] for r in streams.run_to_table(out, "keys").collect())
    assert got == sorted([*range(2, 41, 2), 90])
