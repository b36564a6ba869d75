"""Streams over several files and batches: late rows, replays, rollups that come late, listings without a bar."""

import datetime
import os

from pyspark.sql import functions as F

from lodestar.streaming import stateful, streams


def at(text):
    return datetime.datetime.fromisoformat(text)


class Landing:
    """A folder to which batches are added; each file is one trigger's input."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        for f in os.listdir(self.folder):  # files are taken in the order of their times
            path = f"{self.folder}/{f}"
            if f.startswith("part") and os.path.getmtime(path) > 1e9 + 10_000:
                os.utime(path, (1e9 + self.n, 1e9 + self.n))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


MENTION = "mention_id long, issuer_id long, source string, posted_at timestamp, engagement double, author string"


def test_exact_authors_and_late_rows(spark, tmp_path):
    landing = Landing(spark, tmp_path / "in", MENTION)
    landing.add((1, 7, "hn", at("2024-01-01T10:00"), 1.0, "a"), (2, 7, "hn", at("2024-01-01T11:00"), 1.0, "a"), (3, 7, "hn", at("2024-01-01T12:00"), 1.0, None))
    landing.add((4, 7, "hn", at("2024-01-06T00:00"), 2.0, "b"))
    # Inside the seven days: kept, one id for the second time; then the watermark passes the first of January.
    landing.add((5, 7, "hn", at("2024-01-01T13:00"), 1.0, "c"), (2, 7, "hn", at("2024-01-01T11:00"), 1.0, "a"))
    landing.add((6, 7, "hn", at("2024-01-20T00:00"), 1.0, "z"))
    landing.add((7, 7, "hn", at("2024-01-20T01:00"), 1.0, "z"))
    # Later than the watermark of the batch before: dropped.
    landing.add((8, 7, "hn", at("2024-01-01T14:00"), 1.0, "d"))
    landing.add((9, 7, "hn", at("2024-02-20T00:00"), 1.0, "z"))
    out = streams.run_to_table(streams.daily_rollup(streams.unique_mentions(landing.stream())), "late").collect()
    got = {str(r.day): (r.mention_count, r.engagement, r.unique_authors) for r in out}
    assert len(out) == len(got) and got == {"2024-01-01": (4, 4.0, 2), "2024-01-06": (1, 2.0, 1), "2024-01-20": (2, 2.0, 1)}


def test_retention_waits_for_the_rollup(spark, tmp_path):
    schema = MENTION + ", rolled_day date, rolled_at timestamp"
    landing = Landing(spark, tmp_path / "in", schema)
    m = lambda i, issuer, t: (i, issuer, "hn", at(t), 1.0, "a", None, None)
    mark = lambda issuer, day, t: (None, issuer, "hn", None, None, None, at(day).date(), at(t))
    landing.add(m(1, 7, "2024-01-01T03:00"), m(2, 7, "2024-01-01T22:59"), m(3, None, "2024-01-01T10:00"), m(4, 8, "2024-01-01T10:00"), m(5, 7, "2024-01-11T00:00"))
    landing.add(mark(8, "2024-01-01", "2024-01-02T00:00"))  # rolled up before it is old
    landing.add(m(6, 7, "2024-01-12T00:00"))  # the first of January is ten days old, its rollup for 7 hasn't come
    folder = str(tmp_path / "q")

    def gone():
        s = landing.stream()
        out = stateful.expired_mentions(s.where("mention_id is not null"), s.where("rolled_day is not null").withColumnRenamed("rolled_day", "day"), 10)
        q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(f"{folder}/out").collect())

    assert gone() == [3, 4]
    landing.add(mark(7, "2024-01-01", "2024-01-12T01:00"))
    assert gone() == [1, 2, 3, 4]  # withheld until now; after a restart
    assert gone() == [1, 2, 3, 4]


def test_first_bar_or_none(spark, tmp_path):
    schema = "kind string, id long, issuer_id long, at timestamp, price double"
    landing = Landing(spark, tmp_path / "in", schema)
    landing.add(("l", 1, 7, at("2024-01-01T00:00"), None), ("l", 2, 8, at("2024-01-01T00:00"), None), ("b", 10, 7, at("2023-12-31T00:00"), 1.0))
    landing.add(("b", 11, 7, at("2024-01-04T00:00"), 4.0), ("b", 12, 7, at("2024-01-03T00:00"), 3.0))
    landing.add(("b", 13, 7, at("2024-01-05T00:00"), 5.0), ("b", 14, 8, at("2024-01-08T00:00"), 8.0), ("l", 3, None, at("2024-01-05T00:00"), None))
    landing.add(("b", 15, 9, at("2024-02-01T00:00"), 9.0))
    landing.add(("l", 4, 9, at("2024-02-01T00:00"), None), ("b", 16, 9, at("2024-03-01T00:00"), 9.5))
    landing.add(("b", 17, 9, at("2024-04-01T00:00"), 9.5))
    s = landing.stream()
    listings = s.where("kind = 'l'").select(F.col("id").alias("listing_id"), "issuer_id", F.col("at").alias("listed_at"))
    bars = s.where("kind = 'b'").select(F.col("id").alias("bar_id"), "issuer_id", F.col("at").alias("bar_at"), "price")
    out = streams.run_to_table(stateful.promotions(listings, bars, 5, late="2 days"), "bars").collect()
    got = {r.listing_id: (r.issuer_id, r.bar_id, r.price, r.status) for r in out}
    assert len(out) == len(got) and got == {1: (7, 12, 3.0, "listed"), 2: (8, None, None, "awaiting_bar"), 4: (9, 15, 9.0, "listed")}


def test_streamed_retention_equals_the_batch(spark):
    from lodestar.operators import attention, upsert
    from lodestar.plans import registry
    from lodestar.plans.bindings import Tables

    sf = "/root/testdata/sf0.001"
    m = Tables(spark, sf).mentions.withColumn("issuer_id", F.when(F.col("mention_id") % 10 != 0, F.col("issuer_id")))
    rollup = attention.daily_rollup(m.where("issuer_id % 3 <> 0").withColumn("engagement", F.lit(1)), "mention_id")
    today = F.lit(m.agg(F.to_date(F.max("posted_at"))).first()[0])
    kept = {r.mention_id for r in upsert.retention(m, rollup, today, 15)[0].collect()}
    gone = [r.mention_id for r in registry.queries()["stream_retention"](spark, sf).collect()]
    assert len(gone) == len(set(gone)) and set(gone) == {r.mention_id for r in m.collect()} - kept
