"""Stores that change by batches, the poll source, readers with a ledger."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar.sources import landed, polls, store
from lodestar.streaming import streams


def _files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.startswith("part")}


def test_snapshot_rewrites_only_what_a_batch_touches(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"), ["k"], buckets=16)
    merge = streams.furthest("k", "rank")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, rank int")
    with pytest.raises(FileNotFoundError):
        s.read()
    assert len(s.apply(rows(*[(i, 1) for i in range(200)]), 0, merge)) == 16
    before = _files(tmp_path / "s")
    touched = s.apply(rows((7, 3), (7, 2), (500, 1)), 1, merge)
    assert 1 <= len(touched) <= 2
    after = _files(tmp_path / "s")
    assert {f: t for f, t in after.items() if f in before} == before and all("version=1" in f for f in set(after) - set(before))
    want = {i: 1 for i in range(200)} | {7: 3, 500: 1}
    assert {r.k: r["rank"] for r in s.read().collect()} == want and s.read().count() == len(want)
    # A batch that comes again, or an older one, changes nothing; an empty one only counts.
    assert s.apply(rows((7, 9)), 1, merge) == [] and s.apply(rows((7, 9)), 0, merge) == []
    assert s.apply(rows(), 2, merge) == [] and {r.k: r["rank"] for r in s.read().collect()} == want
    # What only versions before the last two name has gone, all else is as it was.
    left = _files(tmp_path / "s")
    assert left.items() <= after.items() and {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(left)} <= set(touched)


def test_old_versions_go_and_a_failed_batch_leaves_no_trace(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"), ["k"], buckets=2)
    merge = streams.furthest("k", "rank")
    rows = lambda r: spark.createDataFrame([(i, r) for i in range(20)], "k long, rank int")
    for i in range(5):
        s.apply(rows(i), i, merge)
    versions = {f.split("version=")[1].split("/")[0] for f in _files(tmp_path / "s")}
    assert versions == {"3", "4"} and len(s._manifests()) == 2
    # Data without a manifest is what a batch leaves that failed half-way.
    half = s.apply.__self__.path + "/data/version=5"
    rows(99).withColumn("bucket", s._bucket()).write.partitionBy("bucket").parquet(half)
    assert s.read().agg(F.max("rank")).first()[0] == 4
    s.apply(rows(5), 5, merge)
    assert {r["rank"] for r in s.read().collect()} == {5} and s.read().count() == 20


def test_a_day_is_replaced_and_others_stay(spark, tmp_path):
    at = str(tmp_path / "days")
    day = lambda d: datetime.date(2024, 1, d)
    df = spark.createDataFrame([(i, day(1 + i % 2), 1.0) for i in range(4000)], "e long, day date, v double")
    store.write_days(df, at, "day", "e")
    first = _files(f"{at}/day=2024-01-01")
    store.write_days(spark.createDataFrame([(5, day(2), 9.0)], df.schema), at, "day", "e")
    assert _files(f"{at}/day=2024-01-01") == first
    t = spark.read.parquet(at)
    assert t.where("day = '2024-01-01'").count() == 2000 and [r.v for r in t.where("day = '2024-01-02'").collect()] == [9.0]
    plan = t.where("day = '2024-01-02' and e = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(e), EqualTo(e,5)]" in plan
    # Entities of one file are a range: rows are sorted, and files of a day don't overlap.
    spans = sorted(tuple(r) for r in t.where("day = '2024-01-01'").groupBy(F.col("_metadata.file_path")).agg(F.min("e"), F.max("e")).select(F.col("min(e)"), F.col("max(e)")).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _poll(folder, name, *hits):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.jsonl", "w") as f:
        for h in hits:
            f.write((h if isinstance(h, str) else json.dumps({"objectID": h[0], "created_at_i": h[1]})) + "\n")


def test_overlapping_polls_and_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "polls"), str(tmp_path / "out")
    _poll(folder, "2024-01-01", ("a", 1000), ("b", 2000), "broken", '{"objectID": "x"}')
    _poll(folder, "2024-01-02", ("b", 2000), ("c", 3000), ("old", 10))

    def run():
        s = polls.read_polls(spark, folder, lookback_seconds=2500).withColumn("at", F.timestamp_seconds("created_at_i"))
        once = s.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["source_uid"]).select("source_uid", "poll")
        q = once.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{out}/t").collect())

    first = [("a", "2024-01-01.jsonl"), ("b", "2024-01-01.jsonl"), ("c", "2024-01-02.jsonl")]
    assert run() == first
    assert run() == first  # nothing new
    _poll(folder, "2024-01-03", ("c", 3000), ("d", 4000))
    assert run() == [*first, ("d", "2024-01-03.jsonl")]


def test_months_and_views_with_a_ledger(spark, tmp_path):
    at = tmp_path / "nyt"
    (at / "Acme Co").mkdir(parents=True)
    (at / "Acme Co" / "2023-07.json").write_text('{"company": "Acme Co", "query": "q", "month": "2023-07", "hits": 3, "docs": [{"x": 1}, {"x": 2}], "fetched_at": "t"}')
    (at / "Acme Co" / "2023-08.json").write_text('{"query": "q", "docs": null}')
    (at / "Acme Co" / "2023-09.json").write_text('{"query": "q", "hits": 3')
    (at / "Acme Co" / "soon.json").write_text('{"hits": 1}')
    rows, ledger = landed.read_months(spark, str(at))
    assert sorted((r.company, str(r.month), r.hits, r.n_docs) for r in rows.collect()) == [("Acme Co", "2023-07-01", 3, 2), ("Acme Co", "2023-08-01", None, 0)]
    assert sorted((r.file.rsplit("/", 1)[1], r.drop_reason) for r in ledger.collect()) == [("2023-09.json", "broken_json"), ("soon.json", "no_month")]
    views = tmp_path / "views"
    views.mkdir()
    item = lambda m, v: {"timestamp": f"{m}0100", "views": v}
    (views / "acme.json").write_text(json.dumps({"company": "Acme", "article_created": "2020-03-15T00:00:00Z", "title_history_inherited": True, "views_by_title": {"Acme": 5, "Acme Inc": 2}, "items": [item("202002", 9), item("202003", 4), item("202004", None), {"timestamp": "x"}]}))
    (views / "none.json").write_text('{"company": "None", "items": null}')
    (views / "bad.json").write_text("[")
    months, titles, ledger = landed.read_pageviews(spark, str(views))
    assert sorted((str(r.month), r.views, r.article_existed, r.creation_month, r.inherited) for r in months.collect()) == [("2020-02-01", 9, False, False, True), ("2020-03-01", 4, True, True, True), ("2020-04-01", 0, True, False, True)]
    assert sorted(map(tuple, titles.collect())) == [("Acme", "Acme", 5), ("Acme", "Acme Inc", 2)]
    assert sorted(r.drop_reason for r in ledger.collect()) == ["broken_json", "no_month"]


def test_counts_cost_no_second_scan(spark, tmp_path):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    got = landed.write_counted(spark.range(100), str(tmp_path / "t"), {"n": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0)})
    done = jobs.getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"n": 100, "even": 50} and len(done) == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_a_queue_without_a_limit_is_whole_and_in_order(spark, tmp_path):
    landed.write_queue(spark.range(5000).repartition(7), str(tmp_path / "q"), [F.desc("id")])
    lines = [x for f in sorted(os.listdir(tmp_path / "q")) if f.startswith("part") for x in (tmp_path / "q" / f).read_text().split() if x != "id"]
    assert lines == [str(i) for i in range(4999, -1, -1)]
