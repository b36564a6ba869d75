"""The streaming jobs over the tables' files; each processes all there is and returns its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.workspace import folder
from ..operators import match
from ..sources.polls import read_polls
from ..sources.store import SnapshotStore
from ..streaming import stateful, streams as st
from .bindings import MENTIONS, Tables
from .registry import query
from .texts import _ALIAS, _GRAMS, _aliases


def _mentions(t: Tables):
    e = st.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    return e.where(F.col("event_type").isin("view", "click", "error")).select(F.col("event_id").alias("mention_id"), F.col("user_id").alias("issuer_id"), F.col("event_type").alias("source"), F.col("ts").alias("posted_at"), F.col("value").alias("engagement"), F.floor("value").alias("author"))


@query("stream_mention_daily", f"with {MENTIONS} select issuer_id, source, posted_at::date as day, count(*) mention_count, round(sum(engagement), 6) engagement, count(distinct floor(engagement)) unique_authors from mentions where posted_at::date + interval 1 day <= (select max(posted_at) from mentions) - interval 7 day group by 1, 2, 3")
def stream_mention_daily(t: Tables):
    out = st.run_to_table(st.daily_rollup(st.unique_mentions(_mentions(t))), "rollup")
    return out.select("issuer_id", "source", "day", "mention_count", F.round("engagement", 6).alias("engagement"), "unique_authors")


@query("stream_dedupe", f"with {MENTIONS} select mention_id, issuer_id, source from mentions")
def stream_dedupe(t: Tables):
    m = _mentions(t)
    return st.run_to_table(st.unique_mentions(m.union(m)).select("mention_id", "issuer_id", "source"), "dedupe")


@query("stream_polls", "select event_id::varchar source_uid, date_trunc('second', ts) posted_at from events")
def stream_polls(t: Tables):
    """Four polls of ten days, each of which looks back two days; a run after each two, each key once."""
    at, out = folder(t.spark, "polls"), folder(t.spark, "polled")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    polls = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when((day >= k * 10 - 2) & (day < k * 10 + 10), k)), lambda k: k.isNotNull())
    hit = F.to_json(F.struct(F.col("event_id").cast("string").alias("objectID"), F.unix_seconds("ts").alias("created_at_i")))
    landed = t.events.select(F.explode(polls).alias("poll"), hit.alias("value"))
    for first, last in ((0, 1), (2, 3)):
        landed.where(F.col("poll").between(first, last)).write.partitionBy("poll").mode("append").text(at)
        hits = read_polls(t.spark, at, lookback_seconds=14 * 86_400).select("source_uid", F.timestamp_seconds("created_at_i").alias("posted_at"))
        once = hits.withWatermark("posted_at", "7 days").dropDuplicatesWithinWatermark(["source_uid"])
        table = st.run_to_table(once, "polls", at=out)
    return table.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))


@query("stream_entity_state", "select user_id, max(case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else -1 end) rank from events group by 1")
def stream_entity_state(t: Tables):
    e = st.read_stream(t.spark, f"{t.sf_dir}/events.parquet")
    ranked = e.select("user_id", F.expr("case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else -1 end").alias("rank"))
    snapshot = SnapshotStore(t.spark, folder(t.spark, "state"), ["user_id"])
    st.run_each_batch(ranked, "state", lambda batch, i, at: snapshot.apply(batch, i, st.furthest("user_id", "rank")), mode="append")
    return snapshot.read()


@query("stream_enrich", f"with {_ALIAS}, {_GRAMS} select doc_id, issuer_id, kind from g join a on g.g = a.alias where kind <> 'brand'")
def stream_enrich(t: Tables):
    docs = st.read_stream(t.spark, f"{t.sf_dir}/documents.parquet")
    # A gram may be an alias once a document: array_distinct makes it so, and no state is needed.
    hits = match.candidates(docs, _aliases(t).where("kind <> 'brand'"), "doc_id", F.col("text"))
    return st.run_to_table(hits.select("doc_id", "issuer_id", "kind"), "enrich")


@query("stream_promotion", """
with s as (select event_id listing_id, user_id issuer_id, ts listed_at from events where event_type = 'signup'), p as (select event_id bar_id, user_id issuer_id, ts bar_at, value price from events where event_type = 'purchase'),
e as (select max(ts) m from events where event_type in ('signup', 'purchase')),
f as (select listing_id, any_value(s.issuer_id) issuer_id, any_value(listed_at) listed_at, arg_min(bar_id, (bar_at, bar_id)) bar_id, min(bar_at) bar_at, arg_min(price, (bar_at, bar_id)) price from s left join p on s.issuer_id = p.issuer_id and bar_at >= listed_at and bar_at <= listed_at + interval 2 day group by 1)
select issuer_id, listing_id, bar_id, round(price, 6) price, case when bar_id is null then 'awaiting_bar' else 'listed' end status from f, e
where date_trunc('millisecond', bar_at) < date_trunc('millisecond', m) or bar_id is null and date_trunc('millisecond', listed_at) + interval 2 day < date_trunc('millisecond', m)""")
def stream_promotion(t: Tables):
    e = lambda kind: st.read_stream(t.spark, f"{t.sf_dir}/events.parquet").where(F.col("event_type") == kind)
    listings = e("signup").select(F.col("event_id").alias("listing_id"), F.col("user_id").alias("issuer_id"), F.col("ts").alias("listed_at"))
    bars = e("purchase").select(F.col("event_id").alias("bar_id"), F.col("user_id").alias("issuer_id"), F.col("ts").alias("bar_at"), F.col("value").alias("price"))
    out = st.run_to_table(stateful.promotions(listings, bars, 2, late="0 seconds"), "promotion")
    return out.select("issuer_id", "listing_id", "bar_id", F.round("price", 6).alias("price"), "status")


@query("stream_retention", f"""
with {MENTIONS}, m as (select mention_id, case when mention_id % 10 <> 0 then issuer_id end issuer_id, source, posted_at from mentions), r as (select distinct issuer_id, source, posted_at::date as day from m where issuer_id % 3 <> 0),
j as (select m.*, r.day is not null rolled, posted_at::date < (select max(posted_at)::date from m) - 15 expired from m left join r on m.issuer_id = r.issuer_id and m.source = r.source and m.posted_at::date = r.day)
select mention_id from j where expired and (issuer_id is null or rolled)""")
def stream_retention(t: Tables):
    m = _mentions(t).select("mention_id", F.when(F.col("mention_id") % 10 != 0, F.col("issuer_id")).alias("issuer_id"), "source", "posted_at")
    marks = m.where("issuer_id % 3 <> 0").select("issuer_id", "source", F.to_date("posted_at").alias("day"), F.col("posted_at").alias("rolled_at"))
    return st.run_to_table(stateful.expired_mentions(m, marks, 15), "retention")


@query("stream_enrich_refreshed", f"with {_ALIAS}, {_GRAMS} select doc_id, issuer_id, kind from g join a on g.g = a.alias where kind = 'legal'")
def stream_enrich_refreshed(t: Tables):
    docs = st.read_stream(t.spark, f"{t.sf_dir}/documents.parquet")

    def act(batch, i, at):
        # The aliases are read again for every batch, so a batch sees those of its time.
        fresh = _aliases(Tables(batch.sparkSession, t.sf_dir)).where("kind = 'legal'")
        match.candidates(batch, fresh, "doc_id", F.col("text")).select("doc_id", "issuer_id", "kind").write.mode("overwrite").parquet(f"{at}/hits/batch={i}")

    at = st.run_each_batch(docs, "refresh", act, mode="append")
    return t.spark.read.parquet(f"{at}/hits").drop("batch")
