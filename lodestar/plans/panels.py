"""Attention panels: daily and windowed mentions against returns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import attention, timeseries as ts
from .bindings import BARS, FILINGS, LISTINGS, MENTIONS, MONTHLY, Tables
from .registry import query


@query("attention_panel", f"""
with {MENTIONS}, {BARS},
d as (select issuer_id, posted_at::date as day, count(*) mention_count, sum(engagement) engagement from mentions where not needs_review group by 1, 2),
r as (select issuer_id, day, close, lead(close) over (partition by issuer_id order by day) next_close from bars where close > 0)
select d.issuer_id, d.day, mention_count, round(engagement, 6) engagement, round(close, 6) as close, round(next_close / close - 1, 6) next_return
from d join r on d.issuer_id = r.issuer_id and d.day = r.day where next_close is not null""")
def attention_panel(t: Tables):
    p = attention.panel(t.mentions.where("not needs_review and issuer_id is not null"), t.bars)
    return p.select("issuer_id", "day", "mention_count", F.round("engagement", 6).alias("engagement"), F.round("close", 6).alias("close"), F.round("next_return", 6).alias("next_return"))


@query("mention_daily", f"""
with {MENTIONS} select issuer_id, source, posted_at::date as day, count(*) mention_count, count(distinct floor(engagement)) unique_authors, round(sum(engagement), 4) weighted_engagement
from mentions group by 1, 2, 3""")
def mention_daily(t: Tables):
    m = t.mentions.withColumn("author", F.floor("engagement"))
    return attention.daily_rollup(m, "author").withColumn("weighted_engagement", F.round("weighted_engagement", 4))


@query("event_window_attention", f"""
with {MENTIONS}, {LISTINGS}
select l.issuer_id, l.listed_on, count(m.mention_id) n_points from listings l
left join mentions m on m.issuer_id = l.issuer_id and not needs_review and posted_at >= l.listed_on - interval 14 day and posted_at < l.listed_on + interval 15 day group by 1, 2""")
def event_window_attention(t: Tables):
    return ts.window_counts(t.listings.select("issuer_id", "listed_on"), t.mentions.where("not needs_review"), "issuer_id", "posted_at", "listed_on", 14, 14)


@query("mention_spikes", f"""
with {MENTIONS}, d as (select issuer_id, posted_at::date as day, count(*) n from mentions group by 1, 2),
z as (select *, avg(n) over w m, stddev_samp(n) over w s from d window w as (partition by issuer_id order by day range between interval 7 day preceding and interval 1 day preceding))
select issuer_id, day, n, round((n - m) / s, 6) z from z where s > 0 and (n - m) / s > 1""")
def mention_spikes(t: Tables):
    d = t.mentions.groupBy("issuer_id", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("n"))
    return ts.trailing_z(d, "issuer_id", "day", "n", 7).where("z > 1").select("issuer_id", "day", "n", F.round("z", 6).alias("z"))


@query("hype_zscore", f"""
with {MENTIONS}, v as (select issuer_id, count(*) volume, count(*) filter (where posted_at >= timestamp '2024-01-16') - count(*) filter (where posted_at < timestamp '2024-01-16') velocity, avg(engagement) quality from mentions where not needs_review group by 1),
z as (select *, (volume - avg(volume) over ()) / stddev_samp(volume) over () vz, (velocity - avg(velocity) over ()) / stddev_samp(velocity) over () ez, (quality - avg(quality) over ()) / stddev_samp(quality) over () qz from v)
select issuer_id, volume, velocity, round((vz + ez) / 2, 6) hype, round(qz, 6) quality, round(qz - (vz + ez) / 2, 6) gem from z""")
def hype_zscore(t: Tables):
    cut = F.lit("2024-01-16").cast("timestamp")
    v = t.mentions.where("not needs_review").groupBy("issuer_id").agg(
        F.count("*").alias("volume"), (F.count_if(F.col("posted_at") >= cut) - F.count_if(F.col("posted_at") < cut)).alias("velocity"), F.avg("engagement").alias("quality")
    )
    z = attention.cohort_z(v, ["volume", "velocity", "quality"])
    hype = (F.col("volume_z") + F.col("velocity_z")) / 2
    return z.select("issuer_id", "volume", "velocity", F.round(hype, 6).alias("hype"), F.round("quality_z", 6).alias("quality"), F.round(F.col("quality_z") - hype, 6).alias("gem"))


_ANCHOR = "anchor as (select issuer_id, min(filed_on) s1 from filings where form = 'S-1' group by 1)"


@query("abnormal_attention_daily", f"""
with {MENTIONS}, e as (select issuer_id, date '2024-01-25' event_day from (select distinct issuer_id from mentions)),
d as (select issuer_id, posted_at::date as day, sum(engagement) v from mentions group by 1, 2),
g as (select e.issuer_id, count(*) filter (where off between -5 and -1) event_days, count(*) filter (where off between -20 and -6) base_days,
  avg(v) filter (where off between -5 and -1) ev, avg(v) filter (where off between -20 and -6) bv
  from (select e.issuer_id, d.v, datediff('day', e.event_day, d.day) off from e join d on e.issuer_id = d.issuer_id) e group by 1)
select issuer_id, event_days, base_days, case when event_days >= 4 and base_days >= 10 and bv <> 0 then round(ev / bv, 6) end abnormal from g where event_days + base_days > 0""")
def abnormal_attention_daily(t: Tables):
    d = t.mentions.groupBy("issuer_id", F.to_date("posted_at").alias("day")).agg(F.sum("engagement").alias("v"))
    e = t.mentions.select("issuer_id").distinct().withColumn("event_day", F.lit("2024-01-25").cast("date"))
    out = attention.abnormal_daily(e, d, "issuer_id", "event_day", "day", "v", event=(-5, -1), baseline=(-20, -6), least_event=4, least_base=10)
    return out.select("issuer_id", "event_days", "base_days", F.round("abnormal", 6).alias("abnormal"))


@query("abnormal_ratio_monthly", f"""
with {FILINGS}, {MONTHLY}, {_ANCHOR},
j as (select a.issuer_id, s1, m.month, m.views, (year(m.month) - year(s1)) * 12 + month(m.month) - month(s1) rel from anchor a join monthly m on a.issuer_id = m.issuer_id),
g as (select issuer_id, max(case when rel = 0 then views end) at_event, count(*) filter (where month < s1 - interval 1 month and month >= s1 - interval 13 month) base_months,
  quantile_cont(case when month < s1 - interval 1 month and month >= s1 - interval 13 month then views end, 0.5) base from j group by 1)
select issuer_id, at_event, base_months, round(base, 6) base, case when base_months >= 2 then round(at_event / greatest(base, 1), 4) end ratio,
  case when base_months >= 2 then at_event / greatest(base, 1) > 1 end rose, base >= 500 baseline_reliable from g""")
def abnormal_ratio_monthly(t: Tables):
    a = t.filings.where("form = 'S-1'").groupBy("issuer_id").agg(F.min("filed_on").alias("s1"))
    return attention.abnormal_monthly(a, t.monthly, "issuer_id", "s1", "month", "views", least=2)


@query("floor_ladder", f"""
with {FILINGS}, {MONTHLY}, {_ANCHOR},
j as (select a.issuer_id, s1, m.month, m.views, (year(m.month) - year(s1)) * 12 + month(m.month) - month(s1) rel from anchor a join monthly m on a.issuer_id = m.issuer_id),
g as (select issuer_id, max(case when rel = 0 then views end) at_event, count(*) filter (where month < s1 - interval 1 month and month >= s1 - interval 13 month) n,
  quantile_cont(case when month < s1 - interval 1 month and month >= s1 - interval 13 month then views end, 0.5) base from j group by 1),
r as (select base, at_event / greatest(base, 1) ratio from g where n >= 2)
select f.floor_views, count(*) entities, count(*) filter (where ratio > 1) rose, round(quantile_cont(ratio, 0.5), 4) median_ratio
from r join (values (0), (100000), (200000), (300000)) f(floor_views) on base >= f.floor_views group by 1""")
def floor_ladder(t: Tables):
    a = t.filings.where("form = 'S-1'").groupBy("issuer_id").agg(F.min("filed_on").alias("s1"))
    return attention.floor_ladder(attention.abnormal_monthly(a, t.monthly, "issuer_id", "s1", "month", "views", least=2, digits=12), [0, 100000, 200000, 300000])


@query("balanced_windows", f"""
with {FILINGS}, {MONTHLY}, {_ANCHOR},
j as (select a.issuer_id, m.views, (year(m.month) - year(s1)) * 12 + month(m.month) - month(s1) rel from anchor a join monthly m on a.issuer_id = m.issuer_id),
w as (select issuer_id, avg(views) filter (where rel between -24 and -13) base, avg(views) filter (where rel between -12 and -1) quiet, avg(views) filter (where rel between 0 and 3) public from j group by 1)
select count(*) entities, round(quantile_cont(base, 0.5), 4) base, round(quantile_cont(quiet, 0.5), 4) quiet, round(quantile_cont(public, 0.5), 4) public,
  round(quantile_cont(quiet / base, 0.5), 6) quiet_ratio, round(quantile_cont(public / base, 0.5), 6) public_ratio
from w where base is not null and quiet is not null and public is not null and base > 0""")
def balanced_windows(t: Tables):
    a = t.filings.where("form = 'S-1'").groupBy("issuer_id").agg(F.min("filed_on").alias("s1"))
    return attention.balanced_windows(a, t.monthly, "issuer_id", "s1", "month", "views", {"base": (-24, -13), "quiet": (-12, -1), "public": (0, 3)})


@query("relative_share", f"""
with {FILINGS}, {MONTHLY}, {_ANCHOR},
j as (select a.issuer_id, m.views, (year(m.month) - year(s1)) * 12 + month(m.month) - month(s1) rel from anchor a join monthly m on a.issuer_id = m.issuer_id),
w as (select *, sum(views) over (partition by issuer_id) total, count(*) over (partition by issuer_id) got from j where rel between -12 and 3)
select issuer_id, rel, views, case when total > 0 then round(views / total, 6) end share, got months_collected, 16 months_expected, round(got / 16, 4) coverage from w""")
def relative_share(t: Tables):
    a = t.filings.where("form = 'S-1'").groupBy("issuer_id").agg(F.min("filed_on").alias("s1"))
    return attention.relative_share(a, t.monthly, "issuer_id", "s1", "month", "views", (-12, 3))


@query("post_listing_frame", f"""
with {BARS}, m as (select user_id issuer_id, event_type series, date_trunc('month', ts)::date as month, sum(value) v from events where event_type in ('view', 'click') group by 1, 2, 3)
select b.issuer_id, b.day, round(b.close, 6) as close, round(v.v, 6) "view", round(c.v, 6) click from bars b
left join m v on v.issuer_id = b.issuer_id and v.month = date_trunc('month', b.day) and v.series = 'view'
left join m c on c.issuer_id = b.issuer_id and c.month = date_trunc('month', b.day) and c.series = 'click'""")
def post_listing_frame(t: Tables):
    m = t.mentions.where("not needs_review").groupBy("issuer_id", F.trunc("posted_at", "MM").alias("month"), F.col("source").alias("series")).agg(F.sum("engagement").alias("v"))
    out = attention.with_monthly_series(t.bars, m, "issuer_id", "day", "month", "series", "v", ["view", "click"])
    return out.select("issuer_id", "day", *[F.round(c, 6).alias(c) for c in ("close", "view", "click")])


@query("long_panel", f"""
with {MONTHLY}, {MENTIONS}
select issuer_id, month period, 'orders' series, 'month' resolution, round(views, 4)::double as value, null::varchar flag from monthly
union all select issuer_id, posted_at::date, 'mentions', 'day', count(*)::double, null from mentions where not needs_review group by 1, 2
union all select issuer_id, posted_at::date, 'errors', 'day', count(*)::double, 'review' from mentions where needs_review group by 1, 2""")
def long_panel(t: Tables):
    daily = t.mentions.groupBy("issuer_id", F.to_date("posted_at").alias("period"), "needs_review").agg(F.count("*").cast("double").alias("value"))
    return attention.long_panel([
        ("orders", "month", None, t.monthly.select("issuer_id", F.col("month").alias("period"), F.col("views").cast("double").alias("value"))),
        ("mentions", "day", None, daily.where("not needs_review").drop("needs_review")),
        ("errors", "day", "review", daily.where("needs_review").drop("needs_review")),
    ])


@query("merge_aliased_series", """
select user_id % 10 entity, ts::date as day, sum(n)::bigint views from (select user_id, ts, (json_extract(props, '$.k'))::bigint n from events) group by 1, 2""")
def merge_aliased_series(t: Tables):
    views = t.events.select("user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("n")).groupBy(F.col("user_id").alias("title"), F.to_date("ts").alias("day")).agg(F.sum("n").alias("views"))
    titles = views.select("title", (F.col("title") % 10).alias("entity")).distinct()
    return attention.merge_aliased(views, titles, "title", "entity", "day", "views")


@query("interval_compare", """
with c as (select user_id entity, count(*) filter (where ts < timestamp '2024-01-16') pre, count(*) filter (where ts >= timestamp '2024-01-16') post, bool_and(event_type <> 'error') filter (where ts < timestamp '2024-01-16') pre_exact, bool_and(event_type <> 'error') filter (where ts >= timestamp '2024-01-16') post_exact from events group by 1)
select entity, pre, post, coalesce(pre_exact, true) pre_exact, coalesce(post_exact, true) post_exact, post > (case when coalesce(pre_exact, true) then pre else 'inf'::double end) post_exceeds, pre > (case when coalesce(post_exact, true) then post else 'inf'::double end) pre_exceeds,
 (post > (case when coalesce(pre_exact, true) then pre else 'inf'::double end)) or (pre > (case when coalesce(post_exact, true) then post else 'inf'::double end)) direction_established,
 coalesce(pre_exact, true) and coalesce(post_exact, true) magnitude_valid from c""")
def interval_compare(t: Tables):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    exact = F.col("event_type") != "error"
    c = t.events.groupBy(F.col("user_id").alias("entity")).agg(
        F.count_if(~late).alias("pre"), F.count_if(late).alias("post"), F.coalesce(F.bool_and(F.when(~late, exact)), F.lit(True)).alias("pre_exact"), F.coalesce(F.bool_and(F.when(late, exact)), F.lit(True)).alias("post_exact")
    )
    return attention.compare_counts(c, "pre", "post", "pre_exact", "post_exact")


@query("window_bucket", f"""
with {MENTIONS}, {LISTINGS}, o as (select issuer_id, min(posted_at)::date oldest from mentions group by 1)
select l.issuer_id, listed_on, count(*) filter (where posted_at::date >= listed_on - 10 and posted_at::date < listed_on) pre_count, count(*) filter (where posted_at::date > listed_on and posted_at::date <= listed_on + 10) post_count,
  max(oldest) <= listed_on - 10 pre_complete, max(oldest) <= listed_on post_complete
from listings l left join mentions m on m.issuer_id = l.issuer_id left join o on o.issuer_id = l.issuer_id group by 1, 2""")
def window_bucket(t: Tables):
    return attention.bucket_windows(t.listings.select("issuer_id", "listed_on"), t.mentions, "issuer_id", "listed_on", "posted_at", 10)


@query("censored_density", """
with c as (select user_id entity, count(*) n, (max(ts)::date - min(ts)::date) + 1 span, count(distinct ts::date) covered from events where event_type = 'click' group by 1)
select entity, n, span, round(covered / 31, 4) coverage, case when covered / 31 >= 0.2 then round(n / covered, 4) end density, n > 10 volume_exceeds_budget from c""")
def censored_density(t: Tables):
    c = t.events.where("event_type = 'click'").groupBy(F.col("user_id").alias("entity")).agg(
        F.count("*").alias("n"), (F.datediff(F.max("ts"), F.min("ts")) + 1).cast("long").alias("span"), F.countDistinct(F.to_date("ts")).alias("covered")
    )
    return attention.censored_density(c, "n", "covered", F.lit(31), budget=10).select("entity", "n", "span", "coverage", "density", "volume_exceeds_budget")


@query("count_quality", """
with c as (select user_id entity, event_type win, count(*) fetched, count(*) filter (where value < 5) off_target, count(*) >= 14 capped from events group by 1, 2)
select entity, win, fetched, round(off_target / fetched, 3) off_target_fraction, case when not capped then 'exact' when off_target / fetched > 0.15 then 'unreliable_window' else 'lower_bound' end quality,
  not (capped and off_target / fetched > 0.15) usable from c""")
def count_quality(t: Tables):
    c = t.events.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("win")).agg(F.count("*").alias("fetched"), F.count_if(F.col("value") < 5).alias("off_target"))
    return attention.count_quality(c, "fetched", "off_target", F.col("fetched") >= 14, 0.15).drop("off_target")
