"""Series, as-of joins, windows, ranks, paging and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.numbers import quotient
from ..operators import paging, timeseries as ts
from ..operators.scan import month, running
from .bindings import BARS, FILINGS, LISTINGS, MENTIONS, Tables
from .registry import query


@query("forward_return", f"""
with {BARS} select * from (select issuer_id, day, round(close, 6) as close, round(lead(close) over (partition by issuer_id order by day) / close - 1, 6) next_return from bars where close > 0)""")
def forward_return(t: Tables):
    return ts.forward_return(t.bars).select("issuer_id", "day", F.round("close", 6).alias("close"), F.round("next_return", 6).alias("next_return"))


_SESSIONS = f"""with {BARS}, s as (select issuer_id, day, close, row_number() over w - 1 as session, first(day) over w first_day, close / first(close) over w - 1 since_first from bars window w as (partition by issuer_id order by day))"""


@query("session_index", f"{_SESSIONS} select issuer_id, day, session::int as session, first_day, round(since_first, 6) since_first, session < 20 in_window from s")
def session_index(t: Tables):
    return ts.sessions(t.bars, within=20).select("issuer_id", "day", "session", "first_day", F.round("since_first", 6).alias("since_first"), "in_window")


@query("month_marker", f"{_SESSIONS} select issuer_id, day, session = max(session) over (partition by issuer_id, date_trunc('month', day)) month_end from s")
def month_marker(t: Tables):
    return ts.sessions(t.bars).select("issuer_id", "day", "month_end")


@query("session_returns", f"""{_SESSIONS} select issuer_id, {", ".join(f"round(max(case when session = {h} then close end) / max(case when session = 0 then close end) - 1, 6) ret_{h}" for h in (5, 10, 20))} from s group by 1""")
def session_returns(t: Tables):
    r = ts.horizon_returns(t.bars, [5, 10, 20])
    return r.select("issuer_id", *[F.round(c, 6).alias(c) for c in r.columns if c != "issuer_id"])


@query("calendar_returns", f"""
with {BARS}, {LISTINGS}, h(horizon) as (values (5), (10), (20)),
x as (select l.issuer_id, l.open_price, horizon, l.listed_on + horizon::int target from listings l, h),
a as (select x.issuer_id, horizon, open_price, min(b.day) d, arg_min(b.close, b.day) c from x left join bars b on b.issuer_id = x.issuer_id and b.day >= target group by all)
select issuer_id, horizon, d asof_day, round(c / open_price - 1, 6) ret from a""")
def calendar_returns(t: Tables):
    x = t.listings.withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).select("issuer_id", "open_price", "horizon", F.date_add("listed_on", F.col("horizon")).alias("target"))
    a = ts.asof_forward(x, t.bars, "issuer_id", "target", "day", "close")
    return a.select("issuer_id", "horizon", "asof_day", F.round(quotient(F.col("asof_value"), F.col("open_price")) - 1, 6).alias("ret"))


@query("asof_forward_return", f"""
with {BARS}, {LISTINGS}, x as (select issuer_id, open_price, listed_on + 14 target from listings),
a as (select x.issuer_id, target, open_price, min(b.day) d, arg_min(b.close, b.day) c from x left join bars b on b.issuer_id = x.issuer_id and b.day >= target and b.day <= target + 10 group by all)
select issuer_id, target, d asof_day, round(c, 6) asof_value, round(c / open_price - 1, 6) ret from a""")
def asof_forward_return(t: Tables):
    x = t.listings.select("issuer_id", "open_price", F.date_add("listed_on", 14).alias("target"))
    a = ts.asof_forward(x, t.bars, "issuer_id", "target", "day", "close", reach=10)
    return a.select("issuer_id", "target", "asof_day", F.round("asof_value", 6).alias("asof_value"), F.round(quotient(F.col("asof_value"), F.col("open_price")) - 1, 6).alias("ret"))


@query("asof_nearest", f"""
with {FILINGS}, o as (select issuer_id, filing_id offer_id, filed_on offer_on from filings where form = 'S-1'), f as (select issuer_id, filing_id, filed_on from filings where form = '424B4'),
j as (select o.*, f.filing_id near_key, abs(f.filed_on - o.offer_on) gap from o left join f on f.issuer_id = o.issuer_id and abs(f.filed_on - o.offer_on) <= 25)
select offer_id, issuer_id, near_key, gap::int gap_days from (select *, row_number() over (partition by offer_id order by gap, near_key) k from j) where k = 1""")
def asof_nearest(t: Tables):
    o = t.filings.where("form = 'S-1'").select("issuer_id", F.col("filing_id").alias("offer_id"), F.col("filed_on").alias("offer_on"))
    return ts.asof_nearest(o, t.filings.where("form = '424B4'"), "issuer_id", "offer_on", "filed_on", "filing_id", 25).select("offer_id", "issuer_id", "near_key", "gap_days")


@query("asof_slack", f"""
with {BARS}, {LISTINGS}, a as (select l.issuer_id, l.listed_on, min(b.day) d, arg_min(b.close, b.day) c from listings l left join bars b on b.issuer_id = l.issuer_id and b.day >= l.listed_on - 2 and b.close is not null group by all)
select issuer_id, listed_on, case when abs(d - listed_on) <= 7 then d end slack_day, case when abs(d - listed_on) <= 7 then round(c, 6) end slack_value from a""")
def asof_slack(t: Tables):
    return ts.asof_slack(t.listings.select("issuer_id", "listed_on"), t.bars, "issuer_id", "listed_on", "day", "close").withColumn("slack_value", F.round("slack_value", 6))


@query("asof_backward", f"""
with {FILINGS}, {LISTINGS}, c as (select distinct issuer_id, date '1999-01-01' cutoff from filings),
j as (select c.*, f.filing_id, f.form, row_number() over (partition by c.issuer_id order by f.filed_on desc, f.filing_id desc) k from c left join filings f on f.issuer_id = c.issuer_id and f.filed_on <= cutoff)
select issuer_id, cutoff, filing_id asof_filing_id, form asof_form from j where k = 1""")
def asof_backward(t: Tables):
    c = t.filings.select("issuer_id").distinct().withColumn("cutoff", F.lit("1999-01-01").cast("date"))
    return ts.asof_backward(c, t.filings, "issuer_id", "cutoff", ["filed_on", "filing_id"], ["filing_id", "form"])


@query("average_rank", f"with {BARS} select issuer_id, day, volume, (rank() over (order by volume) + (count(*) over (partition by volume) - 1) / 2)::double avg_rank from bars")
def average_rank(t: Tables):
    return ts.average_rank(t.bars.select("issuer_id", "day", "volume"), "volume")


@query("interval_union", """
with i as (select user_id entity, ts::date lo, ts::date + (1 + event_id % 4)::int hi from events where event_type = 'click'),
d as (select distinct entity, lo + k::int as day from i, range(0, 10) r(k) where lo + k::int < hi),
g as (select entity, day, day - row_number() over (partition by entity order by day)::int isle from d)
select entity, count(*) covered_days, count(distinct isle) islands from g group by 1""")
def interval_union(t: Tables):
    i = t.events.where("event_type = 'click'").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("lo"), F.date_add(F.to_date("ts"), (1 + F.col("event_id") % 4).cast("int")).alias("hi"))
    return ts.interval_union_days(i, "entity", "lo", "hi")


@query("sliding_rate_exceeded", """
select event_id, user_id, n, n >= 3 exceeded from (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 7200 second preceding and current row) n from events) where n >= 2""")
def sliding_rate_exceeded(t: Tables):
    return t.events.select("event_id", "user_id", ts.sliding_count(t.events, "user_id", "ts", 7200).alias("n")).where("n >= 2").withColumn("exceeded", F.col("n") >= 3)


@query("latest_per_key", f"with {FILINGS} select issuer_id, filing_id, form, filed_on from (select *, row_number() over (partition by issuer_id order by filed_on desc, filing_id desc) k from filings) where k = 1")
def latest_per_key(t: Tables):
    return paging.latest(t.filings, ["issuer_id"], ["filed_on", "filing_id"]).select("issuer_id", "filing_id", "form", "filed_on")


@query("calendar_windows", """
with b as (select o_custkey issuer_id, min(o_orderdate)::date s, max(o_orderdate)::date e from orders group by 1),
m as (select issuer_id, s, e, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), interval 1 month))::date m from b)
select issuer_id, greatest(m, s) month_start, least(last_day(m), e) month_end from m""")
def calendar_windows(t: Tables):
    b = t.filings.groupBy("issuer_id").agg(F.min("filed_on").alias("s"), F.max("filed_on").alias("e"))
    return ts.calendar_windows(b, "s", "e").drop("s", "e")


@query("date_math", """
select o_orderkey, last_day(o_orderdate)::date month_end, (o_orderdate::date + interval 3 month)::date plus3, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 rel_month, year(o_orderdate) || 'Q' || quarter(o_orderdate) year_quarter, date_diff('day', date '1995-01-01', o_orderdate::date) gap from orders""")
def date_math(t: Tables):
    d, zero = F.col("o_orderdate"), F.lit("1995-01-01").cast("date")
    return t.orders.select("o_orderkey", F.last_day(d).alias("month_end"), F.add_months(d, 3).alias("plus3"), dates.months_between(zero, d).alias("rel_month"), dates.year_quarter(d).alias("year_quarter"), dates.gap_days(zero, F.to_date(d)).alias("gap"))


@query("parse_ts", "select event_id, case when event_id % 7 <> 0 then date_trunc('second', ts) end parsed from events")
def parse_ts(t: Tables):
    s = F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")))
    return t.events.select("event_id", dates.parse_created_at(s).cast("timestamp_ntz").alias("parsed"))


@query("entity_windows", f"""
with {FILINGS}, a as (select issuer_id, min(filed_on) filter (where form = 'S-1') reg, max(filed_on) filter (where form = '424B4') listed from filings group by 1)
select issuer_id, reg, coalesce(listed, reg) listed, (date_trunc('month', reg) - interval 24 month)::date win_start, (date_trunc('month', coalesce(listed, reg)) + interval 3 month)::date win_end, reg - 90 pre_start, coalesce(listed, reg) + 90 post_end from a where reg is not null""")
def entity_windows(t: Tables):
    form = F.col("form")
    a = t.filings.groupBy("issuer_id").agg(F.min(F.when(form == "S-1", F.col("filed_on"))).alias("reg"), F.max(F.when(form == "424B4", F.col("filed_on"))).alias("listed")).where("reg is not null")
    a = a.withColumn("listed", F.coalesce("listed", "reg"))
    return a.select("issuer_id", "reg", "listed", F.add_months(F.trunc("reg", "MM"), -24).alias("win_start"), F.add_months(F.trunc("listed", "MM"), 3).alias("win_end"), F.date_sub("reg", 90).alias("pre_start"), F.date_add("listed", 90).alias("post_end"))


@query("keyset_page", f"""
with {FILINGS}, k as (select *, coalesce(case when filing_id % 5 <> 0 then filed_on end, date '0001-01-01') sort_key from filings),
p as (select filing_id, sort_key from k where status = 'F' and (sort_key < date '2000-06-01' or (sort_key = date '2000-06-01' and filing_id < 1000)) order by sort_key desc, filing_id desc limit 51)
select filing_id, sort_key, (select count(*) from p) > 50 has_more from p order by sort_key desc, filing_id desc limit 50""")
def keyset_page(t: Tables):
    import datetime

    f = t.filings.withColumn("at", F.when(F.col("filing_id") % 5 != 0, F.col("filed_on")))
    return paging.keyset_page(f, "at", "filing_id", size=50, after=(datetime.date(2000, 6, 1), 1000), where={"status": "F"}).select("filing_id", "sort_key", "has_more")


@query("topk_attention", f"with {MENTIONS} select issuer_id, count(*) n from mentions where not needs_review group by 1 order by 2 desc, 1 limit 10")
def topk_attention(t: Tables):
    return t.mentions.where("not needs_review").groupBy("issuer_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issuer_id").limit(10)


@query("latest_session_gap", f"with {BARS} select issuer_id, max(day) last_day, max(gap)::int longest_gap from (select issuer_id, day, day - lag(day) over (partition by issuer_id order by day) gap from bars) group by 1")
def latest_session_gap(t: Tables):
    b = running(t.bars, "issuer_id", month(F.col("day")), ["day"], {"before": ("last", F.col("day"))}, upto=-1)
    return b.groupBy("issuer_id").agg(F.max("day").alias("last_day"), F.max(F.datediff("day", "before")).alias("longest_gap"))
