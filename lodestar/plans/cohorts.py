"""Cohorts, screens, timelines, samples and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg, cohort
from ..operators.quantiles import grouped_quantiles
from .bindings import BARS, CENSUS, FILINGS, LISTINGS, MENTIONS, MONTHLY, OUTCOMES, Tables
from .registry import query


@query("size_bucket", f"with {CENSUS} select row_id, case when deal_size > 0 and deal_size <= 5e7 then 'small' when deal_size > 5e7 and deal_size <= 2e8 then 'mid' when deal_size > 2e8 and deal_size <= 1e9 then 'large' when deal_size > 1e9 then 'huge' end bucket from census")
def size_bucket(t: Tables):
    return t.census.select("row_id", cohort.right_closed(F.col("deal_size"), [0, 5e7, 2e8, 1e9], ["small", "mid", "large", "huge"]).alias("bucket"))


@query("eligible_population", f"""with {CENSUS} select row_id, issuer_id, year(day) yr, deal_size from census where status = 'priced' and not (exchange = 'OTC') and deal_size / 1e6 >= 5 and deal_size / 1e6 <> 10 and year(day) between 1996 and 2000""")
def eligible_population(t: Tables):
    offer = F.col("deal_size") / 1e6
    return t.census.where("status = 'priced' and exchange <> 'OTC'").where((offer >= 5) & (offer != 10) & F.year("day").between(1996, 2000)).select("row_id", "issuer_id", F.year("day").alias("yr"), "deal_size")


@query("contains_buckets", f"with {CENSUS} select count(*) filter (where upper(exchange) like '%NASDAQ%') nasdaq, count(*) filter (where upper(exchange) like '%NYSE%') nyse, count(*) filter (where upper(exchange) not like '%NASDAQ%' and upper(exchange) not like '%NYSE%') other from census")
def contains_buckets(t: Tables):
    return cohort.size_buckets_overlapping(t.census, "exchange", {"nasdaq": "NASDAQ", "nyse": "NYSE"})


_RAW = "case o_orderkey % 5 when 0 then '' when 1 then o_orderkey::varchar || '.50' when 2 then '12.00-' || (o_orderkey % 30)::varchar when 3 then 'n/a' else ' 7 - 9 ' end"


@query("clean_price", f"""
with r as (select o_orderkey, o_orderkey % 5 k, {_RAW} raw from orders)
select o_orderkey, case k when 1 then o_orderkey + 0.5 when 2 then least(12, o_orderkey % 30) when 4 then 7 end::double low, case k when 1 then o_orderkey + 0.5 when 2 then greatest(12, o_orderkey % 30) when 4 then 9 end::double high, case when k <> 0 then raw end as_returned from r""")
def clean_price(t: Tables):
    raw = F.expr(_RAW.replace("::varchar", "").replace("o_orderkey || '.50'", "concat(o_orderkey, '.50')"))
    return t.orders.select("o_orderkey", cohort.clean_price(raw).alias("p")).select("o_orderkey", "p.*")


@query("evidence_preference", f"""
with {CENSUS}, c as (select issuer_id, min(day) filter (where status = 'priced' and exchange <> 'OTC') priced, min(day) filter (where status = 'filed') anycal, min(day) filter (where rank_code = '5-LOW') eight_a, min(day) seed from census group by 1)
select issuer_id, coalesce(priced, anycal, eight_a) listing_day, case when priced is not null then 'calendar' when anycal is not null then 'calendar_provisional' when eight_a is not null then 'form_lower_bound' else 'none' end evidence,
 coalesce(year(seed) = year(coalesce(priced, anycal, eight_a)) and month(seed) = month(coalesce(priced, anycal, eight_a)), false) month_agrees from c""")
def evidence_preference(t: Tables):
    when = lambda c: F.min(F.when(c, F.col("day")))
    c = t.census.groupBy("issuer_id").agg(when((F.col("status") == "priced") & (F.col("exchange") != "OTC")).alias("priced"), when(F.col("status") == "filed").alias("anycal"), when(F.col("rank_code") == "5-LOW").alias("eight_a"), F.min("day").alias("seed"))
    day = F.coalesce("priced", "anycal", "eight_a")
    label = cohort.first_reason(("calendar", F.col("priced").isNotNull()), ("calendar_provisional", F.col("anycal").isNotNull()), ("form_lower_bound", F.col("eight_a").isNotNull()), otherwise="none")
    return c.select("issuer_id", day.alias("listing_day"), label.alias("evidence"), F.coalesce(F.trunc("seed", "MM") == F.trunc(day, "MM"), F.lit(False)).alias("month_agrees"))


@query("inclusion_verdict", f"""
with {CENSUS}, c as (select issuer_id, name, min(exchange) exchange, count(*) filter (where rank_code = '1-URGENT') regs, count(*) filter (where status = 'priced') priced from census group by 1, 2)
select issuer_id, case when exchange = 'OTC' then 'foreign_market' when issuer_id % 11 = 0 then 'no_identifier' when regs = 0 then 'no_registration' when priced = 0 then 'never_priced' end reason, case when exchange = 'OTC' or issuer_id % 11 = 0 then 9 when regs = 0 or priced = 0 then 2 else 1 end priority from c""")
def inclusion_verdict(t: Tables):
    c = t.census.groupBy("issuer_id", "name").agg(F.min("exchange").alias("exchange"), F.count_if(F.col("rank_code") == "1-URGENT").alias("regs"), F.count_if(F.col("status") == "priced").alias("priced"))
    reason = cohort.first_reason(("foreign_market", F.col("exchange") == "OTC"), ("no_identifier", F.col("issuer_id") % 11 == 0), ("no_registration", F.col("regs") == 0), ("never_priced", F.col("priced") == 0))
    c = c.withColumn("reason", reason)
    return c.select("issuer_id", "reason", F.when(F.col("reason").isin("foreign_market", "no_identifier"), 9).when(F.col("reason").isNotNull(), 2).otherwise(1).alias("priority"))


@query("validity_gate", f"""
with {MONTHLY}, {FILINGS}, f as (select issuer_id, min(filed_on) filter (where form = 'S-1') a, min(filed_on) filter (where form = 'DRS') b, min(filed_on) first_seen from filings group by 1)
select m.issuer_id, m.month, views raw_views, ok valid, case when ok then views end views, first_seen > m.month created_in_month from (
 select m.*, f.first_seen, case when m.issuer_id % 17 = 0 then true else m.month >= date '1995-06-01' and (least(a, b) is null or m.month >= date_trunc('month', least(a, b))) end ok from monthly m join f using (issuer_id)) m""")
def validity_gate(t: Tables):
    form = F.col("form")
    f = t.filings.groupBy("issuer_id").agg(F.min(F.when(form == "S-1", F.col("filed_on"))).alias("a"), F.min(F.when(form == "DRS", F.col("filed_on"))).alias("b"), F.min("filed_on").alias("first_seen"))
    m = t.monthly.join(f, "issuer_id")
    out = cohort.valid_months(m, F.col("month") >= F.lit("1995-06-01").cast("date"), F.col("month"), [F.col("a"), F.col("b")], "views", F.when(F.col("issuer_id") % 17 == 0, F.lit(True)))
    return out.select("issuer_id", "month", "raw_views", "valid", "views", (F.col("first_seen") > F.col("month")).alias("created_in_month"))


@query("window_label", f"""
with {MONTHLY}, {FILINGS}, f as (select issuer_id, min(filed_on) filter (where form = 'DRS') a, min(filed_on) filter (where form = 'S-1') b from filings group by 1),
x as (select m.issuer_id, m.month, (year(m.month) - year(a)) * 12 + month(m.month) - month(a) ra, (year(m.month) - year(b)) * 12 + month(m.month) - month(b) rb from monthly m join f using (issuer_id) where a is not null and b is not null)
select issuer_id, month, case when ra between -24 and -13 then 'baseline' when ra >= 0 and rb < 0 then 'confidential' when rb between 0 and 3 then 'public' end win from x""")
def window_label(t: Tables):
    from ..functions.dates import months_between

    form = F.col("form")
    f = t.filings.groupBy("issuer_id").agg(F.min(F.when(form == "DRS", F.col("filed_on"))).alias("a"), F.min(F.when(form == "S-1", F.col("filed_on"))).alias("b")).dropna()
    x = t.monthly.join(f, "issuer_id").withColumns({"ra": months_between(F.col("a"), F.col("month")), "rb": months_between(F.col("b"), F.col("month"))})
    return x.select("issuer_id", "month", cohort.first_reason(("baseline", F.col("ra").between(-24, -13)), ("confidential", (F.col("ra") >= 0) & (F.col("rb") < 0)), ("public", F.col("rb").between(0, 3))).alias("win"))


_FACTS = "select p_partkey, p_size / 50.0 overlap, p_partkey % 3 = 0 is_company, p_partkey % 5 = 0 via_title, p_size > 10 has_industry, p_type = 'PROMO' defunct from part"


@query("match_status", f"with f as ({_FACTS}) select p_partkey, case when (is_company and overlap >= 0.67) or (via_title and overlap >= 0.9) then 'accept' when is_company and (via_title or overlap >= 0.15) then 'ambiguous' else 'reject' end status from f")
def match_status(t: Tables):
    f = t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("overlap"), (F.col("p_partkey") % 3 == 0).alias("company"), (F.col("p_partkey") % 5 == 0).alias("title"))
    o, c, v = F.col("overlap"), F.col("company"), F.col("title")
    return f.select("p_partkey", cohort.first_reason(("accept", (c & (o >= 0.67)) | (v & (o >= 0.9))), ("ambiguous", c & (v | (o >= 0.15))), otherwise="reject").alias("status"))


@query("indicator_reason", f"""
with {FILINGS}, e as (select issuer_id, min(filed_on) created, max(filed_on) filter (where filed_on <= date '1999-01-01') rev, count(*) filter (where filed_on <= date '1999-01-01') words from filings group by 1)
select issuer_id, case when issuer_id % 13 = 0 then 'api_error' when created > date '1998-01-01' then 'created_after' when rev is null then 'no_revision' when issuer_id % 6 = 0 then 'redirect_stub' when words < 5 then 'too_short' else 'ok' end reason,
 (issuer_id % 13 <> 0 and created <= date '1998-01-01' and rev is not null and issuer_id % 6 <> 0 and words >= 5)::int flag from e""")
def indicator_reason(t: Tables):
    cut = F.col("filed_on") <= F.lit("1999-01-01").cast("date")
    e = t.filings.groupBy("issuer_id").agg(F.min("filed_on").alias("created"), F.max(F.when(cut, F.col("filed_on"))).alias("rev"), F.count_if(cut).alias("words"))
    i = F.col("issuer_id")
    e = e.withColumn("reason", cohort.first_reason(("api_error", i % 13 == 0), ("created_after", F.col("created") > F.lit("1998-01-01").cast("date")), ("no_revision", F.col("rev").isNull()), ("redirect_stub", i % 6 == 0), ("too_short", F.col("words") < 5), otherwise="ok"))
    return e.select("issuer_id", "reason", (F.col("reason") == "ok").cast("int").alias("flag"))


@query("adjudicate", f"with f as ({_FACTS}) select p_partkey, case when defunct then 0 when overlap >= 0.5 and has_industry then 1 when overlap < 0.2 then 0 end verdict, case when defunct then 'defunct' when overlap >= 0.5 and has_industry then 'aligned' when overlap < 0.2 then 'unlike' else 'undecided' end reason from f")
def adjudicate(t: Tables):
    o, i, d = F.col("p_size") / 50.0, F.col("p_size") > 10, F.col("p_type") == "PROMO"
    r = cohort.first_reason(("defunct", d), ("aligned", (o >= 0.5) & i), ("unlike", o < 0.2), otherwise="undecided")
    return t.part.select("p_partkey", r.alias("reason")).select("p_partkey", F.when(F.col("reason") == "aligned", 1).when(F.col("reason") != "undecided", 0).alias("verdict"), "reason")


@query("sic_flag", "with s as (select p_partkey, case when p_partkey % 9 = 0 then 'n/a' else (3500 + p_partkey * 7 % 4000)::varchar end sic from part) select p_partkey, coalesce((try_cast(sic as int) between 3570 and 3579 or try_cast(sic as int) between 7370 and 7379 or try_cast(sic as int) between 3661 and 3674)::int, 0) tech from s")
def sic_flag(t: Tables):
    sic = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise((3500 + F.col("p_partkey") * 7 % 4000).cast("string")).try_cast("int")
    tech = sic.between(3570, 3579) | sic.between(7370, 7379) | sic.between(3661, 3674)
    return t.part.select("p_partkey", F.coalesce(tech.cast("int"), F.lit(0)).alias("tech"))


@query("screen_funnel", f"with {OUTCOMES}, f as (select close > 0 a, offer between 901 and 1800 b, size_code % 4 <> 0 c from outcomes) select 0 step, 'outcome' stage, count(*) filter (where a) n from f union all select 1, 'price', count(*) filter (where a and b) from f union all select 2, 'split', count(*) filter (where a and b and c) from f")
def screen_funnel(t: Tables):
    return cohort.funnel(t.outcomes, [("outcome", F.col("close") > 0), ("price", F.col("offer").between(901, 1800)), ("split", F.col("size_code") % 4 != 0)])


@query("stage_funnel", f"with {CENSUS} select 0 step, 'rows' stage, count(*) n from census union all select 1, 'priced', count(*) filter (where status = 'priced') from census union all select 2, 'listed', count(*) filter (where status = 'priced' and exchange <> 'OTC') from census union all select 3, 'large', count(*) filter (where status = 'priced' and exchange <> 'OTC' and deal_size > 2e8) from census")
def stage_funnel(t: Tables):
    return cohort.funnel(t.census, [("rows", F.lit(True)), ("priced", F.col("status") == "priced"), ("listed", F.col("exchange") != "OTC"), ("large", F.col("deal_size") > 2e8)])


@query("org_check", f"select p_partkey, list_has_any(string_split(p_name, ' '), ['widget', 'bolt', 'gear']) or (p_size > 20 and p_type in ('ECONOMY', 'PROMO')) is_org, case when list_has_any(string_split(p_name, ' '), ['widget', 'bolt', 'gear']) then 'type' when p_size > 20 and p_type in ('ECONOMY', 'PROMO') then 'property' else 'wrong_subject' end how from part")
def org_check(t: Tables):
    typed = F.arrays_overlap(F.split("p_name", " "), F.array(*map(F.lit, ("widget", "bolt", "gear"))))
    prop = (F.col("p_size") > 20) & F.col("p_type").isin("ECONOMY", "PROMO")
    return t.part.select("p_partkey", (typed | prop).alias("is_org"), cohort.first_reason(("type", typed), ("property", prop), otherwise="wrong_subject").alias("how"))


@query("treatment_flag", f"""
with {FILINGS}, a as (select issuer_id, min(filed_on) filter (where form = 'DRS') created, min(filed_on) filter (where form = '424B4') listed, bool_or(case when form = '8-A12B' then status = 'P' end) stub from filings group by 1)
select issuer_id, coalesce(created is not null and created <= listed - 90 and coalesce(stub, true), false) treated from a""")
def treatment_flag(t: Tables):
    form = F.col("form")
    a = t.filings.groupBy("issuer_id").agg(F.min(F.when(form == "DRS", F.col("filed_on"))).alias("created"), F.min(F.when(form == "424B4", F.col("filed_on"))).alias("listed"), F.bool_or(F.when(form == "8-A12B", F.col("status") == "P")).alias("stub_ok"))
    treated = F.col("created").isNotNull() & (F.col("created") <= F.date_sub("listed", 90)) & F.coalesce("stub_ok", F.lit(True))
    return a.select("issuer_id", F.coalesce(treated, F.lit(False)).alias("treated"))


_TIMELINE = f"""with {FILINGS}, t as (select issuer_id, min(filed_on) filter (where form = 'DRS') drs_first, max(filed_on) filter (where form = 'DRS') drs_last, count(*) filter (where form = 'DRS') drs_count,
 min(filed_on) filter (where form in ('S-1', 'S-1/A')) s1_first, max(filed_on) filter (where form in ('S-1', 'S-1/A')) s1_last, count(*) filter (where form in ('S-1', 'S-1/A')) s1_count from filings group by 1),
g as (select *, (s1_first - drs_first)::int gap_days from t)"""


@query("form_timeline", f"{_TIMELINE} select *, concat_ws('; ', case when gap_days > 730 then 'long gap' end, case when gap_days < 0 then 'out of order' end, case when drs_count = 0 then 'no drs' end, case when s1_count = 0 then 'no s1' end) notes from g")
def form_timeline(t: Tables):
    return agg.form_timeline(t.filings, "issuer_id", "form", "filed_on", {"drs": ["DRS"], "s1": ["S-1", "S-1/A"]}, "drs", "s1")


@query("gap_outliers", f"{_TIMELINE} select issuer_id, gap_days, s1_count from g where gap_days > 200 order by gap_days desc, issuer_id limit 20")
def gap_outliers(t: Tables):
    return form_timeline(t).where("gap_days > 200").orderBy(F.desc("gap_days"), "issuer_id").limit(20).select("issuer_id", "gap_days", "s1_count")


@query("timeline_unpivot", f"{_TIMELINE} select issuer_id, event, day from g unpivot (day for event in (drs_first, drs_last, s1_first, s1_last))")
def timeline_unpivot(t: Tables):
    f = form_timeline(t)
    events = ["drs_first", "drs_last", "s1_first", "s1_last"]
    return f.unpivot("issuer_id", events, "event", "day").where("day is not null")


@query("first_event", f"with {FILINGS} select issuer_id, min(filed_on) first_filed, arg_min(filing_id, (filed_on, filing_id)) first_id, count(*) n from filings where form in ('8-A12B', '424B4') group by 1")
def first_event(t: Tables):
    return t.filings.where(F.col("form").isin("8-A12B", "424B4")).groupBy("issuer_id").agg(F.min("filed_on").alias("first_filed"), F.min_by("filing_id", F.struct("filed_on", "filing_id")).alias("first_id"), F.count("*").alias("n"))


@query("filing_history", f"""
with {FILINGS}, c as (select issuer_id, min(filed_on) cutoff from filings where form = '8-A12B' group by 1)
select c.issuer_id, cutoff, count(f.filing_id) filter (where form = '424B4') prior_periodic, min(filed_on) filter (where form = 'S-1') first_s1 from c left join filings f on f.issuer_id = c.issuer_id and f.filed_on < cutoff group by 1, 2""")
def filing_history(t: Tables):
    c = t.filings.where("form = '8-A12B'").groupBy("issuer_id").agg(F.min("filed_on").alias("cutoff"))
    j = c.join(t.filings.withColumnRenamed("issuer_id", "_i"), (F.col("issuer_id") == F.col("_i")) & (F.col("filed_on") < F.col("cutoff")), "left")
    return j.groupBy("issuer_id", "cutoff").agg(F.count_if(F.col("form") == "424B4").alias("prior_periodic"), F.min(F.when(F.col("form") == "S-1", F.col("filed_on"))).alias("first_s1"))


@query("stats_snapshot", "select (select count(*) from customer) issuers, (select count(*) from orders) filings, (select count(distinct o_custkey) from orders where o_orderstatus = 'F') priced, (select count(*) from events where event_type = 'error') in_review, (select count(distinct user_id) from events) entities")
def stats_snapshot(t: Tables):
    o = t.orders.agg(F.count("*").alias("filings"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("priced"))
    e = t.events.agg(F.count_if(F.col("event_type") == "error").alias("in_review"), F.countDistinct("user_id").alias("entities"))
    return t.customer.agg(F.count("*").alias("issuers")).crossJoin(F.broadcast(o)).crossJoin(F.broadcast(e))  # three frames of one row


@query("group_counts", f"with {CENSUS} select status, exchange, count(*) n from census group by 1, 2")
def group_counts(t: Tables):
    return t.census.groupBy("status", "exchange").agg(F.count("*").alias("n"))


@query("cohort_compare", f"""
with {CENSUS}, s as (select *, issuer_id % 4 = 0 sampled from census),
g as (select 'year' dimension, year(day)::varchar bucket, count(*) population, count(*) filter (where sampled) sample from s group by 2 union all select 'exchange', exchange, count(*), count(*) filter (where sampled) from s group by 2)
select *, round(population / sum(population) over (partition by dimension), 6) population_share, case when sum(sample) over (partition by dimension) = 0 then 0 else round(sample / sum(sample) over (partition by dimension), 6) end sample_share from g""")
def cohort_compare(t: Tables):
    s = t.census.withColumn("sampled", F.col("issuer_id") % 4 == 0)
    g = s.select("sampled", F.inline(F.array(F.struct(F.lit("year").alias("dimension"), F.year("day").cast("string").alias("bucket")), F.struct(F.lit("exchange").alias("dimension"), F.col("exchange").alias("bucket")))))
    g = g.groupBy("dimension", "bucket").agg(F.count("*").alias("population"), F.count_if("sampled").alias("sample"))
    g = agg.share_of(g, "population", ["dimension"]).withColumnRenamed("share", "population_share")
    return agg.share_of(g, "sample", ["dimension"]).withColumnRenamed("share", "sample_share")


@query("crosstab_margins", f"with {CENSUS} select coalesce(exchange, 'All') exchange, count(*) filter (where status = 'priced') priced, count(*) filter (where status = 'filed') filed, count(*) \"All\" from census where status in ('priced', 'filed') group by rollup(exchange)")
def crosstab_margins(t: Tables):
    return agg.crosstab(t.census, "exchange", "status", ["priced", "filed"])


@query("pivot_first", f"with {CENSUS} select issuer_id, arg_min(deal_size, (day, row_id)) filter (where status = 'priced') priced, arg_min(deal_size, (day, row_id)) filter (where status = 'filed') filed from census group by 1")
def pivot_first(t: Tables):
    return agg.pivot_first(t.census, "issuer_id", "status", ["priced", "filed"], "deal_size", ["day", "row_id"])


@query("dedupe_informative", f"""with {CENSUS} select row_id, issuer_id, status, day from (select *, row_number() over (partition by issuer_id, year(day) order by case status when 'priced' then 0 when 'filed' then 1 else 2 end, day desc, row_id) k from census) where k = 1""")
def dedupe_informative(t: Tables):
    rank = F.when(F.col("status") == "priced", 0).when(F.col("status") == "filed", 1).otherwise(2)
    return agg.dedupe(t.census, ["issuer_id", F.year("day")], [rank, F.desc("day"), F.col("row_id")])[0].select("row_id", "issuer_id", "status", "day")


@query("reject_ledger", f"""with {CENSUS} select coalesce(drop_reason, 'kept') reason, count(*) n, min(row_id) first_id from (select *, case when status = 'withdrawn' then 'withdrawn' when exchange = 'OTC' then 'market' when deal_size < 5e7 then 'small' end drop_reason from census) group by 1""")
def reject_ledger(t: Tables):
    kept, dropped = cohort.ledger(t.census, ("withdrawn", F.col("status") == "withdrawn"), ("market", F.col("exchange") == "OTC"), ("small", F.col("deal_size") < 5e7))
    count = [F.count("*").alias("n"), F.min("row_id").alias("first_id")]
    return dropped.groupBy(F.col("drop_reason").alias("reason")).agg(*count).union(kept.groupBy(F.lit("kept").alias("reason")).agg(*count))


@query("universe_screen", "select o_orderkey, c_name, case when o_orderkey % 9 > 2 then 1480 + o_orderkey % 500 end founded from orders join customer on o_custkey = c_custkey where year(o_orderdate) between 1996 and 1999 and c_nationkey <> 2 and c_mktsegment <> 'MACHINERY'")
def universe_screen(t: Tables):
    u = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where(F.year("o_orderdate").between(1996, 1999) & (F.col("c_nationkey") != 2) & (F.col("c_mktsegment") != "MACHINERY"))
    return u.select("o_orderkey", "c_name", F.when(F.col("o_orderkey") % 9 > 2, 1480 + F.col("o_orderkey") % 500).alias("founded"))


@query("capped_sample", "select p_type, p_partkey from (select *, row_number() over (partition by p_type order by md5('s' || p_partkey), p_partkey) k from part) where k <= 7")
def capped_sample(t: Tables):
    return agg.capped_sample(t.part, "p_type", "p_partkey", 7).select("p_type", "p_partkey")


@query("stratified_sample", """
with r as (select p_partkey, p_type, row_number() over (partition by p_type order by md5('s' || p_partkey), p_partkey) k, floor(count(*) over (partition by p_type) * 90 / count(*) over ()) want from part),
x as (select *, row_number() over (order by md5('s' || p_partkey), p_partkey) o from r where k > want)
select p_partkey, p_type from r where k <= want union all select p_partkey, p_type from x where o <= 90 - (select count(*) from r where k <= want)""")
def stratified_sample(t: Tables):
    return agg.stratified_sample(t.part, ["p_type"], "p_partkey", 90).select("p_partkey", "p_type")


@query("coverage_summary", f"with {MONTHLY} select issuer_id, count(distinct month) n_months, count(*) n_rows, count(*) filter (where views > 100000) valid_rows, min(month) first_month, max(month) last_month from monthly group by 1")
def coverage_summary(t: Tables):
    return t.monthly.groupBy("issuer_id").agg(F.countDistinct("month").alias("n_months"), F.count("*").alias("n_rows"), F.count_if(F.col("views") > 100000).alias("valid_rows"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


@query("gating_impact", f"with {MONTHLY} select issuer_id, max(views) - coalesce(max(case when month >= date '1997-01-01' then views end), 0) impact from monthly group by 1 order by 2 desc, 1 limit 15")
def gating_impact(t: Tables):
    ok = F.when(F.col("month") >= F.lit("1997-01-01").cast("date"), F.col("views"))
    return t.monthly.groupBy("issuer_id").agg((F.max("views") - F.coalesce(F.max(ok), F.lit(0))).alias("impact")).orderBy(F.desc("impact"), "issuer_id").limit(15)


@query("frame_manifest", "select 'orders' frame, count(*) n from orders union all select 'events', count(*) from events union all select 'part', count(*) from part")
def frame_manifest(t: Tables):
    from functools import reduce

    return reduce(lambda a, b: a.union(b), [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n") for name, df in (("orders", t.orders), ("events", t.events), ("part", t.part))])


@query("split_factor", f"""
with {BARS}, s as (select user_id issuer_id, ts::date d, 1.5 r from events where event_type = 'purchase' and event_id % 5 = 0)
select b.issuer_id, b.day, round(exp(coalesce(sum(ln(r)), 0)), 6) split_factor from bars b left join s on s.issuer_id = b.issuer_id and s.d > b.day group by 1, 2""")
def split_factor(t: Tables):
    s = t.events.where("event_type = 'purchase' and event_id % 5 = 0").select(F.col("user_id").alias("issuer_id"), F.to_date("ts").alias("d"), F.lit(1.5).alias("r"))
    return agg.split_factor(t.bars.select("issuer_id", "day"), s, "issuer_id", "day", "d", "r").withColumn("split_factor", F.round("split_factor", 6))


@query("upper_median", f"with {BARS} select issuer_id, round(close, 6) upper_median, n from (select issuer_id, close, row_number() over (partition by issuer_id order by close) k, count(*) over (partition by issuer_id) n from bars) where k = n // 2 + 1")
def upper_median(t: Tables):
    return agg.upper_median(t.bars, "close", ["issuer_id"]).withColumn("upper_median", F.round("upper_median", 6))


@query("upper_median_global", "select value upper_median, n from (select value, row_number() over (order by value) k, count(*) over () n from events) where k = n // 2 + 1")
def upper_median_global(t: Tables):
    return agg.upper_median(t.events, "value")


@query("quantile_profile", "select event_type, count(value) n, round(avg(value), 6) mean, round(quantile_cont(value, 0.25), 6) q25, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) iqr from events group by 1")
def quantile_profile(t: Tables):
    q = agg.quantile_profile(t.events, "value", ["event_type"])
    return q.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q25", "q50", "q75", "iqr")])


@query("confusion_metrics", """
with t as (select doc_id, quality t from labels), p as (select doc_id, (n_chars > 800)::int p from documents where doc_id % 4 <> 0),
c as (select count(*) filter (where t = p) tp, count(*) filter (where p is not null and t is distinct from p) fp, count(*) filter (where t is not null and t is distinct from p) fn from t full join p using (doc_id))
select tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) f1 from c""")
def confusion_metrics(t: Tables):
    guess = t.documents.where("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("guess"))
    return agg.confusion(t.labels, guess, ["doc_id"], "quality", "guess")


@query("attrition_report", f"""
with {FILINGS}, s as (select issuer_id, count(*) n, max(case when form = '424B4' then 1 else 0 end) priced, max(case when form = 'DRS' then 1 else 0 end) drs from filings group by 1),
x as (select *, case when priced = 0 then 'not_priced' when drs = 0 then 'no_article' when n < 8 then 'thin' else 'kept' end state from s)
select state, count(*) n, round(count(*) / sum(count(*)) over (), 6) share, round(quantile_cont(x.n, 0.5), 4) median_filings, round(avg(drs), 6) treated_rate from x group by 1""")
def attrition_report(t: Tables):
    form = F.col("form")
    s = t.filings.groupBy("issuer_id").agg(F.count("*").alias("n"), F.max((form == "424B4").cast("int")).alias("priced"), F.max((form == "DRS").cast("int")).alias("drs"))
    state = cohort.first_reason(("not_priced", F.col("priced") == 0), ("no_article", F.col("drs") == 0), ("thin", F.col("n") < 8), otherwise="kept")
    s = s.withColumn("state", state)
    g = s.groupBy("state").agg(F.count("*").alias("rows"), F.round(F.avg("drs"), 6).alias("treated_rate")).join(grouped_quantiles(s, ["state"], {"median_filings": (F.col("n"), 0.5)}), "state").withColumn("median_filings", F.round("median_filings", 4))
    return agg.share_of(g, "rows", [F.lit(0)]).select("state", F.col("rows").alias("n"), "share", "median_filings", "treated_rate")
