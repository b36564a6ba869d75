"""Scans and sinks: payloads made from the tables, parsed as landed files are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.workspace import folder
from ..operators import cohort
from ..sources import landed, store
from .bindings import BARS, CENSUS, FILINGS, MENTIONS, Tables
from .registry import query


@query("scan_index_lines", f"with {FILINGS} select case when filing_id % 8 = 7 then null else form end form, lpad(issuer_id::varchar, 10, '0') cik, filed_on, 'a-' || filing_id accession from filings where filing_id % 8 <> 7 and filing_id % 10 <> 3")
def scan_index_lines(t: Tables):
    f = t.filings
    form = F.when(F.col("filing_id") % 8 == 7, "10-K").otherwise(F.col("form"))
    day = F.when(F.col("filing_id") % 2 == 0, F.date_format("filed_on", "yyyyMMdd")).otherwise(F.col("filed_on").cast("string"))
    line = F.concat(F.rpad(form, 12, " "), F.lit("Company No "), F.rpad(F.col("issuer_id").cast("string"), 20, " "), F.lit("  "), F.col("issuer_id").cast("string"), F.lit("    "), day, F.lit("  edgar/data/1/a-"), F.col("filing_id").cast("string"), F.lit(".txt"))
    lines = f.select(F.when(F.col("filing_id") % 10 == 3, "----").otherwise(line).alias("value"))
    return landed.parse_index(lines).select("form", "cik", F.to_date("filed_at").alias("filed_on"), "accession")


def _submissions(t: Tables):
    f = t.filings.groupBy("issuer_id").agg(F.array_sort(F.collect_list(F.struct("filing_id", "form", F.col("filed_on").cast("string").alias("d")))).alias("x"))
    pick = lambda k, x=F.col("x"): F.transform(x, lambda e: e[k].cast("string"))
    # The last filing of every third issuer has no document, so the cut to the shortest array drops it.
    documents = F.slice("x", F.lit(1), F.size("x") - (F.col("issuer_id") % 3 == 0).cast("int"))
    recent = F.struct(pick("form").alias("form"), pick("d").alias("filingDate"), pick("filing_id").alias("accessionNumber"), pick("filing_id", documents).alias("primaryDocument"))
    return f.select("issuer_id", F.to_json(F.struct(F.concat(F.lit("Issuer "), F.col("issuer_id").cast("string")).alias("name"), F.lit("").alias("sicDescription"), F.array(F.lit(""), F.concat(F.lit("T"), F.col("issuer_id").cast("string"))).alias("tickers"), F.array().cast("array<string>").alias("exchanges"), F.struct(recent.alias("recent")).alias("filings"))).alias("value"))


@query("scan_parallel_arrays", f"with {FILINGS}, k as (select *, row_number() over (partition by issuer_id order by filing_id) - 1 pos from filings) select issuer_id, pos::int pos, form, filed_on, filing_id::varchar accession from k qualify not (issuer_id % 3 = 0 and pos = count(*) over (partition by issuer_id) - 1)")
def scan_parallel_arrays(t: Tables):
    return landed.parse_submissions(_submissions(t))[1].select("issuer_id", "pos", "form", "filed_on", "accession")


@query("scan_profiles", f"with {FILINGS} select distinct issuer_id, 'Issuer ' || issuer_id as name, null::varchar sector, 'T' || issuer_id ticker, null::varchar exchange from filings")
def scan_profiles(t: Tables):
    return landed.parse_submissions(_submissions(t))[0]


@query("mention_from_json", """
select event_id::varchar source_uid, case when event_id % 3 = 0 then 'story ' || event_id else 'parent' end title, 500 n_excerpt, (case when event_id % 4 <> 0 then (json_extract(props, '$.k'))::int else 0 end + event_id % 7)::int engagement_score,
 case when event_id % 5 = 0 then 'http://x/' || event_id else 'https://news.ycombinator.com/item?id=' || event_id end url, date_trunc('second', ts) posted_at from events where event_id % 6 <> 0 and event_id % 11 <> 0""")
def mention_from_json(t: Tables):
    i = F.col("event_id")
    s = i.cast("string")
    payload = F.to_json(F.struct(F.when(i % 6 != 0, s).alias("objectID"), F.when(i % 3 == 0, F.concat(F.lit("story "), s)).alias("title"), F.lit("parent").alias("story_title"), F.repeat(F.lit("word "), F.lit(180)).alias("comment_text"), F.col("user_id").cast("string").alias("author"), F.when(i % 4 != 0, F.get_json_object("props", "$.k").cast("int")).alias("points"), (i % 7).cast("int").alias("num_comments"), F.when(i % 5 == 0, F.concat(F.lit("http://x/"), s)).alias("url"), F.when(i % 11 != 0, F.unix_seconds("ts")).alias("created_at_i")))
    m = landed.parse_hits(t.events.select(payload.alias("value")), "salt")
    return m.select("source_uid", "title", F.length("body_excerpt").alias("n_excerpt"), "engagement_score", "url", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("post_from_json", "select event_id::varchar source_uid, 'c' || event_type channel, 'https://www.reddit.com/r/' || event_id url, (event_id % 9 + event_id % 4)::int engagement_score from events where event_id % 6 <> 0 and date_trunc('second', ts) between timestamp '2024-01-05' and timestamp '2024-01-20'")
def post_from_json(t: Tables):
    i = F.col("event_id")
    payload = F.to_json(F.struct(F.when(i % 6 != 0, i.cast("string")).alias("id"), F.unix_seconds("ts").cast("double").alias("created_utc"), F.col("user_id").cast("string").alias("author"), F.concat(F.lit("c"), "event_type").alias("subreddit"), F.concat(F.lit("/r/"), i.cast("string")).alias("permalink"), (i % 9).cast("int").alias("score"), (i % 4).cast("int").alias("num_comments")))
    at = lambda d: F.lit(d).cast("timestamp")
    return landed.parse_posts(t.events.select(payload.alias("value")), "salt", at("2024-01-05"), at("2024-01-20")).select("source_uid", "channel", "url", "engagement_score")


def _bar_payloads(t: Tables):
    n = F.col("close").cast("decimal(12,4)").cast("string")
    bar = F.struct((F.unix_seconds(F.col("day").cast("timestamp")) * 1000).alias("t"), *[F.col(c).cast("decimal(12,4)").cast("string").alias(k) for c, k in (("open", "o"), ("high", "h"), ("low", "l"))], F.when(F.col("volume") % 4 == 0, "n/a").otherwise(n).alias("c"), F.col("volume").cast("string").alias("v"))
    return t.bars.groupBy("issuer_id").agg(F.to_json(F.struct(F.collect_list(bar).alias("results"))).alias("value"))


@query("bars_from_json", f"with {BARS} select issuer_id, day, round(open, 4) as open, round(close, 4) as close, volume from bars where volume % 4 <> 0")
def bars_from_json(t: Tables):
    b = landed.parse_bars(_bar_payloads(t))
    return b.select("issuer_id", "day", F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"), "volume")


@query("price_panel", f"with {BARS}, b as (select * from bars where volume % 4 <> 0) select issuer_id, day, round(close, 4) as close, (row_number() over (partition by issuer_id order by day) - 1)::int as session from b")
def price_panel(t: Tables):
    from ..operators.timeseries import sessions

    return sessions(landed.parse_bars(_bar_payloads(t))).select("issuer_id", "day", F.col("close").cast("double").alias("close"), "session")


@query("lookup_table", "select c_name || ':x' as name, lpad(min(c_custkey)::varchar, 10, '0') cik from customer where c_custkey % 5 <> 0 group by 1")
def lookup_table(t: Tables):
    line = F.concat("c_name", F.lit(":x:"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(":"))
    return landed.parse_lookup(t.customer.select(line.alias("value")))


@query("census_scan", f"with {CENSUS} select year(day) yr, count(*) n, count(distinct year(day)) files, round(sum(deal_size), 2) deal_size from census group by 1")
def census_scan(t: Tables):
    at = folder(t.spark, "census")
    c = t.census.select(F.year("day").alias("yr"), F.struct(F.col("day").cast("string").alias("date"), F.concat(F.lit(" "), "exchange").alias("exchange"), "name", F.lit(1).cast("long").alias("numberOfShares"), F.lit("4-6").alias("price"), F.upper("status").alias("status"), F.lit("").alias("symbol"), F.col("deal_size").alias("totalSharesValue")).alias("r"))
    # A payload a year and block of rows, so that no file holds a whole year of a large table.
    payload = c.withColumn("blk", F.pmod(F.xxhash64("r.date"), F.lit(64))).groupBy("yr", "blk").agg(F.collect_list("r").alias("ipoCalendar"))
    payload.select(F.lit("x").alias("fetched_at"), "ipoCalendar").write.json(f"{at}/calendar")
    rows = t.spark.read.schema(landed.CALENDAR).json(f"{at}/calendar").select(F.explode("ipoCalendar").alias("r"))
    return rows.groupBy(F.year(F.to_date("r.date")).alias("yr")).agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("files"), F.round(F.sum("r.totalSharesValue"), 2).alias("deal_size"))


@query("csv_roundtrip", "select lpad(c_custkey::varchar, 10, '0') cik, c_name as name, c_nationkey::int nation from customer")
def csv_roundtrip(t: Tables):
    at = folder(t.spark, "csv")
    t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).write.csv(at, header=True)
    return landed.read_csv(t.spark, at, "cik string, name string, nation int")


@query("frame_guard", f"with {CENSUS} select exchange, count(*) n from census group by 1")
def frame_guard(t: Tables):
    at = folder(t.spark, "frame")
    t.census.write.parquet(at)
    return landed.read_frame(t.spark, at, "exchange", "status").groupBy("exchange").agg(F.count("*").alias("n"))


@query("review_queue_export", f"with {MENTIONS} select mention_id, issuer_id, round(engagement, 2) engagement, null::varchar verdict from mentions where needs_review order by engagement desc, mention_id limit 200")
def review_queue_export(t: Tables):
    at = folder(t.spark, "queue")
    q = t.mentions.where("needs_review").select("mention_id", "issuer_id", F.round("engagement", 2).alias("engagement"), F.lit(None).cast("string").alias("verdict"))
    landed.write_queue(q, at, [F.desc("engagement"), "mention_id"], 200)
    return landed.read_csv(t.spark, at, "mention_id long, issuer_id long, engagement double, verdict string")


@query("ledger_split", f"with {CENSUS} select row_id, case when status = 'withdrawn' then 'withdrawn' else 'small' end drop_reason from census where status = 'withdrawn' or deal_size < 1e8")
def ledger_split(t: Tables):
    return cohort.ledger(t.census, ("withdrawn", F.col("status") == "withdrawn"), ("small", F.col("deal_size") < 1e8))[1].select("row_id", "drop_reason")


# A payload a region and month, <company>/<month>: some are cut off, some lack their company and month, some aren't of a month.
_LANDED = """l as (select n_regionkey r, date_trunc('month', o_orderdate)::date m, count(*) hits, count(distinct o_orderpriority) n_docs from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"""


def _landed_months(t: Tables) -> str:
    at = folder(t.spark, "months")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")), "n_nationkey")  # 25 nations
    g = t.orders.join(c, "o_custkey").groupBy(F.col("n_regionkey").alias("r"), F.to_date(F.trunc("o_orderdate", "MM")).alias("m")).agg(F.count("*").cast("int").alias("hits"), F.collect_set("o_orderpriority").alias("docs"))
    name, month = F.concat(F.lit("Region "), F.col("r").cast("string")), F.when((F.col("r") == 4) & (F.month("m") == 5), "soon").otherwise(F.date_format("m", "yyyy-MM"))
    own = F.col("r") % 2 == 0  # the others leave company and month to the path
    payload = F.to_json(F.struct(F.when(own, name).alias("company"), F.lit("q").alias("query"), F.when(own, month).alias("month"), F.when(F.month("m") != 7, F.col("hits")).alias("hits"), F.lit("t").alias("fetched_at"), "docs"))
    cut = (F.col("r") == 3) & (F.month("m") % 6 == 0)
    g.select(name.alias("company"), F.date_format("m", "yyyy-MM").alias("month"), F.when(cut, F.substring(payload, F.lit(1), F.length(payload) - 5)).otherwise(payload).alias("value")).repartition("company").write.partitionBy("company", "month").text(at)
    return at


@query("months_scan", f"with {_LANDED} select 'Region ' || r company, m \"month\", case when month(m) <> 7 then hits end::int hits, n_docs::int n_docs from l where not (r = 3 and month(m) % 6 = 0) and not (r = 4 and month(m) = 5)")
def months_scan(t: Tables):
    return landed.read_months(t.spark, _landed_months(t))[0].select("company", "month", "hits", "n_docs")


@query("months_ledger", f"with {_LANDED} select case when r = 3 then 'broken_json' else 'no_month' end drop_reason, count(*) n from l where (r = 3 and month(m) % 6 = 0) or (r = 4 and month(m) = 5) group by 1")
def months_ledger(t: Tables):
    return landed.read_months(t.spark, _landed_months(t))[1].groupBy("drop_reason").agg(F.count("*").alias("n"))


# A payload a nation: its months, what came by each title, and when its article was made.
_VIEWED = """o as (select c_nationkey k, date_trunc('month', o_orderdate)::date m, o_orderpriority p, o_orderdate::date d from orders join customer on o_custkey = c_custkey),
c as (select k, min(d) + 400 created, k % 2 = 0 inherited from o group by 1)"""


def _landed_views(t: Tables) -> str:
    at = folder(t.spark, "views")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    o = t.orders.join(c, "o_custkey").select("k", F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"))
    months = o.groupBy("k", F.date_format("d", "yyyyMM").alias("m")).agg(F.count("*").alias("n"))
    items = months.groupBy("k").agg(F.collect_list(F.struct(F.concat("m", F.lit("0100")).alias("timestamp"), F.col("n").alias("views"))).alias("items"))  # months of a nation
    titles = o.groupBy("k", "p").agg(F.count("*").alias("n")).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("views_by_title"))  # five titles
    made = o.groupBy("k").agg(F.date_add(F.min("d"), 400).alias("created"))
    name = F.concat(F.lit("Nation "), F.col("k").cast("string"))
    payload = F.to_json(F.struct(name.alias("company"), F.lit("x").alias("cohort"), F.struct(name.alias("title"), F.lit("exact").alias("method")).alias("resolution"), F.concat(F.col("created").cast("string"), F.lit("T00:00:00Z")).alias("article_created"), "views_by_title", (F.col("k") % 2 == 0).alias("title_history_inherited"), "items"))
    items.join(titles, "k").join(made, "k").select(name.alias("company"), payload.alias("value")).write.partitionBy("company").text(at)
    return at


@query("pageviews_scan", f"with {_VIEWED} select 'Nation ' || k company, m \"month\", count(*) views, m >= date_trunc('month', created) article_existed, m = date_trunc('month', created) creation_month, inherited from o join c using (k) group by all")
def pageviews_scan(t: Tables):
    return landed.read_pageviews(t.spark, _landed_views(t))[0].select("company", "month", "views", "article_existed", "creation_month", "inherited")


@query("pageviews_by_title", f"with {_VIEWED} select 'Nation ' || k company, p title, count(*) views from o group by 1, 2")
def pageviews_by_title(t: Tables):
    return landed.read_pageviews(t.spark, _landed_views(t))[1]


@query("counted_on_the_way", f"""
with {CENSUS} select count(*) n_rows, count(*) filter (where status <> 'withdrawn') not_withdrawn, count(*) filter (where status <> 'withdrawn' and deal_size >= 1e8) kept,
 count(*) filter (where status = 'withdrawn' or deal_size < 1e8) dropped, round(sum(deal_size) filter (where status <> 'withdrawn' and deal_size >= 1e8), 2) kept_size from census""")
def counted_on_the_way(t: Tables):
    reason = cohort.first_reason(("withdrawn", F.col("status") == "withdrawn"), ("small", F.col("deal_size") < 1e8))
    kept = F.col("drop_reason").isNull()
    counts = {"n_rows": F.count("*"), "not_withdrawn": F.count_if(F.coalesce(F.col("drop_reason") != "withdrawn", F.lit(True))), "kept": F.count_if(kept), "dropped": F.count_if(~kept), "kept_size": F.round(F.sum(F.when(kept, F.col("deal_size"))), 2)}
    found = landed.write_counted(t.census.withColumn("drop_reason", reason), folder(t.spark, "ledger"), counts)
    return t.spark.createDataFrame([found], ", ".join(f"{n} {'double' if n == 'kept_size' else 'long'}" for n in counts)).select(*counts)


@query("sink_by_day", f"with {MENTIONS}, l as (select max(posted_at)::date d from mentions) select posted_at::date as day, count(*) n, count(distinct issuer_id) issuers, posted_at::date = d second_run from mentions, l where posted_at::date < d or issuer_id % 2 = 0 group by all")
def sink_by_day(t: Tables):
    at = folder(t.spark, "days")
    m = t.mentions.select("mention_id", "issuer_id", F.to_date("posted_at").alias("day"), F.lit(False).alias("second_run"))
    store.write_days(m, at, "day", "issuer_id")
    # The last day comes again, with other rows: it is replaced, the other days stay as they are.
    last = m.agg(F.max("day")).first()[0]
    store.write_days(m.where((F.col("day") == F.lit(last)) & (F.col("issuer_id") % 2 == 0)).withColumn("second_run", F.lit(True)), at, "day", "issuer_id")
    return t.spark.read.parquet(at).groupBy("day", "second_run").agg(F.count("*").alias("n"), F.countDistinct("issuer_id").alias("issuers"))
