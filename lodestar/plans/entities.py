"""Entities: names, resolution, relations, cohorts of issuers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import cohort, relations as rel
from .bindings import BARS, CENSUS, FILINGS, LISTINGS, MENTIONS, Tables
from .registry import query

# A name with a suffix, an ampersand and signs, made from the tables alike in both dialects.
_NAME = "p_name || case p_partkey % 6 when 0 then ', Inc.' when 1 then ' Holdings Corp.' when 2 then ' & Sons Co' when 3 then ' (old) Ltd' when 4 then ' Acquisition Group' else '' end"
# Written out here, so that the SQL doesn't follow the engine's list.
SUFFIX_SQL = "inc|incorporated|corp|corporation|co|company|ltd|limited|llc|lp|llp|plc|sa|nv|bv|ag|gmbh|ab|oyj|oy|as|pte|pty|holdings|holding|group"
_KEY = "trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower({n}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')), '^(.+?)(?: (?:" + SUFFIX_SQL + "))+$', '\\1'))"


def _named(t: Tables):
    return t.part.select("p_partkey", F.expr(_NAME).alias("name"), "p_brand", "p_type")


@query("normalize_name", f"select p_partkey, {_NAME} as name, {_KEY.format(n=_NAME)} name_key, trim(regexp_replace(lower({_NAME}), '[^a-z0-9]+', '-', 'g'), '-') slug from part")
def normalize_name(t: Tables):
    n = _named(t)
    return n.select("p_partkey", "name", names.company_key(F.col("name")).alias("name_key"), names.slug(F.col("name")).alias("slug"))


@query("title_key", f"""
with n as (select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({_NAME}, '\\([^)]*\\)', ' ', 'g'), '[.,#]', ' ', 'g'), ' +', ' ', 'g')) s from part),
r1 as (select *, regexp_replace(s, '(?i) (?:{SUFFIX_SQL})$', '') c1 from n),
r2 as (select *, case when length(c1) >= 3 and length(c1) >= length(s) * 0.34 then c1 else s end s1 from r1),
r3 as (select *, regexp_replace(s1, '(?i) (?:{SUFFIX_SQL})$', '') c2 from r2)
select p_partkey, case when length(c2) >= 3 and length(c2) >= length(s) * 0.34 then c2 else s1 end title from r3""")
def title_key(t: Tables):
    return _named(t).select("p_partkey", names.title_key(F.col("name")).alias("title"))


@query("candidate_titles")
def candidate_titles(t: Tables):
    return _named(t).select("p_partkey", F.posexplode(names.candidate_titles(F.col("name"))).alias("pos", "title"))


_TOK = "list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3))"


@query("token_overlap", f"""
with x as (select p_partkey, {_TOK.format(c=_NAME)} a, {_TOK.format(c="p_name || ' ' || p_type")} b from part)
select p_partkey, len(list_intersect(a, b))::int shared, round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) overlap from x""")
def token_overlap(t: Tables):
    a, b = names.tokens(F.col("name")), names.tokens(F.concat("p_name", F.lit(" "), "p_type"))
    n = t.part.withColumn("name", F.expr(_NAME)).select("p_partkey", a.alias("a"), b.alias("b"))
    return n.select("p_partkey", F.size(F.array_intersect("a", "b")).alias("shared"), F.round(names.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("name_core_join", f"""
with a as (select p_partkey, {_KEY.format(n=_NAME)} k from part), b as (select p_partkey other, {_KEY.format(n="p_name || ' Incorporated'")} k from part)
select a.k, count(distinct p_partkey) n_names, count(distinct other) n_others from a join b using (k) group by 1""")
def name_core_join(t: Tables):
    a = _named(t).select("p_partkey", names.company_key(F.col("name")).alias("k")).groupBy("k").agg(F.countDistinct("p_partkey").alias("n_names"))
    b = t.part.select(F.col("p_partkey").alias("other"), names.company_key(F.concat("p_name", F.lit(" Incorporated"))).alias("k")).groupBy("k").agg(F.countDistinct("other").alias("n_others"))
    return a.join(b, "k")


@query("candidate_cohort", "select c_custkey from customer left join (select distinct o_custkey from orders where o_orderpriority = '4-NOT SPECIFIED') f on c_custkey = o_custkey where c_mktsegment not in ('BUILDING', 'MACHINERY') and o_custkey is not null")
def candidate_cohort(t: Tables):
    c = t.customer.withColumns({"ticker": F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")), "exchange": F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("NYSE"))})
    drs = t.filings.where("form = 'DRS'").select(F.col("issuer_id").alias("c_custkey"))
    return rel.member_of_any(c.where("ticker is null and exchange is null"), "c_custkey", drs).select("c_custkey")


@query("study_cohort", f"with {CENSUS} select row_id, issuer_id from census where status = 'priced' and exchange <> 'OTC'")
def study_cohort(t: Tables):
    return t.census.where("status = 'priced' and exchange <> 'OTC'").select("row_id", "issuer_id")


_COHORT = f"""case when p_partkey % 4 = 3 then 're_listing' when regexp_matches(p_type, '(?i)exchange.traded|commodity') or regexp_matches({_NAME}, '(?i)\\b(ETF|Trust|Fund)\\b') or p_name like 'green%' then 'etf_or_trust' when p_type = 'PROMO' then 'spac' else 'operating' end"""


@query("classify_cohort", f"select p_partkey, {_COHORT} cohort, case when p_size > 25 and date '2024-02-01' - (date '2024-01-01' - p_size) > 40 then 'registered_no_trade' else 'awaiting' end pending from part")
def classify_cohort(t: Tables):
    p = t.part.withColumn("name", F.when(F.col("p_name").startswith("green"), F.concat(F.col("p_name"), F.lit(" Fund"))).otherwise(F.expr(_NAME)))
    sector = F.when(F.col("p_type") == "PROMO", "Blank Checks").otherwise(F.col("p_type"))
    filed = F.date_sub(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    return p.select("p_partkey", cohort.classify_cohort(sector, F.col("name"), (F.col("p_partkey") % 4 == 3).cast("int")).alias("cohort"), cohort.pending_status(F.when(F.col("p_size") > 25, F.col("p_name")), filed, F.lit("2024-02-01").cast("date"), 40).alias("pending"))


@query("listing_promotion", f"""
with {BARS}, e as (select user_id issuer_id, min(ts)::date filed from events where event_type = 'click' group by 1), f as (select issuer_id, min(day) d, arg_min(open, day) o from bars where day >= date '2024-01-04' group by 1)
select e.issuer_id, filed, case when d is null then case when date '2024-02-01' - filed > 30 then 'registered_no_trade' else 'awaiting' end when d - filed between 0 and 3 then 'listed' else 'no_price_data' end listing_status,
 case when d - filed between 0 and 3 then d end first_day, case when d - filed between 0 and 3 then round(o, 6) end first_open from e left join f using (issuer_id)""")
def listing_promotion(t: Tables):
    e = t.events.where("event_type = 'click'").groupBy(F.col("user_id").alias("issuer_id")).agg(F.to_date(F.min("ts")).alias("filed"))
    return cohort.promote(e, t.bars.where("day >= date '2024-01-04'"), "issuer_id", "filed", F.lit("2024-02-01").cast("date"), within=3).withColumn("first_open", F.round("first_open", 6))


_TICK = "upper(substr(replace(p_type, ' ', ''), 1, 3)) || case p_partkey % 5 when 0 then 'U' when 1 then '.U' else 'A' end"


@query("spac_rules", f"""
select p_partkey, (({_TICK}) like '%U' and length({_TICK}) >= 4) or ({_TICK}) like '%.U%' or regexp_matches(upper({_NAME}), 'ACQUISITION|BLANK CHECK|ACQ CORP') v1,
 case when lower({_NAME}) like '%acquisition%' then 'name' when regexp_matches({_TICK}, '^[A-Z]{{3,4}}U$') then 'unit_suffix' when regexp_matches({_TICK}, '^[A-Z]{{2,4}}[-.]U$') then 'unit_class' end v2 from part""")
def spac_rules(t: Tables):
    n, k = F.expr(_NAME), F.expr(_TICK)
    return t.part.select("p_partkey", cohort.spac_by_ticker(k, n).alias("v1"), cohort.spac_rule(n, k).alias("v2"))


@query("resolve_cascade", f"""
with n as (select c_custkey, c_name, c_nationkey from customer), s as (select s_suppkey, s_name, s_nationkey from supplier),
a as (select 'Supplier#' || lpad(c_custkey::varchar, 9, '0') k1, * from n),
l2 as (select s_nationkey, min(s_suppkey) v from supplier where s_nationkey < 12 group by 1)
select c_custkey, coalesce(s.s_suppkey, l2.v) resolved, case when s.s_suppkey is not null then 'ticker' when l2.v is not null then 'nation' else 'miss' end "method"
from a left join supplier s on k1 = s_name left join l2 on c_nationkey = l2.s_nationkey""")
def resolve_cascade(t: Tables):
    rules = [
        ("ticker", F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), t.supplier, "s_name", "s_suppkey"),
        ("nation", F.col("c_nationkey"), t.supplier.where("s_nationkey < 12"), "s_nationkey", "s_suppkey"),
    ]
    return rel.cascade(t.customer, "c_custkey", rules).select("c_custkey", "resolved", "method")


@query("resolve_unique", """
with c as (select s_nationkey, count(distinct s_suppkey) n, min(s_suppkey) one, list_sort(list(distinct s_suppkey)) l from supplier where s_suppkey % 4 = 0 group by 1)
select n_nationkey, case when n = 1 then one end resolved, case when n = 1 then 'unique' when n is null then 'none' else 'ambiguous' end outcome, case when n > 1 then array_to_string(l[1:20], '|') end candidates from nation left join c on n_nationkey = s_nationkey""")
def resolve_unique(t: Tables):
    c = t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return rel.unique_only(t.nation.select("n_nationkey"), c, "n_nationkey", "s_suppkey")


@query("fallback_join", f"""
with k1 as (select o_custkey k, arg_min((o_orderkey, o_orderstatus), (o_orderstatus <> 'F', o_orderdate, o_orderkey)) v from orders group by 1),
k2 as (select c_nationkey k, arg_min((o_orderkey, o_orderstatus), (o_orderstatus <> 'F', o_orderdate, o_orderkey)) v from orders join customer on o_custkey = c_custkey group by 1)
select c_custkey, case when k1.v is not null then 'symbol' when k2.v is not null then 'name' end matched_by, coalesce(k1.v, k2.v)[1] row_id, coalesce(k1.v, k2.v)[2] o_orderstatus from customer left join k1 on c_custkey % 2000 = k1.k left join k2 on c_nationkey = k2.k""")
def fallback_join(t: Tables):
    table = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey").withColumnRenamed("o_orderkey", "row_id")
    d = t.customer.select("c_custkey", (F.col("c_custkey") % 2000).alias("sym"), "c_nationkey")
    out = rel.ranked_fallback(d, table, [("symbol", "sym", "o_custkey"), ("name", "c_nationkey", "nation")], [(F.col("o_orderstatus") != "F").alias("p"), F.col("o_orderdate"), F.col("row_id")], ["row_id", "o_orderstatus"], "c_custkey")
    return out.select("c_custkey", "matched_by", "row_id", "o_orderstatus")


@query("resolver_union", """
with a as (select c_custkey k, c_nationkey v from customer where c_custkey % 3 <> 0), b as (select c_custkey k, c_nationkey + 100 v from customer where c_custkey % 2 = 0)
select coalesce(a.k, b.k) k, coalesce(a.v, b.v) v, case when a.v is not null and b.v is not null then 'both' when a.v is not null then 'strict' else 'extended' end source from a full join b on a.k = b.k""")
def resolver_union(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return rel.merge_resolvers(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("v", F.col("v") + 100), "k", "v")


@query("verdict_overlay", "select c_custkey, case when c_custkey % 7 = 0 then 1 else (c_nationkey > 12)::int end flag, case when c_custkey % 7 = 0 then 'human' else 'auto' end value_source from customer")
def verdict_overlay(t: Tables):
    c = t.customer.select("c_custkey", (F.col("c_nationkey") > 12).cast("int").alias("flag"))
    return rel.overlay(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit(1).alias("verdict")), "c_custkey", "flag", "verdict")


@query("candidate_attribution", """
with c as (select c_custkey, unnest(['Supplier#' || lpad((c_custkey % 40)::varchar, 9, '0'), 'Supplier#' || lpad((c_custkey % 11)::varchar, 9, '0')]) title, unnest([0, 1]) pos from customer),
f as (select c.*, s_suppkey from c join supplier on s_name = title where s_acctbal > 0)
select k.c_custkey, arg_min(title, pos) attributed, count(title) filter (where title is not null) n_found from (select c_custkey from customer) k left join f using (c_custkey) group by 1 having count(title) > 0
union all select c_custkey, null, null from customer where c_custkey not in (select c_custkey from f)""")
def candidate_attribution(t: Tables):
    name = lambda n: F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % n).cast("string"), 9, "0"))
    c = t.customer.select("c_custkey", F.array(name(40), name(11)).alias("tried"))
    return rel.first_candidate(c, "tried", t.supplier.withColumnRenamed("s_name", "title"), "title", F.col("s_acctbal") > 0)


@query("redirect_resolve", "with e as (select n_nationkey src, min(n_regionkey) dst from nation where n_nationkey % 2 = 0 group by 1) select c_custkey, coalesce(dst, c_nationkey) target from customer left join e on c_nationkey = src")
def redirect_resolve(t: Tables):
    e = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return rel.follow(t.customer, e, "c_nationkey").select("c_custkey", "target")


@query("relation_candidates", """
with e as (select distinct o_custkey node, o_orderpriority "rule", left(o_orderpriority, 1)::int rule_rank, (o_orderkey % 5)::varchar dst from orders where o_orderstatus = 'P'), n as (select o_custkey node, count(*) n_edges from orders where o_orderstatus = 'P' group by 1)
select node, array_to_string(list("rule" || ':' || dst order by rule_rank, dst), '|') candidates, n_edges from e join n using (node) group by 1, 3""")
def relation_candidates(t: Tables):
    o = t.orders.where("o_orderstatus = 'P'")
    e = o.select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("rule"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rule_rank"), (F.col("o_orderkey") % 5).cast("string").alias("dst"))
    return rel.relation_candidates(o.select(F.col("o_custkey").alias("node")).distinct(), e, "node")


@query("semi_union", f"with {LISTINGS}, {MENTIONS} select distinct user_id from events where user_id in (select issuer_id from listings where open_price > 50) or user_id in (select issuer_id from mentions where engagement > 200)")
def semi_union(t: Tables):
    return rel.member_of_any(t.events.select("user_id").distinct(), "user_id", t.listings.where("open_price > 50").select("issuer_id"), t.mentions.where("engagement > 200").select("issuer_id"))


@query("exists_anti_queue", f"""
with {FILINGS} select f.filing_id, f.issuer_id, f.filed_on from filings f where form = 'S-1' and exists (select 1 from filings g where g.issuer_id = f.issuer_id and g.form = 'DRS' and g.filed_on < f.filed_on)
 and not exists (select 1 from filings h where h.issuer_id = f.issuer_id and h.form = '424B4' and date_trunc('month', h.filed_on) = date_trunc('month', f.filed_on))""")
def exists_anti_queue(t: Tables):
    f = t.filings.where("form = 'S-1'").withColumn("m", F.trunc("filed_on", "MM"))
    g = t.filings.where("form = 'DRS'").groupBy("issuer_id").agg(F.min("filed_on").alias("_d"))
    h = t.filings.where("form = '424B4'").select("issuer_id", F.trunc("filed_on", "MM").alias("m")).distinct()
    f = f.join(g.withColumnRenamed("issuer_id", "_i"), (F.col("issuer_id") == F.col("_i")) & (F.col("_d") < F.col("filed_on")), "left_semi")
    return rel.todo(f, h, ["issuer_id", "m"]).select("filing_id", "issuer_id", "filed_on")


@query("event_counts", f"with {LISTINGS}, {MENTIONS}, {BARS} select issuer_id, (select count(*) from mentions m where m.issuer_id = l.issuer_id) n_mentions, (select count(*) from bars b where b.issuer_id = l.issuer_id and volume > 1) n_bars from listings l")
def event_counts(t: Tables):
    return rel.counts_of(t.listings.select("issuer_id"), "issuer_id", n_mentions=t.mentions, n_bars=t.bars.where("volume > 1"))


@query("review_queue", f"with {MENTIONS}, {LISTINGS} select mention_id, m.issuer_id, posted_at, l.listed_on from mentions m left join listings l on l.issuer_id = m.issuer_id and l.open_price > 20 where needs_review order by posted_at desc, mention_id desc limit 100")
def review_queue(t: Tables):
    q = t.mentions.where("needs_review").join(t.listings.where("open_price > 20").select("issuer_id", "listed_on"), "issuer_id", "left")
    return q.orderBy(F.desc("posted_at"), F.desc("mention_id")).limit(100).select("mention_id", "issuer_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "listed_on")


@query("validated_join", "select o_orderkey, c_name, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def validated_join(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    o = rel.validated_join(t.orders, c, ["o_custkey"])
    return rel.validated_join(o, t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("coverage_gap", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def coverage_gap(t: Tables):
    return rel.todo(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("resume_todo", "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_todo(t: Tables):
    return rel.todo(t.orders.select("o_orderkey", "o_custkey"), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("feed_reconcile", """
with a as (select l_partkey k, l_shipdate::date d, max(l_extendedprice) v from lineitem where l_linenumber <= 3 group by 1, 2), b as (select l_partkey k, l_shipdate::date d, max(l_extendedprice) v from lineitem where l_linenumber > 2 group by 1, 2)
select k, d, round(a.v, 6) v_a, round(b.v, 6) v_b, round(abs(a.v - b.v), 6) abs_diff, abs(a.v - b.v) <= 0.02 agrees from a join b using (k, d) order by abs(a.v - b.v) desc, k, d limit 50""")
def feed_reconcile(t: Tables):
    f = t.lineitem.select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("v"), "l_linenumber")
    best = lambda x: x.groupBy("k", "d").agg(F.max("v").alias("v"))
    out = rel.reconcile(best(f.where("l_linenumber <= 3")), best(f.where("l_linenumber > 2")), ["k", "d"], "v", 0.02).orderBy(F.desc("abs_diff"), "k", "d").limit(50)
    return out.withColumns({c: F.round(c, 6) for c in ("v_a", "v_b", "abs_diff")})


@query("tape_reconcile", f"""
with {BARS}, {LISTINGS}, f as (select issuer_id, min(day) d from bars where volume >= 2 group by 1)
select l.issuer_id, listed_on, d first_trade, case when l.issuer_id % 5 = 0 then 'no_ticker' when listed_on < date '2024-01-02' then 'outside_entitlement' when d is null then 'no_bars' when d = listed_on then 'agrees' else 'corrected' end verdict,
 case when l.issuer_id % 5 <> 0 and listed_on >= date '2024-01-02' and d <> listed_on then (d - listed_on)::int end delta_days from listings l left join f using (issuer_id)""")
def tape_reconcile(t: Tables):
    first = t.bars.where("volume >= 2").groupBy("issuer_id").agg(F.min("day").alias("first_trade"))
    j = t.listings.select("issuer_id", "listed_on").join(first, "issuer_id", "left")
    verdict = cohort.first_reason(("no_ticker", F.col("issuer_id") % 5 == 0), ("outside_entitlement", F.col("listed_on") < F.lit("2024-01-02").cast("date")), ("no_bars", F.col("first_trade").isNull()), ("agrees", F.col("first_trade") == F.col("listed_on")), otherwise="corrected")
    j = j.withColumn("verdict", verdict)
    return j.withColumn("delta_days", F.when(F.col("verdict") == "corrected", F.datediff("first_trade", "listed_on")))


@query("bank_key", "select s_suppkey, 'supplier ' || regexp_extract(s_name, '[0-9]+') bank from supplier")
def bank_key(t: Tables):
    n = F.concat("s_name", F.element_at(F.array(*map(F.lit, (" Securities, LLC", " & Co.", " Capital Markets Inc.", ""))), (F.col("s_suppkey") % 3 + 1).cast("int")))
    n = F.when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" Co."))).otherwise(n)
    return t.supplier.select("s_suppkey", names.bank_key(n).alias("bank"))


@query("filing_path", "select o_orderkey, case when o_orderkey % 7 <> 0 then 'edgar/data/' || o_custkey || '/0001' || o_orderkey || '/doc.htm' end path from orders")
def filing_path(t: Tables):
    cik = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
    return t.orders.select("o_orderkey", names.filing_path(cik, F.concat(F.lit("0001-"), F.col("o_orderkey").cast("string")), F.lit("doc.htm")).alias("path"))


@query("confidence_gate", f"with {FILINGS} select filing_id, case when form = '424B4' and amount / 500000 >= 0.6 then round(amount, 2) end price, form = '424B4' and amount / 500000 >= 0.6 written from filings")
def confidence_gate(t: Tables):
    ok = (F.col("form") == "424B4") & (F.col("amount") / 500000 >= 0.6)
    return t.filings.select("filing_id", F.when(ok, F.round("amount", 2)).alias("price"), ok.alias("written"))
