"""Snapshot merges, retention, reviews and table expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attention, expectations as exp, upsert as up
from .bindings import FILINGS, MENTIONS, Tables
from .registry import query

_SEQ = "(o_orderkey)"
_SPLIT = "o_orderkey % 3 <> 0"  # rows of the base; the others are updates


def _halves(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("sector"), F.to_date("o_orderdate").alias("first_filed"), F.expr("case o_orderstatus when 'F' then 'filed' when 'O' then 'priced' else 'listed' end").alias("status"), "o_totalprice")
    base = o.where("seq % 3 <> 0")
    # The base is a snapshot: one row a key.
    return base.groupBy("k").agg(F.max_by(F.struct("name", "sector", "first_filed", "status", "o_totalprice"), "seq").alias("r")).select("k", "r.*"), o.where("seq % 3 = 0")


_MERGE = """with o as (select o_custkey k, o_orderkey seq, o_orderpriority as name, case when o_orderkey % 5 <> 0 then o_orderstatus end sector, o_orderdate::date first_filed, case o_orderstatus when 'F' then 'filed' when 'O' then 'priced' else 'listed' end status, o_totalprice from orders),
b as (select * from o where seq % 3 <> 0 qualify row_number() over (partition by k order by seq desc) = 1), u as (select 0 batch, 0 s, * exclude (seq) from b union all select 1, seq, * exclude (seq) from o where seq % 3 = 0)"""


@query("merge_entities", f"""{_MERGE} select k, arg_max(name, (batch, s)) as name, arg_max(sector, (batch, s)) filter (where sector is not null) sector, min(first_filed) first_filed,
 case max(case status when 'filed' then 0 when 'priced' then 1 else 2 end) when 0 then 'filed' when 1 then 'priced' else 'listed' end status from u group by 1""")
def merge_entities(t: Tables):
    base, upd = _halves(t)
    return up.merge_snapshot(base, upd, ["k"], {"name": up.LAST, "sector": up.LAST_KNOWN, "first_filed": up.LEAST, "status": up.ladder(["filed", "priced", "listed"], ["withdrawn"])}, "seq")


@query("merge_terms", f"""{_MERGE}, p as (select *, case when o_totalprice > 200000 then o_totalprice end price, status = 'listed' disclosed from u)
select k, round(arg_max(price, (batch, s)) filter (where price is not null), 2) price, bool_or(disclosed) disclosed, max(o_totalprice) top, arg_min(name, (batch, s)) first_name from p group by 1""")
def merge_terms(t: Tables):
    def terms(df):
        return df.withColumns({"price": F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")), "disclosed": F.col("status") == "listed", "top": F.col("o_totalprice"), "first_name": F.col("name")})

    base, upd = map(terms, _halves(t))
    out = up.merge_snapshot(base, upd, ["k"], {"price": up.LAST_KNOWN, "disclosed": up.ANY, "top": up.GREATEST, "first_name": up.FIRST}, "seq")
    return out.withColumn("price", F.round("price", 2))


@query("merge_events", f"""{_MERGE} select k, case when bool_or(status = 'listed') then 'listed' else arg_max(status, (batch, s)) end status, arg_min(first_filed, (batch, s)) first_id, min(first_filed) filed, arg_max(sector, (batch, s)) filter (where sector is not null) ticker from u group by 1""")
def merge_events(t: Tables):
    def events(df):
        return df.withColumns({"first_id": F.col("first_filed"), "filed": F.col("first_filed"), "ticker": F.col("sector")})

    def terminal(c, seq):
        return F.when(F.bool_or(c == "listed"), "listed").otherwise(F.max_by(c, seq))

    base, upd = map(events, _halves(t))
    return up.merge_snapshot(base, upd, ["k"], {"status": terminal, "first_id": up.FIRST, "filed": up.LEAST, "ticker": up.LAST_KNOWN}, "seq")


@query("merge_last_wins", "with u as (select user_id, ts::date as day, value, event_id from events) select user_id, day, round(arg_max(value, (event_id % 2, event_id)), 6) as value from u group by 1, 2")
def merge_last_wins(t: Tables):
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "value", "event_id")
    base = e.where("event_id % 2 = 0").groupBy("user_id", "day").agg(F.max_by("value", "event_id").alias("value"))
    return up.merge_snapshot(base, e.where("event_id % 2 = 1"), ["user_id", "day"], {"value": up.LAST}, "event_id").withColumn("value", F.round("value", 6))


@query("insert_ignore", "with b as (select distinct user_id, event_type from events where event_id % 4 = 0 and value < 20), u as (select * from events where event_id % 4 <> 0) select user_id, event_type, event_id from u where (user_id, event_type) not in (select user_id, event_type from b) qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def insert_ignore(t: Tables):
    e = t.events.select("user_id", "event_type", "event_id", "value")
    new, _ = up.insert_ignore(e.where("event_id % 4 = 0 and value < 20"), e.where("event_id % 4 <> 0"), ["user_id", "event_type"], ["event_id"])
    return new.select("user_id", "event_type", "event_id")


@query("apply_review", f"""with {MENTIONS}, d as (select mention_id, case when mention_id % 2 = 0 then 'confirm' else 'reject' end decision from mentions where mention_id % 3 = 0)
select m.mention_id, case when needs_review and decision = 'reject' then null else issuer_id end issuer_id, case when needs_review and decision = 'confirm' then 1.0 when needs_review and decision = 'reject' then 0.0 else 0.5 end::double confidence, needs_review and decision is null needs_review from mentions m left join d using (mention_id)""")
def apply_review(t: Tables):
    m = t.mentions.select("mention_id", "issuer_id", "needs_review", F.lit(0.5).alias("confidence"))
    d = m.where("mention_id % 3 = 0").select("mention_id", F.when(F.col("mention_id") % 2 == 0, "confirm").otherwise("reject").alias("decision"))
    return up.apply_review(m, d, "mention_id").select("mention_id", "issuer_id", "confidence", "needs_review")


_RET = f"""with {MENTIONS}, m as (select mention_id, case when mention_id % 10 <> 0 then issuer_id end issuer_id, source, posted_at from mentions), r as (select distinct issuer_id, source, posted_at::date as day from m where issuer_id % 3 <> 0),
j as (select m.*, r.day is not null rolled, posted_at::date < date '2024-01-31' - 15 expired from m left join r on m.issuer_id = r.issuer_id and m.source = r.source and m.posted_at::date = r.day)"""


def _retained(t: Tables):
    m = t.mentions.select("mention_id", F.when(F.col("mention_id") % 10 != 0, F.col("issuer_id")).alias("issuer_id"), "source", "posted_at")
    rollup = attention.daily_rollup(m.where("issuer_id % 3 <> 0").withColumn("engagement", F.lit(1)), "mention_id")
    return up.retention(m, rollup, F.lit("2024-01-31").cast("date"), 15)


@query("retention_sweep", f"{_RET} select mention_id, issuer_id, source from j where not (expired and (issuer_id is null or rolled))")
def retention_sweep(t: Tables):
    return _retained(t)[0].select("mention_id", "issuer_id", "source")


@query("retention_report", f"{_RET} select count(*) filter (where expired) expired, count(*) filter (where expired and (issuer_id is null or rolled)) deleted, count(*) filter (where expired and not (issuer_id is null or rolled)) withheld from j")
def retention_report(t: Tables):
    return _retained(t)[1]


@query("check_enum", "select 'event_type' \"check\", count(*) filter (where event_type not in ('view', 'click', 'error', 'signup')) bad from events union all select 'status', count(*) filter (where o_orderstatus not in ('F', 'O')) from orders")
def check_enum(t: Tables):
    return exp.report(exp.violations(t.events, {"event_type": exp.in_set("event_type", ["view", "click", "error", "signup"])}), exp.violations(t.orders, {"status": exp.in_set("o_orderstatus", ["F", "O"])}))


@query("check_range", "select 'discount' \"check\", count(*) filter (where not l_discount between 0 and 0.05) bad from lineitem union all select 'ordered_pair', count(*) filter (where not l_discount <= l_tax) from lineitem")
def check_range(t: Tables):
    return exp.violations(t.lineitem, {"discount": exp.in_range("l_discount", 0, 0.05), "ordered_pair": F.col("l_discount") <= F.col("l_tax")})


@query("check_unique", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def check_unique(t: Tables):
    return exp.repeated(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("check_orphans", "select l_orderkey, l_linenumber, l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 3 <> 0)")
def check_orphans(t: Tables):
    return exp.orphans(t.lineitem, "l_suppkey", t.supplier.where("s_suppkey % 3 <> 0"), "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("check_nulls", f"with {FILINGS}, f as (select case when filing_id % 6 <> 0 then amount end amount, form from filings) select 'amount_not_null' \"check\", count(*) filter (where amount is null) bad from f union all select 'form_not_null', count(*) filter (where form is null) from f")
def check_nulls(t: Tables):
    f = t.filings.select(F.when(F.col("filing_id") % 6 != 0, F.col("amount")).alias("amount"), "form")
    return exp.violations(f, exp.not_null("amount", "form"))
