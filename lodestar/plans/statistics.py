"""Tests and regressions on the outcome table and the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import quotient
from ..operators import aggregates as agg, attention, stats, timeseries as ts
from ..operators.quantiles import saved
from .bindings import BARS, LISTINGS, MENTIONS, OUTCOMES, Tables
from .registry import query

_RET = "close / offer - 1"
_PANEL = f"""with {MENTIONS}, {BARS}, d as (select issuer_id, posted_at::date as day, count(*) m from mentions where not needs_review group by 1, 2),
r as (select issuer_id, day, close, lead(close) over (partition by issuer_id order by day) nc from bars where close > 0), p as (select d.issuer_id, d.day, m, nc / close - 1 ret from d join r using (issuer_id, day) where nc is not null)"""


def _rank(x: str, part: str = "") -> str:
    by = f"partition by {part} " if part else ""
    p2 = f"partition by {part + ', ' if part else ''}{x}"
    return f"rank() over ({by}order by {x}) + (count(*) over ({p2}) - 1) / 2"


def _panel(t: Tables):
    return attention.panel(t.mentions.where("not needs_review"), t.bars).select("issuer_id", "day", F.col("mention_count").alias("m"), F.col("next_return").alias("ret"))


def _outcomes(t: Tables):
    return t.outcomes.withColumn("ret", F.col("close") / F.col("offer") - 1)


@query("spearman_pooled", f"{_PANEL}, k as (select {_rank('m')} a, {_rank('ret')} b from p) select count(*) n, round(coalesce(corr(a, b), 0), 6) rho from k")
def spearman_pooled(t: Tables):
    return stats.spearman(_panel(t), "m", "ret").withColumn("rho", F.round("rho", 6))


@query("spearman_by_entity", f"{_PANEL}, k as (select issuer_id, {_rank('m', 'issuer_id')} a, {_rank('ret', 'issuer_id')} b from p) select issuer_id, count(*) n, round(case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) else 0 end, 6) rho from k group by 1 having count(*) >= 10")
def spearman_by_entity(t: Tables):
    return stats.spearman(_panel(t), "m", "ret", ["issuer_id"], 10).withColumn("rho", F.round("rho", 6))


@query("fisher_ci", f"{_PANEL}, k as (select issuer_id, {_rank('m', 'issuer_id')} a, {_rank('ret', 'issuer_id')} b from p), g as (select issuer_id, count(*) n, case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) else 0 end rho from k group by 1 having count(*) >= 10) select issuer_id, round(tanh(atanh(rho) - 1.96 / sqrt(n - 3)), 6) lo, round(tanh(atanh(rho) + 1.96 / sqrt(n - 3)), 6) hi, tanh(atanh(rho) - 1.96 / sqrt(n - 3)) < 0 and tanh(atanh(rho) + 1.96 / sqrt(n - 3)) > 0 spans_zero from g")
def fisher_ci(t: Tables):
    g = stats.spearman(_panel(t), "m", "ret", ["issuer_id"], 10)
    lo, hi = stats.fisher_interval(F.col("rho"), F.col("n"))
    return g.select("issuer_id", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), ((lo < 0) & (hi > 0)).alias("spans_zero"))


_EVENT = f"with {MENTIONS}, {LISTINGS}, e as (select l.issuer_id, count(mention_id) n, max(open_price) px from listings l left join mentions m on m.issuer_id = l.issuer_id and posted_at >= l.listed_on - interval 14 day and posted_at < l.listed_on + interval 15 day group by 1)"


@query("permutation_test", f"""{_EVENT}, r as (select issuer_id, {_rank('n')} a, {_rank('px')} b, row_number() over (order by issuer_id) pos from e),
s as (select q.k, r.a, row_number() over (partition by q.k order by md5('p' || q.k || ':' || issuer_id), issuer_id) pos from r, range(0, 10000) q(k)),
x as (select s.k, sum(s.a * r.b) t from s join r on s.pos = r.pos group by 1), o as (select count(*) n, sum(a * b) obs, count(*) * avg(a) * avg(b) c, corr(a, b) rho from r)
select n, round(rho, 6) rho, count(*) filter (where abs(t - c) >= abs(obs - c) - 1e-9) extreme, round((count(*) filter (where abs(t - c) >= abs(obs - c) - 1e-9) + 1) / (count(*) + 1), 6) p from x, o group by n, rho""")
def permutation_test(t: Tables):
    e = ts.window_counts(t.listings.select("issuer_id", "listed_on", "open_price"), t.mentions, "issuer_id", "posted_at", "listed_on", 14, 14)
    r = stats.permutation_test(e.withColumnRenamed("n_points", "cnt"), "issuer_id", "cnt", "open_price", 10_000)
    return r.select("n", F.round("rho", 6).alias("rho"), "extreme", F.round("p", 6).alias("p"))


@query("welch_diff", f"""with {OUTCOMES}, o as (select treated f, {_RET} v from outcomes), g as (select count(*) filter (where f = 1) n1, count(*) filter (where f = 0) n0, avg(v) filter (where f = 1) mean1, avg(v) filter (where f = 0) mean0, var_samp(v) filter (where f = 1) / count(*) filter (where f = 1) a, var_samp(v) filter (where f = 0) / count(*) filter (where f = 0) b from o)
select n1, n0, round(mean1, 6) mean1, round(mean0, 6) mean0, round(mean1 - mean0, 6) diff, round(sqrt(a + b), 6) se, round((mean1 - mean0) / sqrt(a + b), 6) t, round(mean1 - mean0 - 1.96 * sqrt(a + b), 6) lo, round(mean1 - mean0 + 1.96 * sqrt(a + b), 6) hi from g""")
def welch_diff(t: Tables):
    w = stats.welch(_outcomes(t), "treated", "ret")
    return w.select("n1", "n0", *[F.round(c, 6).alias(c) for c in ("mean1", "mean0", "diff", "se", "t", "lo", "hi")])


_SPEC = {"base": "treated", "ambiguous_on": "case when size_code % 7 = 0 then 1 else treated end", "ambiguous_off": "case when size_code % 7 = 0 then 0 else treated end", "ambiguous_out": "case when size_code % 7 <> 0 then treated end"}


@query("spec_curve", f"""with {OUTCOMES}, o as ({" union all ".join(f"select '{k}' spec, {c} f, {_RET} v from outcomes" for k, c in _SPEC.items())}),
g as (select spec, count(*) filter (where f = 1) n1, count(*) filter (where f = 0) n0, avg(v) filter (where f = 1) - avg(v) filter (where f = 0) diff, sqrt(var_samp(v) filter (where f = 1) / count(*) filter (where f = 1) + var_samp(v) filter (where f = 0) / count(*) filter (where f = 0)) se from o group by 1)
select spec, n1, n0, round(diff, 6) diff, round(se, 6) se, round(diff / se, 6) t from g""")
def spec_curve(t: Tables):
    each = _outcomes(t).select("ret", F.inline(F.array(*[F.struct(F.lit(k).alias("spec"), F.expr(c).alias("f")) for k, c in _SPEC.items()])))
    w = stats.welch(each, "f", "ret", ["spec"])
    return w.select("spec", "n1", "n0", *[F.round(c, 6).alias(c) for c in ("diff", "se", "t")])


@query("mann_whitney", f"""with {OUTCOMES}, o as (select treated f, {_RET} v from outcomes), r as (select f, v, {_rank('v')} rk from o),
g as (select (count(*) filter (where f = 1))::double n1, (count(*) filter (where f = 0))::double n0, sum(rk) filter (where f = 1) r1 from r), tt as (select sum(c::double ** 3 - c) ties from (select count(*) c from o group by v)),
u as (select n1, n0, r1 - n1 * (n1 + 1) / 2 u, n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1))) var from g, tt)
select n1::bigint n1, n0::bigint n0, u, round((u - n1 * n0 / 2) / sqrt(var), 6) z, round(2 * u / (n1 * n0) - 1, 6) rank_biserial from u""")
def mann_whitney(t: Tables):
    m = stats.mann_whitney(_outcomes(t), "treated", "ret")
    return m.select("n1", "n0", "u", F.round("z", 6).alias("z"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query("mann_whitney_p")
def mann_whitney_p(t: Tables):
    return stats.mann_whitney(_outcomes(t), "treated", "ret")


@query("sign_test", """
with c as (select user_id, count(*) filter (where event_type = 'view') a, count(*) filter (where event_type = 'click') b from events group by 1),
s as (select count(*) filter (where a > b) s, count(*) filter (where a <> b) n from c)
select s successes, n, round(least(1, 2 * (select sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) from range(0, 5000) r(k) where k between s and n)), 6) p from s""")
def sign_test(t: Tables):
    c = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    s = c.agg(F.count_if(F.col("a") > F.col("b")).alias("successes"), F.count_if(F.col("a") != F.col("b")).alias("n"))
    return s.select("successes", "n", F.round(stats.sign_test(F.col("successes"), F.col("n")), 6).alias("p"))


@query("winsorize", f"with {OUTCOMES}, o as (select order_id, line, {_RET} v from outcomes), q as (select quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi from o) select order_id, line, round(least(greatest(v, lo), hi), 6) w from o, q")
def winsorize(t: Tables):
    return stats.winsorize(_outcomes(t), "ret").select("order_id", "line", F.round("winsorized", 6).alias("w"))


@query("ols_simple", f"""with {OUTCOMES}, o as (select {_RET} y, discount x from outcomes), m as (select regr_slope(y, x) b, regr_intercept(y, x) a, regr_r2(y, x) r2, count(*) n, avg(x) mx, regr_sxx(y, x) sxx from o),
e as (select sum((y - a - b * x) ** 2 * (x - mx) ** 2) meat, max(n) n, max(b) b, max(a) a, max(r2) r2, max(sxx) sxx from o, m)
select n, round(a, 6) const, round(b, 6) slope, round(r2, 6) r2, round(sqrt(n / (n - 2) * meat) / sxx, 6) se_slope from e""")
def ols_simple(t: Tables):
    r = stats.ols(_outcomes(t), "ret", ["discount"])
    const, slope = F.col("name") == "const", F.col("name") == "discount"
    pick = lambda c, k: F.round(F.max(F.when(k, F.col(c))), 6)
    return r.agg(F.max("n").alias("n"), pick("coef", const).alias("const"), pick("coef", slope).alias("slope"), pick("r2", const).alias("r2"), pick("se", slope).alias("se_slope"))


@query("ols_hc1")
def ols_hc1(t: Tables):
    o = _outcomes(t).withColumn("yr", F.year("day"))
    return stats.ols(o, "ret", ["treated", "discount"], {"yr": list(range(1995, 2002))})


@query("ols_cluster")
def ols_cluster(t: Tables):
    from ..functions.dates import year_quarter

    o = _outcomes(t).withColumns({"yr": F.year("day"), "yq": year_quarter(F.col("day"))})
    return stats.ols(o, "ret", ["treated", "discount"], {"yr": list(range(1995, 2002))}, cluster="yq")


@query("ols_absorbed", f"""with {OUTCOMES}, o as (select entity_id, {_RET} y, discount x from outcomes),
d as (select y - avg(y) over (partition by entity_id) y, x - avg(x) over (partition by entity_id) x from o), t as (select count(*) n, count(distinct entity_id) g, var_pop(y) * count(*) sst from o),
b as (select sum(x * y) / sum(x * x) b, sum(x * x) sxx from d), e as (select sum((y - b * x) ** 2 * x * x) meat, sum((y - b * x) ** 2) ssr, max(b) b, max(sxx) sxx from d, b)
select n, round(b, 6) slope, round(sqrt(n / (n - g - 1) * meat) / sxx, 6) se_slope, round(1 - ssr / sst, 6) r2 from e, t""")
def ols_absorbed(t: Tables):
    """A dummy for every part, absorbed."""
    r = stats.ols_absorbed(_outcomes(t), "ret", ["discount"], ["entity_id"])
    return r.select("n", F.round("coef", 6).alias("slope"), F.round("se", 6).alias("se_slope"), F.round("r2", 6).alias("r2"))


@query("stratified_diff", f"with {OUTCOMES}, o as (select *, {_RET} v from outcomes) select kind stratum, count(*) filter (where treated = 1) n1, count(*) filter (where treated = 0) n0, round(quantile_cont(case when treated = 1 then v end, 0.5), 6) median1, round(quantile_cont(case when treated = 0 then v end, 0.5), 6) median0, round(quantile_cont(case when treated = 1 then v end, 0.5) - quantile_cont(case when treated = 0 then v end, 0.5), 6) diff from o group by 1")
def stratified_diff(t: Tables):
    d = stats.stratified_difference(_outcomes(t), F.col("kind"), "treated", "ret")
    return d.select("stratum", "n1", "n0", *[F.round(c, 6).alias(c) for c in ("median1", "median0", "diff")])


@query("underpricing_outcome", f"with {OUTCOMES} select order_id, line, round(close / offer - 1, 6) ret, round((close / offer - 1) * 100, 4) ret_pct from outcomes")
def underpricing_outcome(t: Tables):
    r = F.try_divide("close", "offer") - 1
    return t.outcomes.select("order_id", "line", F.round(r, 6).alias("ret"), F.round(r * 100, 4).alias("ret_pct"))


@query("analysis_table", f"""
with {OUTCOMES}, s as (select entity_id, arg_min(offer, (day, order_id, line)) offer, arg_min(close, (day, order_id, line)) as close, min(day) first_day, count(*) n from outcomes group by 1),
a as (select p_partkey, min(o_orderdate)::date created from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where o_orderpriority = '1-URGENT' group by 1)
select entity_id, first_day, n, created, coalesce(created <= first_day - 30, false) treated, round(close / offer - 1, 6) outcome from s left join a on entity_id = p_partkey""")
def analysis_table(t: Tables):
    order = F.struct("day", "order_id", "line")
    s = t.outcomes.groupBy("entity_id").agg(F.min_by("offer", order).alias("offer"), F.min_by("close", order).alias("close"), F.min("day").alias("first_day"), F.count("*").alias("n"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    a = t.lineitem.select("l_orderkey", "l_partkey").join(urgent, "l_orderkey").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.to_date(F.min("o_orderdate")).alias("created"))
    j = s.join(a, "entity_id", "left")
    return j.select("entity_id", "first_day", "n", "created", F.coalesce(F.col("created") <= F.date_sub("first_day", 30), F.lit(False)).alias("treated"), F.round(F.try_divide("close", "offer") - 1, 6).alias("outcome"))


_REPORT = f"""{_EVENT}, h(horizon) as (values (5), (10), (20)), {BARS},
x as (select l.issuer_id, horizon, l.open_price, listed_on + horizon::int tgt from listings l, h),
a as (select x.issuer_id, horizon, open_price, arg_min(b.close, b.day) c from x join bars b on b.issuer_id = x.issuer_id and b.day >= tgt group by all),
o as (select a.issuer_id, horizon, e.n, c / open_price - 1 ret from a join e using (issuer_id)),
r as (select *, {_rank('n', 'horizon')} ra, {_rank('ret', 'horizon')} rb, row_number() over (partition by horizon order by n) k, row_number() over (partition by horizon order by ret) kr, count(*) over (partition by horizon) c from o),
m as (select horizon, max(case when k = c // 2 + 1 then n end) med, max(case when kr = c // 2 + 1 then ret end) med_ret from r group by 1)
select r.horizon, count(*) n, count(*) filter (where n > 0) n_nonzero, round(case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) else 0 end, 6) rho, round(max(med_ret), 6) median_return,
 round(avg(ret) filter (where n >= med), 6) mean_high, round(avg(ret) filter (where n < med), 6) mean_low, count(*) filter (where n > 0) < 20 underpowered from r join m on r.horizon = m.horizon group by 1"""


@query("event_study_report", _REPORT)
def event_study_report(t: Tables):
    e = ts.window_counts(t.listings, t.mentions, "issuer_id", "posted_at", "listed_on", 14, 14).withColumnRenamed("n_points", "cnt")
    x = e.withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).withColumn("target", F.date_add("listed_on", F.col("horizon")))
    o = ts.asof_forward(x, t.bars, "issuer_id", "target", "day", "close").where("asof_value is not null").withColumn("ret", quotient(F.col("asof_value"), F.col("open_price")) - 1)
    o = saved(o.select("issuer_id", "horizon", "cnt", "ret"), "horizons")  # four aggregates read it
    rho = stats.spearman(o, "cnt", "ret", ["horizon"]).select("horizon", "rho")
    med = agg.upper_median(o, "cnt", ["horizon"]).select("horizon", F.col("upper_median").alias("med")).join(agg.upper_median(o, "ret", ["horizon"]).select("horizon", F.col("upper_median").alias("med_ret")), "horizon")
    g = o.join(med, "horizon").groupBy("horizon").agg(
        F.count("*").alias("n"), F.count_if(F.col("cnt") > 0).alias("n_nonzero"), F.round(F.max("med_ret"), 6).alias("median_return"),
        F.round(F.avg(F.when(F.col("cnt") >= F.col("med"), F.col("ret"))), 6).alias("mean_high"), F.round(F.avg(F.when(F.col("cnt") < F.col("med"), F.col("ret"))), 6).alias("mean_low"),
    )
    return g.join(rho, "horizon").select("horizon", "n", "n_nonzero", F.round("rho", 6).alias("rho"), "median_return", "mean_high", "mean_low", (F.col("n_nonzero") < 20).alias("underpowered"))


@query("sign_consistency", f"select count(distinct sign(rho)) = 1 consistent, count(*) horizons from ({_REPORT})")
def sign_consistency(t: Tables):
    return event_study_report(t).agg((F.countDistinct(F.signum("rho")) == 1).alias("consistent"), F.count("*").alias("horizons"))
