"""Known answers on tiny frames."""

import datetime
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, names, text
from lodestar.operators import aggregates, cohort, expectations, extract, match, paging, relations, stats, timeseries as ts, upsert
from lodestar.sources import landed


def one(df):
    return df.first()[0]


def day(s):
    return datetime.date.fromisoformat(s)


@pytest.mark.parametrize(
    "raw, want",
    [("First Breach, Inc.", "first breach"), ("Smith & Sons Co", "smith and sons"), ("Inc.", "inc"), ("Acme Holdings Group Ltd.", "acme"), ("", ""), (None, None)],
)
def test_company_key(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "n string").select(names.company_key(F.col("n")))) == want


def _aliases(spark, name, common=("first",)):
    i = spark.createDataFrame([(1, name, None)], "issuer_id long, legal_name string, ticker string")
    return {(r.alias, r.kind) for r in match.generate_aliases(i, spark.createDataFrame([(c,) for c in common], "token string")).collect()}


def test_aliases(spark):
    a = _aliases(spark, "First Breach, Inc.")
    assert ("first breach", "legal") in a and ("first", "brand") not in a
    assert ("electra", "brand") in _aliases(spark, "Electra Therapeutics, Inc.")


COMMON = ["click", "track", "pattern", "gold", "flash", "fast", "strategy", "cuts", "laser", "advance"]


def _score(spark, alias, kind, title, body=""):
    docs = spark.createDataFrame([(1, title, body)], "doc_id long, title string, body string")
    al = spark.createDataFrame([(7, alias, kind)], "issuer_id long, alias string, kind string")
    c = match.candidates(docs, al, "doc_id", F.concat_ws(" ", "title", "body"))
    ctx = match.context(docs, "doc_id", F.col("title"), F.col("body"))
    rows = match.score(c, spark.createDataFrame([(x,) for x in COMMON], "token string"), ctx, "doc_id").collect()
    return (rows[0].confidence, rows[0].reasons) if rows else (0.0, "")


def test_scores(spark):
    assert _score(spark, "oura", "legal", "", "Oura's rings found their way onto fingers")[0] >= 0.70
    assert _score(spark, "laser", "brand", "Household Laser Cuts")[0] < 0.45
    for w in ("click", "track", "pattern", "gold", "flash"):
        s, why = _score(spark, w, "legal", f"Show HN: a tool to {w} things")
        assert s < 0.70 and "no_distinctive_token" in why
    assert "financial_context+0.20" in _score(spark, "oura", "legal", "Oura S-1")[1]
    assert _score(spark, "fast track", "legal", "on the fast track")[0] < 0.45
    assert _score(spark, "ai strategy", "legal", "our AI strategy")[0] < 0.45
    assert _score(spark, "$oura", "cashtag", "buying $OURA today")[0] >= 0.9
    assert _score(spark, "oura", "legal", "the ouroboros pattern")[0] == 0.0
    assert _score(spark, "spinnova", "legal", "spinnovation in textiles")[0] == 0.0


def test_author_hash(spark):
    df = spark.createDataFrame([(" Alice ",), ("alice",), ("",), (None,)], "h string")
    got = [r[0] for r in df.select(text.author_hash(F.col("h"), "pepper")).collect()]
    want = hmac.new(b"pepper", b"alice", hashlib.sha256).hexdigest()
    assert got == [want, want, None, None]
    assert one(df.select(text.author_hash(F.col("h"), "salt"))) != want
    long = "x" * 100
    assert one(df.select(text.author_hash(F.col("h"), long))) == hmac.new(long.encode(), b"alice", hashlib.sha256).hexdigest()


@pytest.mark.parametrize(
    "raw, want",
    [("5.00", (5.0, 5.0, "5.00")), ("4-6", (4.0, 6.0, "4-6")), (None, (None, None, None)), ("", (None, None, None)), ("tbd", (None, None, "tbd")), ("5-x", (None, None, "5-x"))],
)
def test_clean_price(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "p string").select(cohort.clean_price(F.col("p")).alias("x")).select("x.*").first()) == want


def test_interval_union(spark):
    def covered(*spans):
        df = spark.createDataFrame([(1, day(a), day(b)) for a, b in spans], "e long, lo date, hi date")
        return one(ts.interval_union_days(df, "e", "lo", "hi").select("covered_days"))

    assert covered(("2024-01-01", "2024-01-31"), ("2024-01-01", "2024-01-21"), ("2024-01-01", "2024-01-11")) == 30
    assert covered(("2024-01-01", "2024-01-06"), ("2024-01-20", "2024-01-25")) == 10
    assert covered(("2024-01-01", "2024-01-15"), ("2024-01-10", "2024-01-20")) == 19


def test_form_timeline(spark):
    f = spark.createDataFrame([(1, "S-1", day("2024-09-30")), (1, "DRS", day("2024-06-17")), (1, "S-1/A", day("2024-10-10")), (2, "S-1", day("2024-02-22")), (2, "DRS", day("2021-12-16"))], "e long, form string, d date")
    r = {x.e: x for x in aggregates.form_timeline(f, "e", "form", "d", {"drs": ["DRS"], "s1": ["S-1"], "amend": ["S-1/A"]}, "drs", "s1").collect()}
    assert (r[1].gap_days, r[1].amend_count, r[1].notes) == (105, 1, "")
    assert r[2].gap_days == 798 and "long gap" in r[2].notes


@pytest.mark.parametrize(
    "name, symbol, want", [("Unity Software", "U", None), ("Snowflake", "SNOW", None), ("Finnovate Acquisition Corp", "FVNNU", "name"), ("Armada", "AACIU", "unit_suffix"), ("Armada", "AAC-U", "unit_class")]
)
def test_spac_rule(spark, name, symbol, want):
    assert one(spark.createDataFrame([(name, symbol)], "n string, s string").select(cohort.spac_rule(F.col("n"), F.col("s")))) == want


def test_mann_whitney(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (10, 11, 12, 13)] + [(0, float(x)) for x in (1, 2, 3, 4)], "f int, v double")
    r = stats.mann_whitney(df, "f", "v").first()
    assert r.u == 16 and r.rank_biserial == 1 and r.p_normal < 0.05
    flat = spark.createDataFrame([(i % 2, 5.0) for i in range(8)], "f int, v double")
    r = stats.mann_whitney(flat, "f", "v").first()
    assert r.rank_biserial == 0 and r.z is None
    few = stats.mann_whitney(df.limit(5), "f", "v").first()
    assert few.u is None


def test_ranks_sum(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(101)], "i long, v double")
    assert one(ts.average_rank(df, "v").agg(F.sum("avg_rank"))) == 101 * 102 / 2


def test_sign_test(spark):
    df = spark.createDataFrame([(11, 11), (1, 2), (0, 0), (0, 4)], "s int, n int")
    got = [r[0] for r in df.select(stats.sign_test(F.col("s"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(2 / 2**11) and got[1] == 1.0 and got[2] is None and got[3] == 1.0


def test_ols_recovers_coefficients(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 + 3.0 * i - 1.5 * (i % 3), i % 7) for i in range(60)], "a double, b double, y double, c int")
    for cluster in (None, "c"):
        r = {x.name: x for x in stats.ols(df, "y", ["a", "b"], cluster=cluster).collect()}
        assert [r[k].coef for k in ("const", "a", "b")] == pytest.approx([2, 3, -1.5], abs=1e-6) and r["a"].r2 == pytest.approx(1)


@pytest.mark.parametrize(
    "body, want",
    [
        ("public offering price per Class A Ordinary Share will be between $5 and $7 per share", ("disclosed", 5, 7, None)),
        ("at a fixed price of $2.00 per share for the duration", ("disclosed", None, None, 2)),
        ("initial public offering price will be between $ and $ per share", ("not_yet_disclosed", None, None, None)),
        ("offering price per unit is $10.00", ("not_found", None, None, None)),
        ("This prospectus relates to the resale of shares at $4.00 per share", ("not_found", None, None, None)),
        ("Public offering price\n$\n12.50", ("disclosed", None, None, 12.5)),
        ("assumed initial public offering price", ("not_yet_disclosed", None, None, None)),
        ("nothing here", ("not_found", None, None, None)),
        # The phrase may stand before another amount, or after the price.
        ("the public offering price is not $0.10 but $2.00 per share", ("disclosed", None, None, 2)),
        ("we sell at $3.50 per share, which is the price to the public", ("disclosed", None, None, 3.5)),
        ("warrants at $3.50 per share" + " x" * 200 + " offering price per", ("not_found", None, None, None)),
        # Out of bounds: under 1, over 500.
        ("public offering price of $0.50 per share", ("not_found", None, None, None)),
        ("public offering price of $501.00 per share", ("not_found", None, None, None)),
        ("public offering price of $500.00 per share", ("disclosed", None, None, 500)),
    ],
)
def test_price_terms(spark, body, want):
    r = spark.createDataFrame([(body,)], "t string").select(extract.price_terms(F.col("t"), F.col("t")).alias("x")).select("x.*").first()
    assert (r.disclosure, *[None if v is None else float(v) for v in (r.low, r.high, r.final)]) == want


BANKS = [("Goldman Sachs & Co. LLC", "goldman sachs"), ("Morgan Stanley", "morgan stanley"), ("Stanley", "stanley"), ("BofA Securities", "bofa securities")]


@pytest.mark.parametrize(
    "body, want",
    [
        ("x\nJoint Book-Running Managers\nGoldman Sachs & Co. LLC\nMorgan Stanley\n\nThe date of this prospectus is May 1", {("Goldman Sachs & Co. LLC", "lead", 0.9), ("Morgan Stanley", "lead", 0.9)}),
        ("Co-Managers\n* BofA Securities |", {("BofA Securities", "co_manager", 0.9)}),
        ("Underwriters\nBofA Securities", {("BofA Securities", None, 0.9)}),
        ("placement agent\nBofA Securities", {("BofA Securities", None, 0.9)}),
        ("SOLE  Placement\nAgent\nBofA Securities", {("BofA Securities", "lead", 0.9)}),
        ("BofA Securities\nProspectus dated May 1", {("BofA Securities", None, 0.6)}),
        ("Goldman Sachs\n" + "x " * 100_000 + "\nBofA Securities\nthe date of\nthis prospectus is now", {("BofA Securities", None, 0.6)}),
        # The first block that holds a bank gives its role; one of a long line isn't a bank's cell.
        ("Lead Manager\nMorgan Stanley\nCo-manager\nMorgan Stanley\nBofA Securities " + "and others " * 9, {("Morgan Stanley", "lead", 0.9)}),
        ("Lead Manager" + " " * 2 + "y" * 500 + "\nBofA Securities", set()),
        (None, set()),
        ("", set()),
    ],
)
def test_syndicate(spark, body, want):
    banks = spark.createDataFrame(BANKS, "bank string, surface string")
    got = extract.syndicate(spark.createDataFrame([(1, body)], "id long, t string"), banks, "id", "t").collect()
    assert {(r.bank, r.role, r.confidence) for r in got} == want and len(got) == len(want)


def test_banks_of_one_table_row(spark):
    page = "<p>Joint book-running managers</p><table><tr><td>Goldman Sachs</td><th>Morgan Stanley</th><td>BofA Securities</td></tr></table>"
    docs = spark.createDataFrame([(1, page)], "id long, h string").select("id", text.html_to_text(F.col("h")).alias("t"))
    got = extract.syndicate(docs, spark.createDataFrame(BANKS, "bank string, surface string"), "id", "t").collect()
    assert {r.bank for r in got} == {"Goldman Sachs & Co. LLC", "Morgan Stanley", "BofA Securities"} and {r.role for r in got} == {"lead"}


def test_cover_is_the_first_of_the_strongest_phrases(spark):
    first = "The date of this prospectus is May 1. Shares at a fixed price of $5.00 per share. "
    late = "initial public offering price of $9.00 per share"
    rows = [(1, first + "z " * 12_000 + late), (2, "q" * 30_000 + " Underwriting discount and commissions " + "q" * 30_000 + " we are offering "), (3, "nothing"), (4, "per share \n\n total")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", extract.cover("t").alias("c"), extract.price_terms(F.col("t"), extract.cover("t")).alias("x"))
    got = {r.id: r for r in df.collect()}
    assert got[1].c.startswith("The date") and float(got[1].x.final) == 5.0
    assert got[2].c.index("Underwriting") == 5000 and got[3].c == "nothing" and got[4].c == "per share \n\n total"


def test_html_to_text_against_a_plain_version(spark):
    """Every page of the smallest tables, and some odd ones."""
    import html
    import re

    odd = [None, "", "<td>a</td><td>b</td>", "a<br/>b&amp;&#233;&#x4E2D;&nbsp;c", "<SCRIPT x>if (a<b)</SCRIPT >t<style>p{}</style>u", "<p>a</p>\n \n<p> b</p>", "&lt;td&gt;"]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").union(spark.createDataFrame([(x,) for x in odd], "html string"))

    def plain(x):
        x = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", x)
        x = re.sub(r"(?i)<br\s*/?>|</(p|div|td|th|tr|li|h[1-6]|table|article|section|header|footer|nav|title)\s*>", "\n", x)
        x = html.unescape(re.sub(r"(?s)<[^>]*>", " ", x))
        return re.sub(r" *\n[ \n]*", "\n", re.sub("[ \t\r\f\u00a0\u2000-\u200a\u3000]+", " ", x)).strip(" \n")

    for r in pages.select("html", text.html_to_text(F.col("html")).alias("t")).collect():
        assert r.t == (None if r.html is None else plain(r.html))


def test_one_legal_alias(spark):
    issuers = spark.createDataFrame([(1, "First Breach, Inc.", "BRCH"), (2, "Electra Therapeutics, Inc.", None)], "issuer_id long, legal_name string, ticker string")
    got = {tuple(r) for r in match.generate_aliases(issuers, spark.createDataFrame([("first",)], "token string")).collect()}
    assert got == {(1, "first breach", "legal"), (1, "$brch", "cashtag"), (2, "electra therapeutics", "legal"), (2, "electra", "brand")}


def test_retention(spark):
    at = lambda s: datetime.datetime.fromisoformat(s)
    rows = [("aged_rolled", 1, at("2024-01-01T03:00:00")), ("aged_unmatched", None, at("2024-01-01T22:59:00")), ("aged_alone", 2, at("2024-01-01T10:00:00")), ("inside", 1, at("2024-01-11T00:00:00")), ("recent", 1, at("2024-04-01T00:00:00"))]
    m = spark.createDataFrame([(a, b, "hn", c) for a, b, c in rows], "id string, issuer_id long, source string, posted_at timestamp")
    roll = spark.createDataFrame([(1, day("2024-01-01"), "hn")], "issuer_id long, day date, source string")
    kept, report = upsert.retention(m, roll, F.lit("2024-04-10").cast("date"), 90)
    assert {r.id for r in kept.collect()} == {"aged_alone", "inside", "recent"}
    assert tuple(report.first()) == (3, 2, 1)
    again, report = upsert.retention(kept, roll, F.lit("2024-04-10").cast("date"), 90)
    assert again.count() == 3 and report.first().deleted == 0


def test_merge_is_idempotent_and_sticky(spark):
    base = spark.createDataFrame([(1, "a", "priced", None)], "k long, name string, status string, sector string")
    upd = spark.createDataFrame([(1, 1, "b", "filed", "x"), (2, 2, "n", "withdrawn", None), (3, 2, "n2", "listed", None)], "seq long, k long, name string, status string, sector string")
    rules = {"name": upsert.LAST, "status": upsert.ladder(["filed", "priced", "listed"], ["withdrawn"]), "sector": upsert.LAST_KNOWN}
    once = upsert.merge_snapshot(base, upd, ["k"], rules, "seq")
    twice = upsert.merge_snapshot(once, upd, ["k"], rules, "seq")
    want = [(1, "b", "priced", "x"), (2, "n2", "withdrawn", None)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_hits(spark):
    js = ['{"objectID":"1","story_title":"Parent","comment_text":"%s","author":"A","points":120,"num_comments":45,"created_at_i":1700000000}' % ("w" * 900), '{"objectID":"","created_at_i":1}', '{"objectID":"3"}', "broken"]
    m = landed.parse_hits(spark.createDataFrame([(x,) for x in js], "value string"), "s").collect()
    assert len(m) == 1 and m[0].engagement_score == 165 and len(m[0].body_excerpt) == 500 and m[0].title == "Parent" and m[0].url.endswith("id=1")


def test_index_and_csv_keep_ids_as_text(spark, tmp_path):
    (tmp_path / "i.idx").write_text("Form Type   Company\n---------\nS-1         Acme Corp           320193    20240102    edgar/data/320193/0000320193-24-000001.txt\n10-K        Other Inc           1    2024-01-02  edgar/data/1/x.txt\n")
    r = landed.read_index(spark, str(tmp_path / "i.idx")).collect()
    assert len(r) == 1 and r[0].cik == "0000320193" and r[0].accession == "0000320193-24-000001"
    (tmp_path / "w.csv").write_text("cik,name\n0000001234,Acme\n")
    assert landed.read_csv(spark, str(tmp_path / "w.csv"), "cik string, name string").first().cik == "0000001234"


def test_calendar_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"from":"2024-01-01","to":"2024-01-31","fetched_at":"t","ipoCalendar":[{"date":"2024-01-05","exchange":" NYSE ","name":"Acme","numberOfShares":5,"price":"4-6","status":"Priced","symbol":"acm","totalSharesValue":1.0}]}')
    r = landed.read_calendar(spark, str(tmp_path / "c.json")).first()
    assert (r.symbol, r.status, r.exchange, r.price.low, r.source_file) == ("ACM", "priced", "NYSE", 4.0, "c.json")


def test_guards(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "k int, v int")
    with pytest.raises(ValueError, match="lacks x"):
        relations.require_columns(df, "k", "x")
    with pytest.raises(ValueError, match="isn't unique"):
        relations.assert_unique(df, ["k"])
    assert expectations.repeated(df, ["k"]).count() == 1


def test_dates(spark):
    df = spark.createDataFrame([("Wed Oct 10 20:19:24 +0000 2018",), ("bad",), (None,)], "s string")
    got = [r[0] for r in df.select(dates.parse_created_at(F.col("s"))).collect()]
    assert got[0] == datetime.datetime(2018, 10, 10, 20, 19, 24) and got[1:] == [None, None]
    w = ts.calendar_windows(spark.createDataFrame([(day("2023-12-15"), day("2024-02-29"))], "a date, b date"), "a", "b").orderBy("month_start").collect()
    assert [(str(r.month_start), str(r.month_end)) for r in w] == [("2023-12-15", "2023-12-31"), ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29")]


def test_markup_and_windows(spark):
    df = spark.createDataFrame([("#REDIRECT [[Acme]]",), ("{{Infobox|a={{b|c}}}} '''Acme''' is a [[company|firm]].<ref>x y</ref>",)], "t string")
    r = df.select(text.is_redirect(F.col("t")), text.markup_words(F.col("t"))).collect()
    assert r[0][0] and not r[1][0] and r[1][1] == 4


def test_page_has_more(spark):
    df = spark.createDataFrame([(i, day("2024-01-01") if i % 2 else None) for i in range(10)], "id long, d date")
    p = paging.keyset_page(df, "d", "id", 3).collect()
    assert [r.id for r in p] == [9, 7, 5] and all(r.has_more for r in p)
    q = paging.keyset_page(df, "d", "id", 9, (day("2024-01-01"), 5)).collect()
    assert [r.id for r in q] == [3, 1, 8, 6, 4, 2, 0] and not q[0].has_more


def test_kth_value(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 10_007).alias("v"))
    want = sorted(i * 7919 % 10_007 for i in range(20_000))
    for k in (0, 1, 5000, 10_000, 19_999):
        assert aggregates.kth_value(df, "v", k, gather=50) == want[k]
