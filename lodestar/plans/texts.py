"""Text: normalising, aliases, candidates and scores, document frequencies, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as agg, extract, match
from .bindings import Tables
from .entities import SUFFIX_SQL
from .registry import query

_NT = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '&[a-z0-9#]+;', ' ', 'g'), '[^a-z0-9$ ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("normalize_text", f"select page_id, md5({_NT.format(c='html')}) digest, length({_NT.format(c='html')}) n from pages")
def normalize_text(t: Tables):
    n = tx.normalize_text(F.col("html"))
    return t.pages.select("page_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


# Aliases: the first one to three tokens of the benchmark items.
_TOKS = f"string_split({_NT.format(c='text')}, ' ')"
_ALIAS = f"a as (select distinct item_id issuer_id, array_to_string(({_TOKS})[1:k], ' ') alias, case k when 1 then 'brand' when 2 then 'legal' else 'informal' end kind from benchmark, (values (1), (2), (3)) v(k) where len({_TOKS}) >= k)"
_GRAMS = f"d as (select doc_id, {_TOKS} w from documents), g as (select distinct doc_id, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w))) i from d), (values (1), (2), (3)) v(k) where i + k - 1 <= len(w))"


def _aliases(t: Tables):
    w = F.split(tx.normalize_text(F.col("text")), " ")
    each = t.benchmark.select("item_id", w.alias("w"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).where("size(w) >= k")
    return each.select(F.col("item_id").alias("issuer_id"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("alias"), F.when(F.col("k") == 1, "brand").when(F.col("k") == 2, "legal").otherwise("informal").alias("kind")).distinct()


@query("ngram_candidates", f"with {_ALIAS}, {_GRAMS} select doc_id, issuer_id, kind from g join a on g.g = a.alias")
def ngram_candidates(t: Tables):
    return match.candidates(t.documents, _aliases(t), "doc_id", F.col("text")).select("doc_id", "issuer_id", "kind")


_COMMON = f"common as (select token from (select unnest(list_distinct({_TOKS})) token from documents) where token <> '' group by 1 having count(*) >= (select count(*) from documents) * 0.05)"


def _common(t: Tables):
    n = t.documents.count()
    return agg.document_frequency(t.documents, "doc_id", F.split(tx.normalize_text(F.col("text")), " "), max(1, -(-n * 5 // 100)))


@query("common_words", f"select token, count(*) n_docs from (select unnest(list_distinct({_TOKS})) token from documents) where token <> '' group by 1 having count(*) >= (select count(*) from documents) * 0.05")
def common_words(t: Tables):
    return _common(t)


_SCORE = f"""with {_ALIAS}, {_GRAMS}, {_COMMON},
f as (select alias, count(*) n, count(token) nc, count(*) filter (where token is null and length(w) >= 4) nd from (select distinct alias, unnest(string_split(alias, ' ')) w, unnest(range(len(string_split(alias, ' ')))) i from a) left join common on w = token group by 1),
c as (select g.doc_id, a.*, f.* exclude (alias), {_NT.format(c="split_part(text, chr(10), 1)")} ttl, {_NT.format(c="text")} body from g join a on g.g = a.alias join f on f.alias = a.alias join documents d on d.doc_id = g.doc_id),
s as (select doc_id, issuer_id, alias, kind, (case kind when 'legal' then 0.70::double when 'informal' then 0.55::double else 0.40::double end) + (case when n > 1 then 0.08::double * (n - 1) else 0 end)
 + (case when nd = 0 then -(0.40::double + 0.08::double * (n - 1)) when nc > 0 then -0.15::double * nc else 0 end) + (case when n = 1 and length(alias) <= 3 then -0.25::double when n = 1 and kind = 'brand' then -0.20::double else 0 end)
 + (case when regexp_matches(' ' || ttl || ' ' || body || ' ', '[^a-z0-9](ipo|s 1|f 1|424b4|prospectus|nasdaq|nyse|ticker|shares?|stock|listing|lists|going public|valuation|underwrit[a-z]*|filing|filed|offering|pre ipo|market cap|sec)[^a-z0-9]') then 0.20::double else 0 end)
 + (case when contains(' ' || replace(ttl, '$', ' ') || ' ', ' ' || ltrim(alias, '$') || ' ') then 0.08::double else 0 end) raw from c)
select doc_id, issuer_id, alias, kind, round(greatest(0, least(1, raw)), 6) confidence, case when raw >= 0.70::double then 'accept' when raw >= 0.45::double then 'review' else 'drop' end band from s"""


def _scored(t: Tables):
    c = match.candidates(t.documents, _aliases(t), "doc_id", F.col("text"))
    return match.score(c, _common(t), match.context(t.documents, "doc_id", F.substring_index("text", "\n", 1), F.col("text")), "doc_id")


@query("score_mentions", _SCORE)
def score_mentions(t: Tables):
    return _scored(t).select("doc_id", "issuer_id", "alias", "kind", F.round("confidence", 6).alias("confidence"), "band")


@query("best_mention", f"select doc_id, issuer_id, alias, confidence from ({_SCORE}) where band <> 'drop' qualify row_number() over (partition by doc_id order by confidence desc, issuer_id, alias) = 1")
def best_mention(t: Tables):
    s = _scored(t).withColumn("confidence", F.round("confidence", 6))
    return match.best(s, "doc_id", ["issuer_id", "alias"]).select("doc_id", "issuer_id", "alias", "confidence")


_NM = "p_name || case p_partkey % 4 when 0 then ', Inc.' when 1 then ' Group' else '' end"


@query("generate_aliases", f"""
with i as (select p_partkey issuer_id, {_NM} n, 'T' || p_partkey tick from part), k as (select *, {_NT.format(c='n')} f, trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(n), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')), '^(.+?)(?: (?:{SUFFIX_SQL}))+$', '\\1')) c from i)
select distinct * from (select issuer_id, c alias, 'legal' kind from k union all select issuer_id, split_part(c, ' ', 1), 'brand' from k where split_part(c, ' ', 1) <> c and length(split_part(c, ' ', 1)) >= 4 and split_part(c, ' ', 1) not in ('green') union all select issuer_id, '$' || lower(tick), 'cashtag' from k)""")
def generate_aliases(t: Tables):
    i = t.part.select(F.col("p_partkey").alias("issuer_id"), F.expr(_NM).alias("legal_name"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"))
    common = t.part.where("p_name like 'green%'").select(F.substring_index("p_name", " ", 1).alias("token"))
    return match.generate_aliases(i, common)


@query("author_hash", "select event_id, case when event_id % 9 <> 0 then sha256(unhex(repeat('5c', 64)) || unhex(sha256(unhex(repeat('36', 64)) || ('user ' || user_id)::blob))) end author_hash from events")
def author_hash(t: Tables):
    handle = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("  USER "), F.col("user_id").cast("string"), F.lit(" ")))
    return t.events.select("event_id", tx.author_hash(handle, "").alias("author_hash"))


@query("html_to_text")
def html_to_text(t: Tables):
    s = tx.html_to_text(F.col("html"))
    return t.pages.select("page_id", s.alias("text"), F.length(s).alias("n_chars"))


@query("anchor_window", """
with h as (select doc_id, text, instr(lower(text), 'that') a, instr(lower(text), ' les ') b from documents)
select doc_id, md5(case when b > 0 then substring(text, greatest(1, b - 50), 200) when a > 0 then substring(text, greatest(1, a - 50), 200) end) digest from h""")
def anchor_window(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.anchor_window(F.col("text"), {"that": 3, " les ": 5}, 200)).alias("digest"))


@query("markup_word_count", """select page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?m)^=+.*=+\\s*$|https?://\\S+|<[^>]*>', ' ', 'g'), '\\{\\{[^{}]*\\}\\}', ' ', 'g'), '[A-Za-z][A-Za-z''-]*')) words, false redirect from pages""")
def markup_word_count(t: Tables):
    return t.pages.select("page_id", tx.markup_words(F.col("html")).cast("long").alias("words"), tx.is_redirect(F.col("html")).alias("redirect"))


@query("stem_alignment", """
with w as (select p_partkey, list_distinct(list_transform(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) >= 4), lambda x: x[1:6])) s, lower(p_type || ' economical redwood') b from part)
select p_partkey, round(len(list_filter(s, lambda x: contains(b, x))) / len(s), 6) share from w""")
def stem_alignment(t: Tables):
    return t.part.select("p_partkey", F.round(tx.stem_alignment(F.concat("p_name", F.lit(" "), "p_type"), F.concat("p_type", F.lit(" economical redwood"))), 6).alias("share"))


@query("defunct_before", "select o_orderkey, o_orderkey % 2 = 0 and year(o_orderdate) < 1998 - 1 defunct from orders")
def defunct_before(t: Tables):
    note = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "The firm was dissolved in ").otherwise("The firm was renamed in "), F.year("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", tx.defunct_before(note, F.lit(1998)).alias("defunct"))


@query("extract_terms", """
select page_id, case when k > 0 then k end::decimal(12,4) low, case when k > 0 then k + 2 end::decimal(12,4) high, case when k = 0 then 2 end::decimal(12,4) final, 'disclosed' disclosure,
  case when k > 0 then 'range_between' else 'single_per_share' end method, case when k > 0 then 0.9 else 0.7 end::decimal(3,2) confidence from (select page_id, page_id % 40 k from pages)""")
def extract_terms(t: Tables):
    body = tx.html_to_text(F.col("html"))
    offer = F.concat(F.lit("The initial public offering price is expected to be between $"), (F.col("page_id") % 40).cast("string"), F.lit(" and $"), (F.col("page_id") % 40 + 2).cast("string"), F.lit(" per share.\n"))
    p = t.pages.select("page_id", F.concat(offer, body).alias("text"))
    return p.select("page_id", extract.price_terms(F.col("text"), extract.cover("text")).alias("x")).select("page_id", "x.*")


@query("dictionary_extract", """
with p as (select page_id, page_id % 3 h, unnest([page_id % 7, page_id % 11, 1]) k, unnest(['cell', 'cell', 'end']) kind from pages),
b as (select page_id, coalesce(s_name, (select s_name from supplier where regexp_replace(s_name, '#0*', ' ') = 'Supplier ')) bank, case when kind = 'cell' and h = 0 then 'lead' when kind = 'cell' and h = 1 then 'co_manager' end "role", case kind when 'cell' then 0.9 else 0.6 end::double confidence
  from p left join supplier on regexp_replace(s_name, '#0*', ' ') = 'Supplier ' || k)
select page_id, bank, arg_max("role", confidence) "role", max(confidence) confidence from (select page_id, bank, max("role") "role", confidence from b group by all) group by 1, 2""")
def dictionary_extract(t: Tables):
    banks = t.supplier.select(F.col("s_name").alias("bank"), F.regexp_replace("s_name", "#0*", " ").alias("surface"))
    header = F.element_at(F.array(*[F.lit(x) for x in ("Joint book-running managers", "Co-managers", "Underwriters")]), (F.col("page_id") % 3 + 1).cast("int"))
    cell = lambda n: F.concat(F.lit("<td>Supplier "), (F.col("page_id") % n).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<p>"), header, F.lit("</p><table><tr>"), cell(7), cell(11), F.lit("</tr></table>"))
    end = F.concat(F.lit("<p>"), F.repeat(F.lit("We sell shares. "), F.lit(30)), F.lit("</p><p>Supplier 1</p><p>The date of this prospectus is today</p>"))
    return extract.syndicate(t.pages.select("page_id", tx.html_to_text(F.concat(row, end, "html")).alias("text")), banks, "page_id", "text")
