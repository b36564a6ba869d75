"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, fingerprint, lang_id, lexical, mixing, ngram_join, prefix_trie, quality, secret_scan, shard, token_count, url_filter
from .common import read

# Host, path and verdict of the URL rules.
URL_RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_overlaps(docs, read(spark, sf_dir, "benchmark")).drop("text")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shard.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def language_model(spark: SparkSession, sf_dir: str) -> lang_id.Model:
    """Learned from the documents that are not held out."""
    return lang_id.fit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(_remainder(4) != 2))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = lang_id.identify(docs, language_model(spark, sf_dir))
    return got.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(_remainder(5) != 0)
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.graft(prefix_trie.sequences(read(spark, sf_dir, "conversations"))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(read(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_mixing, op2_decontamination, op3_sharding, op4_url_filter, op5_embed_dedup, op6_token_count, op7_ngram_join, op8_language_id, op9_secret_scan, op10_quality, op11_prefix_trie, op12_lexical_search, op13_fingerprints)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '/{p}', '{h}/{p}', '{v}')" for h, p, v in URL_RULES)
    op4 = f"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path
  from pages),
r(h, p, rule, verdict) as (values {rules}),
f as (
  select page_id, host, path, r.rule, r.verdict, row_number() over (partition by page_id order by length(h) desc nulls last, length(p) desc nulls last) k
  from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from f where k = 1"""
    op5 = """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
c(a, b) as (select vec_id, vec_id from v union select c.a, l.b from c join l on c.b = l.a)
select vec_id, (select count(*) from l where l.a = v.vec_id) n_links, m.component_id, vec_id = m.component_id kept
from v join (select a, min(b) component_id from c group by a) m on m.a = v.vec_id"""
    # CRC-32 of the id's digits, bit by bit.
    crc = "(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda r, x: list_reduce(list_prepend(xor(r, x), range(8)), lambda s, i: if(s & 1 = 1, xor(s >> 1, 3988292384), s >> 1))), 4294967295))"
    op11 = f"""
with t as (
  select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) p
  from conversations where conv_id is not null),
k as (select c, {crc} % 9 h from (select distinct c from t)),
b as (
  select k.c, t.p, t.r, t.x from k join t on t.c = k.c - k.c % 5 and t.p <= h
  union all select k.c, t.p + least(h, (select count(*) from t s where s.c = k.c - k.c % 5)) - h, t.r, t.x from k join t on t.c = k.c and t.p > h),
s as (select k.c, coalesce(list({{'r': r, 'x': x}} order by p) filter (where p is not null), []) v from k left join b on b.c = k.c group by k.c),
m as (select c, v, unnest(range(len(v) + 1)) d from s),
n as (select d, v[1:d] f, min(c) conv_id, count(*) n_convs, list(c order by c) filter (where len(v) = d) e from m group by d, v[1:d]),
j as (select a.d, a.f, b.d bd, b.f bf, b.n_convs from n a join n b on b.d >= a.d and b.f[1:a.d] = a.f),
w as (
  select d, f, count(*) filter (where bd = d + 1) n_children, sum(case when bd = 0 then 0 else (n_convs - 1) * octet_length(encode(bf[bd].x)) end)::bigint saved_tokens,
         count(*) filter (where not exists (select 1 from n z where z.d = bd + 1 and z.f[1:bd] = bf)) n_leaves
  from j group by d, f)
select n.conv_id, n.d depth, p.conv_id parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(array_to_string(n.e::varchar[], ','), '')) ends_sha256
from n join w on w.d = n.d and w.f = n.f left join n p on p.d = n.d - 1 and p.f = n.f[1:n.d - 1]"""
    term = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    op12 = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all({low.format('text')}, {term}) t from documents where text is not null),
g as (select count(*) n, sum(len(t))::bigint l from d where len(t) > 0),
m as (select r, doc_id, 50 + (50 * len(t) * n) // l m from d, g where len(t) > 0),
i as (select row_number() over () i, item_id, unnest(list_distinct(regexp_extract_all({low.format('text')}, {term}))) t from benchmark where text is not null),
x as (select r, t, count(*) tf from (select r, unnest(t) t from d) where t in (select t from i) group by r, t),
w as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)))::bigint w from x, g group by t, n),
s as (
  select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score
  from i join x using (t) join w using (t) join m using (r) group by i, item_id, r, doc_id)
select item_id, k::int "rank", doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last) k from s where score > 0) where k <= 50"""
    return {"op4_url_filter": op4, "op5_embed_dedup": op5, "op11_prefix_trie": op11, "op12_lexical_search": op12}
