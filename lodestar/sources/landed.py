"""Readers of landed files: index lines, JSON payloads, CSV, lookups; and sinks.

A reader is a function of a path (Spark reads it) on top of a parser of a DataFrame, so payloads that
already are rows of a table take the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relations import require_columns

# Forms that are followed.
TRACKED = ("S-1", "S-1/A", "F-1", "F-1/A", "DRS", "DRS/A", "424B4", "424B1", "8-A12B", "8-A12G", "RW", "D", "D/A")
_LINE = r"^(\S+(?: \S+)?)\s{2,}(.+?)\s{2,}(\d{1,10})\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"


def parse_index(lines: DataFrame, forms: Sequence[str] = TRACKED, value: str = "value") -> DataFrame:
    """Fixed-width index lines -> form, company, cik (ten digits), filed_at (midnight UTC), accession, path; others are skipped."""
    part = lambda i: F.regexp_extract(value, _LINE, i)
    rows = lines.where(F.col(value).rlike(_LINE)).select(part(1).alias("form"), part(2).alias("company"), F.lpad(part(3), 10, "0").alias("cik"), F.regexp_replace(part(4), "-", "").alias("_d"), part(5).alias("path"))
    rows = rows.where(F.col("form").isin(*forms)).withColumn("filed_at", F.try_to_timestamp("_d", F.lit("yyyyMMdd"))).where("filed_at is not null")
    return rows.withColumn("accession", F.regexp_replace(F.substring_index("path", "/", -1), r"\.txt$", "")).drop("_d")


def read_index(spark: SparkSession, path: str, forms: Sequence[str] = TRACKED) -> DataFrame:
    return parse_index(spark.read.text(path), forms)


SUBMISSION = "name string, sicDescription string, tickers array<string>, exchanges array<string>, filings struct<recent: struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>>"


def first_known(values: Column) -> Column:
    """The first element that is neither null nor empty."""
    return F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), 0)


def parse_submissions(payloads: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON profiles with parallel arrays -> profiles, and one row a filing; longer arrays are cut to the shortest."""
    p = payloads.withColumn("_j", F.from_json(column, SUBMISSION)).where("_j is not null")
    keep = [c for c in payloads.columns if c != column]
    profile = p.select(*keep, F.col("_j.name").alias("name"), F.nullif("_j.sicDescription", F.lit("")).alias("sector"), first_known(F.col("_j.tickers")).alias("ticker"), first_known(F.col("_j.exchanges")).alias("exchange"))
    r = "_j.filings.recent."
    names = ("form", "filingDate", "accessionNumber", "primaryDocument")
    n = F.least(*[F.size(r + c) for c in names])
    each = p.select(*keep, F.posexplode(F.arrays_zip(*[F.col(r + c).alias(c) for c in names])).alias("pos", "f"), n.alias("n")).where("pos < n")
    filings = each.select(*keep, "pos", F.col("f.form").alias("form"), F.to_date("f.filingDate").alias("filed_on"), F.col("f.accessionNumber").alias("accession"), F.col("f.primaryDocument").alias("document"))
    return profile, filings


HIT = "objectID string, title string, story_title string, comment_text string, story_text string, author string, points int, num_comments int, url string, created_at_i bigint"


def parse_hits(payloads: DataFrame, salt: str, column: str = "value", excerpt: int = 500) -> DataFrame:
    """Story and comment hits -> mentions; rows without id or time are dropped. Handles are kept only as keyed hashes."""
    from ..functions.text import author_hash

    j = payloads.select(F.from_json(column, HIT).alias("j")).select("j.*").where("objectID is not null and objectID <> '' and created_at_i is not null")
    return j.select(
        F.lit("hackernews").alias("source"), F.col("objectID").alias("source_uid"), author_hash(F.col("author"), salt).alias("author_hash"), F.coalesce("title", "story_title").alias("title"),
        F.substring(F.coalesce("comment_text", "story_text"), 1, excerpt).alias("body_excerpt"), F.coalesce("url", F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID")).alias("url"),
        (F.coalesce("points", F.lit(0)) + F.coalesce("num_comments", F.lit(0))).alias("engagement_score"), F.timestamp_seconds("created_at_i").alias("posted_at"),
    )


POST = "id string, created_utc double, author string, subreddit string, title string, selftext string, permalink string, score int, num_comments int"


def parse_posts(payloads: DataFrame, salt: str, since: Column | None = None, until: Column | None = None, column: str = "value", excerpt: int = 500) -> DataFrame:
    """Forum posts -> mentions within [since, until]."""
    from ..functions.text import author_hash

    j = payloads.select(F.from_json(column, POST).alias("j")).select("j.*").where("id is not null and created_utc is not null")
    m = j.select(
        F.lit("reddit").alias("source"), F.col("id").alias("source_uid"), author_hash(F.col("author"), salt).alias("author_hash"), F.col("subreddit").alias("channel"), "title", F.substring("selftext", 1, excerpt).alias("body_excerpt"),
        F.concat(F.lit("https://www.reddit.com"), "permalink").alias("url"), (F.coalesce("score", F.lit(0)) + F.coalesce("num_comments", F.lit(0))).alias("engagement_score"), F.timestamp_seconds("created_utc").alias("posted_at"),
    )
    if since is not None:
        m = m.where(F.col("posted_at") >= since)
    return m.where(F.col("posted_at") <= until) if until is not None else m


BARS = "results array<struct<t: bigint, o: string, h: string, l: string, c: string, v: string>>"


def parse_bars(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Arrays of bars with epoch milliseconds -> typed daily bars, UTC; malformed ones are skipped."""
    keep = [c for c in payloads.columns if c != column]
    b = payloads.select(*keep, F.explode(F.from_json(column, BARS)["results"]).alias("b"))
    money = {n: F.col(f"b.{k}").try_cast("decimal(12,4)") for n, k in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))}
    out = b.select(*keep, F.to_date(F.timestamp_millis("b.t")).alias("day"), *[v.alias(n) for n, v in money.items()], F.col("b.v").try_cast("double").cast("bigint").alias("volume"))
    return out.dropna(subset=["day", *money])


CALENDAR = "`from` string, `to` string, fetched_at string, ipoCalendar array<struct<date: string, exchange: string, name: string, numberOfShares: bigint, price: string, status: string, symbol: string, totalSharesValue: double>>"


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar windows, a file each -> rows with their file and fetch time, texts trimmed, empty ones null."""
    from ..operators.cohort import clean_price

    f = spark.read.schema(CALENDAR).json(path, multiLine=True).select("fetched_at", F.col("_metadata.file_name").alias("source_file"), F.explode("ipoCalendar").alias("r"))
    text = lambda c: F.nullif(F.trim(f"r.{c}"), F.lit(""))
    return f.select(F.to_date("r.date").alias("day"), text("name").alias("name"), F.upper(text("symbol")).alias("symbol"), text("exchange").alias("exchange"), F.lower(text("status")).alias("status"), F.col("r.numberOfShares").alias("shares"), F.col("r.totalSharesValue").alias("deal_size"), clean_price(F.col("r.price")).alias("price"), "source_file", "fetched_at")


def read_payloads(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Landed JSON files, one payload each, in any depth of folders -> (file, key, folder, j) and a ledger (file, drop_reason).

    ``key`` is the file's name without its ending and ``folder`` that of its folder; in a table partitioned by company and month, these.
    A file that isn't whole JSON of the schema goes to the ledger.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    j = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    part = lambda i: F.element_at(F.split("file", "/"), i)
    stated = lambda name: F.nullif(F.regexp_extract("file", f"/{name}=([^/]*)/", 1), F.lit(""))
    # A path is encoded once by the file system and partition values once more.
    plain = lambda c: F.url_decode(F.url_decode(c))
    key, parent = F.coalesce(stated("month"), F.regexp_replace(part(-1), r"\.[^.]*$", "")), F.coalesce(stated("company"), part(-2))
    rows = raw.select("file", plain(key).alias("key"), plain(parent).alias("folder"), j.alias("j"))
    broken = F.col("j").isNull() | F.col("j._corrupt").isNotNull()
    return rows.where(~broken), rows.where(broken).select("file", F.lit("broken_json").alias("drop_reason"))


def _split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and (file, drop_reason) of the others."""
    marked = rows.withColumn("drop_reason", reason)
    return marked.where("drop_reason is null").drop("drop_reason"), marked.where("drop_reason is not null").select("file", "drop_reason")


MONTH = "company string, query string, month string, hits int, fetched_at string, docs array<string>"


def read_months(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Article payloads in <company>/<month>.json -> company, month, query, hits (null if not known), n_docs, fetched_at; and the ledger.

    Company and month come from the path where the payload lacks them; a file whose month is no month goes to the ledger.
    """
    good, broken = read_payloads(spark, path, MONTH)
    month = F.try_to_timestamp(F.coalesce("j.month", "key"), F.lit("yyyy-MM")).cast("date")
    rows = good.select("file", F.coalesce("j.company", "folder").alias("company"), month.alias("month"), F.col("j.query").alias("query"), F.col("j.hits").alias("hits"), F.coalesce(F.size("j.docs"), F.lit(0)).alias("n_docs"), F.col("j.fetched_at").alias("fetched_at"))
    rows, odd = _split(rows, F.when(F.col("month").isNull(), "no_month"))
    return rows.drop("file"), broken.union(odd)


VIEWS = "company string, cohort string, resolution struct<title: string, method: string>, article_created string, views_by_title map<string, bigint>, title_history_inherited boolean, items array<struct<timestamp: string, views: bigint>>"


def read_pageviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Page-view payloads -> months, titles and the ledger.

    Months: company, cohort, title, month, views, created, article_existed (the article was there in that month; a month before it isn't the
    company's), creation_month, inherited (some months are those of a previous holder of the title). Titles: company, title, views of each contributing title.
    """
    good, broken = read_payloads(spark, path, VIEWS)
    created = F.try_to_timestamp(F.substring("j.article_created", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    base = good.select("file", F.coalesce("j.company", "key").alias("company"), F.col("j.cohort").alias("cohort"), F.col("j.resolution.title").alias("title"), created.alias("created"), F.coalesce("j.title_history_inherited", F.lit(False)).alias("inherited"), F.col("j.items").alias("items"), F.col("j.views_by_title").alias("by_title"))
    each = base.select("*", F.inline("items")).withColumn("month", F.try_to_timestamp(F.substring("timestamp", 1, 6), F.lit("yyyyMM")).cast("date"))
    each, odd = _split(each, F.when(F.col("month").isNull(), "no_month"))
    existed = F.coalesce(F.col("month") >= F.trunc("created", "MM"), F.lit(False))
    months = each.select("company", "cohort", "title", "month", F.coalesce("views", F.lit(0)).alias("views"), "created", existed.alias("article_existed"), F.coalesce(F.col("month") == F.trunc("created", "MM"), F.lit(False)).alias("creation_month"), "inherited")
    titles = base.select("company", F.explode("by_title").alias("title", "views")).groupBy("company", "title").agg(F.sum("views").alias("views"))
    return months, titles, broken.union(odd)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a stated schema; ids stay text with their zeros."""
    return spark.read.schema(schema).csv(path, header=True)


def parse_lookup(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines ``name:digits:`` -> name and ten-digit id; names with colons keep them, the smallest id wins a tie."""
    r = r"^(.*):(\d+):$"
    rows = lines.where(F.col(value).rlike(r)).select(F.trim(F.regexp_extract(value, r, 1)).alias("name"), F.lpad(F.regexp_extract(value, r, 2), 10, "0").alias("cik"))
    return rows.groupBy("name").agg(F.min("cik").alias("cik"))


def read_frame(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet frame that must have the columns."""
    return require_columns(spark.read.parquet(path), *columns)


def write_counted(df: DataFrame, path: str, counts: dict[str, Column]) -> dict:
    """Write df and return the aggregates named in ``counts``, taken on the way: no second scan."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.parquet(path)
    return seen.get


def write_queue(df: DataFrame, path: str, order: Sequence, limit: int | None = None) -> None:
    """An ordered CSV: the first ``limit`` rows as one file for people; without a limit all rows, in files that sort by name."""
    ordered = df.orderBy(*order)
    (ordered if limit is None else ordered.limit(limit).coalesce(1)).write.mode("overwrite").csv(path, header=True)
