"""The driver's tables as the domain's tables: mentions, price bars, listings, filings, census.

Each property is a DataFrame; the SQL of the same name in SQL is its DuckDB form, for use in oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What form and what exchange a code of the tables stands for.
FORMS = {"1-URGENT": "S-1", "2-HIGH": "S-1/A", "3-MEDIUM": "424B4", "4-NOT SPECIFIED": "DRS", "5-LOW": "8-A12B"}
EXCHANGES = {"AUTOMOBILE": "NASDAQ Global", "BUILDING": "NYSE", "FURNITURE": "NYSE American", "HOUSEHOLD": "Nasdaq Capital", "MACHINERY": "OTC"}


def _case(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # The files hold local timestamps; the engine works in UTC.
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.read(name)
        self.__dict__[name] = df
        return df

    @cached_property
    def mentions(self) -> DataFrame:
        return self.events.where(F.col("event_type").isin("view", "click", "error")).select(
            F.col("event_id").alias("mention_id"), F.col("user_id").alias("issuer_id"), F.col("ts").alias("posted_at"), F.col("event_type").alias("source"),
            F.col("value").alias("engagement"), (F.col("event_type") == "error").alias("needs_review"), "props",
        )

    @cached_property
    def bars(self) -> DataFrame:
        order = F.struct("ts", "event_id")
        return self.events.groupBy(F.col("user_id").alias("issuer_id"), F.to_date("ts").alias("day")).agg(
            F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume")
        )

    @cached_property
    def listings(self) -> DataFrame:
        order = F.struct("ts", "event_id")
        return self.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("issuer_id")).agg(F.to_date(F.min("ts")).alias("listed_on"), F.min_by("value", order).alias("open_price"))

    @cached_property
    def filings(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("issuer_id"), F.expr(_case("o_orderpriority", FORMS)).alias("form"), F.to_date("o_orderdate").alias("filed_on"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
        )

    @cached_property
    def census(self) -> DataFrame:
        c = self.customer.select("c_custkey", "c_name", F.expr(_case("c_mktsegment", EXCHANGES)).alias("exchange"), "c_nationkey")
        return self.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("issuer_id"), F.col("c_name").alias("name"), "exchange", F.to_date("o_orderdate").alias("day"),
            F.expr("case o_orderstatus when 'F' then 'priced' when 'O' then 'filed' else 'withdrawn' end").alias("status"), (F.col("o_totalprice") * 1000).alias("deal_size"), F.col("o_orderpriority").alias("rank_code"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        p = self.part.select("p_partkey", "p_retailprice", "p_size", "p_brand", "p_type")
        return self.lineitem.where("l_quantity > 0").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("offer"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), (F.col("p_size") % 3 == 0).cast("int").alias("treated"), F.to_date("l_shipdate").alias("day"), F.col("p_size").alias("size_code"), F.col("l_discount").alias("discount"),
        )

    @cached_property
    def monthly(self) -> DataFrame:
        """Views of an issuer a month, whole numbers."""
        return self.orders.groupBy(F.col("o_custkey").alias("issuer_id"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("views"))


# The same as DuckDB SQL.
MENTIONS = "mentions as (select event_id mention_id, user_id issuer_id, ts posted_at, event_type source, value engagement, event_type = 'error' needs_review, props from events where event_type in ('view', 'click', 'error'))"
BARS = "bars as (select user_id issuer_id, ts::date as day, arg_min(value, (ts, event_id)) as open, arg_max(value, (ts, event_id)) as close, max(value) high, min(value) low, count(*) volume from events group by 1, 2)"
LISTINGS = "listings as (select user_id issuer_id, min(ts)::date listed_on, arg_min(value, (ts, event_id)) open_price from events where event_type = 'signup' group by 1)"
FILINGS = f"filings as (select o_orderkey filing_id, o_custkey issuer_id, {_case('o_orderpriority', FORMS)} form, o_orderdate::date filed_on, o_orderstatus status, o_totalprice amount from orders)"
CENSUS = f"census as (select o_orderkey row_id, o_custkey issuer_id, c_name as name, {_case('c_mktsegment', EXCHANGES)} exchange, o_orderdate::date as day, case o_orderstatus when 'F' then 'priced' when 'O' then 'filed' else 'withdrawn' end status, o_totalprice * 1000 deal_size, o_orderpriority rank_code from orders join customer on o_custkey = c_custkey)"
OUTCOMES = "outcomes as (select l_orderkey order_id, l_linenumber line, p_partkey entity_id, p_brand brand, p_type kind, p_retailprice offer, l_extendedprice / l_quantity as close, (p_size % 3 = 0)::int treated, l_shipdate::date as day, p_size size_code, l_discount discount from lineitem join part on l_partkey = p_partkey where l_quantity > 0)"
MONTHLY = "monthly as (select o_custkey issuer_id, date_trunc('month', o_orderdate)::date as month, sum(floor(o_totalprice))::bigint views from orders group by 1, 2)"
