"""Predicates and classes over entities: cohorts, verdicts, screens and bins, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(*rules: tuple[str, Column], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds; null conditions don't hold."""
    c = F
    for label, condition in rules:
        c = c.when(condition, F.lit(label))
    return c.otherwise(F.lit(otherwise)) if otherwise is not None else c


def classify_cohort(sector: Column, name: Column, prior_reports: Column) -> Column:
    """re_listing, etf_or_trust, spac or operating, in that order."""
    return first_reason(
        ("re_listing", prior_reports > 0), ("etf_or_trust", sector.rlike("(?i)exchange.traded|commodity") | name.rlike(r"(?i)\b(ETF|Trust|Fund)\b")),
        ("spac", sector.rlike("(?i)blank check")), otherwise="operating",
    )


def pending_status(ticker: Column, filed: Column, today: Column, days: int = 30) -> Column:
    """Of an event without a trade: awaiting, or registered_no_trade when old and with a ticker."""
    return F.when(ticker.isNotNull() & (F.datediff(today, filed) > days), "registered_no_trade").otherwise("awaiting")


def promote(events: DataFrame, bars: DataFrame, entity: str, filed: str, today: Column, within: int = 15) -> DataFrame:
    """Status of listing events by their first bar: listed within the days, else no_price_data or pending."""
    first = bars.groupBy(F.col(entity).alias("_e")).agg(F.min("day").alias("_d"), F.min_by("open", "day").alias("_o"))
    j = events.join(first, F.col(entity) == F.col("_e"), "left")
    near = F.datediff("_d", filed).between(0, within)
    status = F.when(F.col("_d").isNull(), pending_status(F.lit("x"), F.col(filed), today)).when(near, "listed").otherwise("no_price_data")
    return j.select(*events.columns, status.alias("listing_status"), F.when(near, F.col("_d")).alias("first_day"), F.when(near, F.col("_o")).alias("first_open"))


def spac_by_ticker(ticker: Column, name: Column) -> Column:
    """Unit tickers (U at the end of four letters, or .U) and names of acquisition companies."""
    return F.coalesce((ticker.endswith("U") & (F.length(ticker) >= 4)) | ticker.contains(".U") | F.upper(name).rlike("ACQUISITION|BLANK CHECK|ACQ CORP"), F.lit(False))


def spac_rule(name: Column, symbol: Column) -> Column:
    """Which rule says SPAC: name, unit_suffix or unit_class; null if none."""
    s = F.upper(symbol)
    return first_reason(("name", F.lower(name).contains("acquisition")), ("unit_suffix", s.rlike("^[A-Z]{3,4}U$")), ("unit_class", s.rlike("^[A-Z]{2,4}[-.]U$")))


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins (e0, e1], (e1, e2], ..., the last open above; null at or below the first edge."""
    c = F
    for lo, hi, label in zip(edges, list(edges[1:]) + [None], labels):
        c = c.when((value > lo) & (value <= hi) if hi is not None else value > lo, label)
    return c


def clean_price(raw: Column) -> Column:
    """'5.00' or '4-6' -> struct(low, high, as_returned); what isn't a number keeps only its text."""
    parts = F.filter(F.transform(F.split(raw, "-"), lambda x: F.trim(x)), lambda x: x != "")
    nums = F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9]+(\.[0-9]*)?$"), x.cast("double")))
    ok = F.coalesce((F.size(nums) > 0) & F.forall(nums, lambda x: x.isNotNull()), F.lit(False))
    return F.struct(F.when(ok, F.array_min(nums)).alias("low"), F.when(ok, F.array_max(nums)).alias("high"), F.when(F.trim(raw) != "", raw).alias("as_returned"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each screen, in one pass: (step, stage, n)."""
    flags, cond = [], F.lit(True)
    for label, c in stages:
        cond = cond & F.coalesce(c, F.lit(False))
        flags.append(F.count_if(cond).alias(label))
    one = df.agg(*flags)
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("n")) for i, (s, _) in enumerate(stages)])))


def size_buckets_overlapping(df: DataFrame, column: str, needles: dict[str, str]) -> DataFrame:
    """How many rows contain each text, case aside, and how many contain none; rows may count in several."""
    u = F.upper(F.coalesce(column, F.lit("")))
    none = ~F.greatest(*[u.contains(n.upper()) for n in needles.values()])
    return df.agg(*[F.count_if(u.contains(n.upper())).alias(k) for k, n in needles.items()], F.count_if(none).alias("other"))


def valid_months(df: DataFrame, existed: Column, month: Column, floors: Sequence[Column], value: str, override: Column | None = None) -> DataFrame:
    """Adds raw_<value> and valid; the value is null where the month isn't valid. An override replaces both tests."""
    floor = F.least(*floors) if len(floors) > 1 else floors[0]
    ok = existed & (floor.isNull() | (month >= F.trunc(floor, "MM")))
    ok = F.coalesce(override, ok) if override is not None else ok
    return df.withColumns({f"raw_{value}": F.col(value), "valid": F.coalesce(ok, F.lit(False)), value: F.when(ok, F.col(value))})


def ledger(df: DataFrame, *rules: tuple[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and dropped rows with drop_reason, the first rule that holds; one condition a row."""
    tagged = df.withColumn("drop_reason", first_reason(*rules))
    return tagged.where("drop_reason is null").drop("drop_reason"), tagged.where("drop_reason is not null")
