"""Per-entity series: forward returns, sessions, as-of joins, range joins, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import quotient
from .quantiles import running_counts, saved
from .scan import beside, month, running


def forward_return(bars: DataFrame, entity: str = "issuer_id", day: str = "day", close: str = "close") -> DataFrame:
    """Adds next_close and next_return; rows without a positive close leave before the scan looks ahead."""
    out = running(bars.where(F.col(close) > 0), entity, month(F.col(day)), [day], {"next_close": ("last", F.col(close))}, backward=True, upto=-1)
    return out.withColumn("next_return", F.col("next_close") / F.col(close) - 1)


def sessions(bars: DataFrame, entity: str = "issuer_id", day: str = "day", close: str = "close", within: int = 90) -> DataFrame:
    """Adds session (0 from the first traded day), first_day, in_window, since_first and month_end."""
    runs = {"_n": ("sum", F.lit(1)), "_first": ("first", F.struct(F.col(day).alias("day"), F.col(close).alias("close")))}
    out = running(bars, entity, month(F.col(day)), [day], runs)
    out = out.withColumns({"session": F.col("_n") - 1, "first_day": F.col("_first.day"), "since_first": quotient(F.col(close), F.col("_first.close")) - 1}).drop("_n", "_first")
    whole = Window.partitionBy(entity, F.trunc(day, "MM"))
    return out.withColumns({"in_window": F.col("session") < within, "month_end": F.col("session") == F.max("session").over(whole)})


def horizon_returns(bars: DataFrame, horizons: Sequence[int], entity: str = "issuer_id", day: str = "day", close: str = "close") -> DataFrame:
    """One row an entity: return from the first close to the close of session h; null if h isn't reached."""
    s = sessions(bars, entity, day, close)
    return s.groupBy(entity).agg(*[(quotient(F.max(F.when(F.col("session") == h, F.col(close))), F.max(F.when(F.col("session") == 0, F.col(close)))) - 1).alias(f"ret_{h}") for h in horizons])


def asof_forward(targets: DataFrame, series: DataFrame, entity: str, target: str, day: str, value: str, reach: int | None = None) -> DataFrame:
    """First value at or after each target, within ``reach`` days if given; null unless the series extends to the target.

    One scan over both sides, from the end: linear in their rows. ``targets`` keeps its columns and rows; asof_day and asof_value are added.
    """
    found = ("last", F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    out = beside(targets, series, entity, F.col(target), day, [value], found, backward=True)
    near = F.lit(True) if reach is None else F.col("_run.d") <= F.date_add(F.col(target), reach)
    return out.select(*targets.columns, F.when(near, F.col("_run.d")).alias("asof_day"), F.when(near, F.col("_run.v")).alias("asof_value"))


def asof_backward(targets: DataFrame, series: DataFrame, entity: str, target: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Last row of the series at or before each target, by ``order`` (first a date or time, then ties): one scan over both sides."""
    out = beside(targets, series, entity, F.col(target), order[0], list(order[1:]), ("last", F.struct(*values)))
    return out.select(*targets.columns, *[F.col(f"_run.{v}").alias(f"asof_{v}") for v in values])


def asof_nearest(targets: DataFrame, series: DataFrame, entity: str, target: str, day: str, key: str, within: int) -> DataFrame:
    """The row of the series nearest to the target, within so many days; the smaller key wins a tie."""
    s = series.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), F.col(key).alias("_k"))
    gap = F.abs(F.datediff(F.col("_d"), F.col(target)))
    out = targets.join(s, (F.col(entity) == F.col("_e")) & F.col("_d").between(F.date_sub(F.col(target), within), F.date_add(F.col(target), within)), "left")
    out = out.groupBy(*targets.columns).agg(F.min(F.when(F.col("_k").isNotNull(), F.struct(gap.alias("gap"), F.col("_k").alias("k")))).alias("_m"))
    return out.select(*targets.columns, F.col("_m.k").alias("near_key"), F.col("_m.gap").alias("gap_days"))


def asof_slack(targets: DataFrame, series: DataFrame, entity: str, target: str, day: str, value: str, lead: int = 2, most: int = 7) -> DataFrame:
    """First non-null value from ``lead`` days before the target on; null if over ``most`` days away."""
    found = ("last", F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    out = beside(targets, series.where(F.col(value).isNotNull()), entity, F.date_sub(F.col(target), lead), day, [value], found, backward=True)
    near = F.abs(F.datediff("_run.d", F.col(target))) <= most
    return out.select(*targets.columns, F.when(near, F.col("_run.d")).alias("slack_day"), F.when(near, F.col("_run.v")).alias("slack_value"))


def window_counts(events: DataFrame, points: DataFrame, entity: str, at: str, day: str, before: int, after: int) -> DataFrame:
    """Points in [day - before, day + after] of each event, events without any kept.

    Points are counted a day first; each event is spread over its days and meets those counts in an
    equi-join on (entity, day), so one busy entity is no bottleneck.
    """
    daily = points.groupBy(F.col(entity).alias("_e"), F.to_date(at).alias("_d")).agg(F.count("*").alias("_n"))
    days = events.select(*events.columns, F.explode(F.sequence(F.date_sub(day, before), F.date_add(day, after))).alias("_day"))
    got = days.join(daily, (F.col(entity) == F.col("_e")) & (F.col("_day") == F.col("_d")), "left")
    return got.groupBy(*events.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_points"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Average rank with ties among all rows or within groups; null values have no rank.

    Global ranks come from the distinct values: their counts are summed up in ranges of values first,
    then within a range, so no task sorts all rows.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(F.col(value))
        ties = Window.partitionBy(*by, value)
        r = F.rank().over(w) + (F.count("*").over(ties) - 1) / 2
        return df.where(F.col(value).isNotNull()).withColumn(name, r.cast("double"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return df.join(value_ranks(counts, name).select("_v", name), F.col(value) == F.col("_v")).drop("_v")


def value_ranks(counts: DataFrame, name: str = "avg_rank") -> DataFrame:
    """Adds the average rank to distinct values ``_v`` that occur ``_n`` times each."""
    out = running_counts(saved(counts, "ranks"))
    return out.withColumn(name, (F.col("_below") + (F.col("_n") + 1) / 2).cast("double")).select(*counts.columns, name)


def interval_union_days(intervals: DataFrame, entity: str, lo: str, hi: str) -> DataFrame:
    """Days covered by an entity's half-open intervals [lo, hi), overlaps once; empty ones count nothing."""
    x = running(intervals.where(F.col(hi) > F.col(lo)), entity, month(F.col(lo)), [lo, hi], {"_reach": ("max", F.col(hi))}, upto=-1)
    # What an interval adds lies beyond all before it; an isle begins where it doesn't touch them.
    adds = F.greatest(F.lit(0), F.datediff(F.col(hi), F.greatest(F.col(lo), F.col("_reach"))))
    begins = F.col("_reach").isNull() | (F.col(lo) > F.col("_reach"))
    return x.groupBy(entity).agg(F.sum(adds).alias("covered_days"), F.count_if(begins).alias("islands"))


def sliding_count(df: DataFrame, entity: str, ts: str, seconds: int) -> Column:
    """Rows of the entity in the ``seconds`` before and at each row, itself included."""
    w = Window.partitionBy(entity).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return F.count("*").over(w)


def one_pass_sd(values: Column) -> Column:
    """Sample deviation of an array's numbers in their order, by Welford's update; null of fewer than two.

    The operations and their order are those of the SQL's engine, so that a z on a threshold falls to the same side.
    """

    def step(s: Column, x: Column) -> Column:
        n, mean = s["n"] + 1, s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.transform(values, lambda x: x.cast("double")), start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1))))


def trailing_z(daily: DataFrame, entity: str, day: str, value: str, days: int) -> DataFrame:
    """Adds base_mean, base_sd and z of the value against the entity's ``days`` days before."""
    w = Window.partitionBy(entity).orderBy(F.datediff(day, F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    out = daily.withColumns({"base_mean": F.avg(value).over(w), "base_sd": one_pass_sd(F.collect_list(value).over(w))})
    return out.withColumn("z", F.try_divide(F.col(value) - F.col("base_mean"), F.col("base_sd")))


def calendar_windows(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Every month from start to end, clipped to the end: month_start, month_end (inclusive)."""
    m = bounds.select(*bounds.columns, F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).alias("_m"))
    return m.select(*bounds.columns, F.greatest(F.col("_m"), F.col(start)).alias("month_start"), F.least(F.last_day("_m"), F.col(end)).alias("month_end"))
