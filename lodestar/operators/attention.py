"""Attention measures: rollups, abnormal attention, window comparisons. Absent months and days are never zero."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import months_between
from .quantiles import grouped_quantiles, quantiles
from .timeseries import forward_return


def panel(mentions: DataFrame, bars: DataFrame) -> DataFrame:
    """Issuer-days with accepted mentions and a later close: counts, engagement and the next return."""
    daily = mentions.groupBy("issuer_id", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("mention_count"), F.sum("engagement").alias("engagement"))
    return daily.join(forward_return(bars).select("issuer_id", "day", "close", "next_close", "next_return"), ["issuer_id", "day"]).where(F.col("next_close").isNotNull())


def daily_rollup(mentions: DataFrame, author: str) -> DataFrame:
    """Counts, distinct authors and summed engagement per issuer, source and UTC day."""
    return mentions.groupBy("issuer_id", "source", F.to_date("posted_at").alias("day")).agg(
        F.count("*").alias("mention_count"), F.countDistinct(author).alias("unique_authors"), F.sum("engagement").alias("weighted_engagement")
    )


def cohort_z(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <column>_z: distance from the cohort's mean in sample deviations; one row of moments is joined."""
    m = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(m))
    return out.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def abnormal_daily(events: DataFrame, daily: DataFrame, entity: str, event_day: str, day: str, value: str, event: tuple[int, int], baseline: tuple[int, int], least_event: int, least_base: int) -> DataFrame:
    """Mean of the event window over mean of the baseline; null with too few days or a baseline of 0."""
    lo, hi = min(event[0], baseline[0]), max(event[1], baseline[1])
    off = F.datediff(F.col("_d"), F.col(event_day))
    s = daily.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), F.col(value).alias("_v"))
    j = events.join(s, (F.col(entity) == F.col("_e")) & F.col("_d").between(F.date_add(event_day, lo), F.date_add(event_day, hi)))
    at, before = off.between(*event), off.between(*baseline)
    g = j.groupBy(*events.columns).agg(F.count_if(at).alias("event_days"), F.count_if(before).alias("base_days"), F.avg(F.when(at, F.col("_v"))).alias("_ev"), F.avg(F.when(before, F.col("_v"))).alias("_bv"))
    ok = (F.col("event_days") >= least_event) & (F.col("base_days") >= least_base)
    return g.where("event_days + base_days > 0").withColumn("abnormal", F.when(ok & (F.col("_bv") != 0), F.col("_ev") / F.col("_bv"))).drop("_ev", "_bv")


def _relative(anchors: DataFrame, monthly: DataFrame, entity: str, anchor: str, month: str, value: str) -> DataFrame:
    m = monthly.select(F.col(entity), F.col(month).alias("month"), F.col(value).alias("value"))
    return anchors.join(m, entity).withColumn("rel", months_between(F.col(anchor), F.col("month")))


def abnormal_monthly(anchors: DataFrame, monthly: DataFrame, entity: str, anchor: str, month: str, value: str, least: int = 6, digits: int = 4) -> DataFrame:
    """Value of the anchor's month over the median of the year that ends a month before the anchor."""
    j = _relative(anchors, monthly, entity, anchor, month, value)
    base = (F.col("month") < F.add_months(anchor, -1)) & (F.col("month") >= F.add_months(anchor, -13))
    g = j.groupBy(entity).agg(F.max(F.when(F.col("rel") == 0, F.col("value"))).alias("at_event"), F.count_if(base).alias("base_months"), F.percentile(F.when(base, F.col("value")), F.lit(0.5)).alias("base"))
    ratio = F.when(F.col("base_months") >= least, F.col("at_event") / F.greatest("base", F.lit(1)))
    return g.select(entity, "at_event", "base_months", F.round("base", 6).alias("base"), F.round(ratio, digits).alias("ratio"), (ratio > 1).alias("rose"), (F.col("base") >= 500).alias("baseline_reliable"))


def floor_ladder(ratios: DataFrame, floors: Sequence[int]) -> DataFrame:
    """The share that rose and the median ratio among entities whose baseline reaches each floor."""
    x = ratios.where(F.col("base_months") > 0).where("base is not null").withColumn("floor_views", F.explode(F.array(*[F.lit(f) for f in floors]))).where(F.col("base") >= F.col("floor_views"))
    x = x.where("base_months >= 2")
    g = x.groupBy("floor_views").agg(F.count("*").alias("entities"), F.count_if(F.col("ratio") > 1).alias("rose"))
    median = grouped_quantiles(x, ["floor_views"], {"median_ratio": (F.col("ratio"), 0.5)})
    return g.join(median, "floor_views", "left").select("floor_views", "entities", "rose", F.round("median_ratio", 4).alias("median_ratio"))


def balanced_windows(anchors: DataFrame, monthly: DataFrame, entity: str, anchor: str, month: str, value: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Medians over entities that have every window; ratios are to the first window."""
    j = _relative(anchors, monthly, entity, anchor, month, value)
    w = j.groupBy(entity).agg(*[F.avg(F.when(F.col("rel").between(*b), F.col("value"))).alias(n) for n, b in windows.items()]).dropna(subset=list(windows))
    first, *rest = windows
    w = w.where(F.col(first) > 0)
    columns = {n: F.col(n) for n in windows} | {f"{n}_ratio": F.col(n) / F.col(first) for n in rest}
    medians, sizes = quantiles(w, columns, [0.5])
    row = [(sizes[first], *[medians[n][0] for n in columns])]
    out = w.sparkSession.createDataFrame(row, "entities long, " + ", ".join(f"`{n}` double" for n in columns))
    return out.select("entities", *[F.round(n, 4 if n in windows else 6).alias(n) for n in columns])


def relative_share(anchors: DataFrame, monthly: DataFrame, entity: str, anchor: str, month: str, value: str, span: tuple[int, int]) -> DataFrame:
    """Each month's share of its entity's total in the span, with months collected, expected and coverage."""
    expected = span[1] - span[0] + 1
    w = Window.partitionBy(entity)
    j = _relative(anchors, monthly, entity, anchor, month, value).where(F.col("rel").between(*span))
    j = j.withColumns({"_t": F.sum("value").over(w), "months_collected": F.count("*").over(w)})
    return j.select(entity, "rel", F.col("value").alias(value), F.when(F.col("_t") > 0, F.round(F.col("value") / F.col("_t"), 6)).alias("share"), "months_collected", F.lit(expected).alias("months_expected"), F.round(F.col("months_collected") / expected, 4).alias("coverage"))


def with_monthly_series(bars: DataFrame, monthly: DataFrame, entity: str, day: str, month: str, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """Daily rows with a column a monthly series, null where the series is absent."""
    wide = monthly.groupBy(entity, F.col(month).alias("_m")).pivot(series, list(names)).agg(F.first(value))
    return bars.withColumn("_m", F.trunc(day, "MM")).join(wide, [entity, "_m"], "left").drop("_m")


def long_panel(parts: Sequence[tuple[str, str, str | None, DataFrame]]) -> DataFrame:
    """One long frame of unlike series, tagged with series, resolution and flag."""
    tagged = [df.withColumns({"series": F.lit(s), "resolution": F.lit(r), "flag": F.lit(f).cast("string")}) for s, r, f, df in parts]
    return reduce(DataFrame.unionByName, tagged)


def merge_aliased(views: DataFrame, titles: DataFrame, title: str, entity: str, day: str, value: str) -> DataFrame:
    """Series of several titles of one entity, summed by day."""
    return views.join(titles, title).groupBy(entity, day).agg(F.sum(value).alias(value))


def compare_counts(df: DataFrame, pre: str, post: str, pre_exact: str, post_exact: str) -> DataFrame:
    """Counts as intervals: [c, c] if exact, else [c, inf). A direction holds only if the intervals part."""
    inf = F.lit(float("inf"))
    above = F.col(post) > F.when(F.col(pre_exact), F.col(pre).cast("double")).otherwise(inf)
    below = F.col(pre) > F.when(F.col(post_exact), F.col(post).cast("double")).otherwise(inf)
    return df.withColumns({"post_exceeds": above, "pre_exceeds": below, "direction_established": above | below, "magnitude_valid": F.col(pre_exact) & F.col(post_exact)})


def bucket_windows(events: DataFrame, points: DataFrame, entity: str, event_day: str, at: str, days: int) -> DataFrame:
    """Counts in the days before and after the event day, which is in neither, and whether points reach that far back.

    Points are counted a day first. An event is spread over its days and meets those counts on (entity, day); how far
    back an entity goes is one row of it.
    """
    p = points.groupBy(F.col(entity).alias("_e"), F.to_date(at).alias("_d")).agg(F.count("*").alias("_n"))
    off = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    spread = events.select(*events.columns, off.alias("_off")).withColumn("_day", F.date_add(event_day, F.col("_off")))
    met = spread.join(p, (F.col(entity) == F.col("_e")) & (F.col("_day") == F.col("_d")), "left")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    counted = met.groupBy(*events.columns).agg(part(F.col("_off") < 0).alias("pre_count"), part(F.col("_off") > 0).alias("post_count"))
    oldest = p.groupBy(F.col("_e").alias("_o")).agg(F.min("_d").alias("_oldest"))
    gap = F.datediff("_oldest", F.col(event_day))
    return counted.join(oldest, F.col(entity) == F.col("_o"), "left").select(*counted.columns, (gap <= -days).alias("pre_complete"), (gap <= 0).alias("post_complete"))


def censored_density(df: DataFrame, count: str, covered: str, expected: Column, budget: int, least: float = 0.2) -> DataFrame:
    """Rows a covered day; null where too little of the span is covered to say."""
    coverage = F.col(covered) / expected
    return df.withColumns({"coverage": F.round(coverage, 4), "density": F.when(coverage >= least, F.round(F.try_divide(F.col(count), F.col(covered)), 4)), "volume_exceeds_budget": F.col(count) > budget})


def count_quality(df: DataFrame, fetched: str, off_target: str, capped: Column, most: float = 0.5) -> DataFrame:
    """exact, lower_bound (capped), or unreliable_window (capped and mostly off target); null share of nothing."""
    share = F.try_divide(F.col(off_target), F.col(fetched))
    poor = capped & (F.coalesce(share, F.lit(0.0)) > most)
    return df.withColumns({"off_target_fraction": F.round(share, 3), "quality": F.when(~capped, "exact").when(poor, "unreliable_window").otherwise("lower_bound"), "usable": ~poor})
