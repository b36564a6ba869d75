"""Aggregates that studies need: timelines, shares, crosstabs, samples, medians, funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import grouped_quantiles, kth_value, quantiles, running_counts, saved
from .scan import beside


def upper_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """sorted[n // 2] of each group, with n: ranks from counts by range of values, no task sorts a group."""
    df = df.where(F.col(value).isNotNull())
    if not by:
        n = df.count()
        return df.sparkSession.createDataFrame([(kth_value(df, value, n // 2), n)], f"upper_median {dict(df.dtypes)[value]}, n long")
    ranked = running_counts(saved(df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "median"), by)
    k = F.floor(F.col("_all") / 2)
    return ranked.where((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))).select(*by, F.col("_v").alias("upper_median"), F.col("_all").alias("n"))


def quantile_profile(df: DataFrame, value: str, by: Sequence[str] = (), at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Interpolated quantiles with n, mean and the distance between the outer two."""
    names = [f"q{int(p * 100)}" for p in at]
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    if by:
        q = grouped_quantiles(df, by, {n: (F.col(value), p) for n, p in zip(names, at)}).withColumnsRenamed({c: f"_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        g = g.join(q, same, "left").drop(*[f"_{c}" for c in by])
    else:
        found, _ = quantiles(df, {"v": F.col(value)}, at)
        g = g.withColumns({n: F.lit(v).cast("double") for n, v in zip(names, found["v"])})
    return g.withColumn("iqr", F.col(names[-1]) - F.col(names[0]))


def form_timeline(filings: DataFrame, entity: str, form: str, day: str, families: dict[str, Sequence[str]], start: str, end: str) -> DataFrame:
    """One row an entity: first, last and count of each family of forms, the gap between two families' first days, and notes."""
    aggs = []
    for name, forms in families.items():
        d = F.when(F.col(form).isin(*forms), F.col(day))
        aggs += [F.min(d).alias(f"{name}_first"), F.max(d).alias(f"{name}_last"), F.count(d).alias(f"{name}_count")]
    t = filings.groupBy(entity).agg(*aggs)
    gap = F.datediff(f"{end}_first", f"{start}_first")
    notes = F.array_compact(F.array(F.when(gap > 730, "long gap"), F.when(gap < 0, "out of order"), F.when(F.col(f"{start}_count") == 0, f"no {start}"), F.when(F.col(f"{end}_count") == 0, f"no {end}")))
    return t.withColumns({"gap_days": gap, "notes": F.array_join(notes, "; ")})


def share_of(df: DataFrame, value: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Adds share of the group's total; 0 where the total is 0."""
    t = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("share", F.when(t == 0, F.lit(0.0)).otherwise(F.round(F.col(value) / t, digits)))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence, margin: str = "All") -> DataFrame:
    """Counts by two columns with totals of both, from one rollup over the listed values."""
    c = df.where(F.col(columns).isin(*values))
    counts = [F.count_if(F.col(columns) == v).alias(str(v)) for v in values]
    return c.rollup(rows).agg(*counts, F.count("*").alias(margin), F.grouping(rows).alias("_g")).withColumn(rows, F.when(F.col("_g") == 1, F.lit(margin)).otherwise(F.col(rows))).drop("_g")


def pivot_first(df: DataFrame, key: str, names: str, values: Sequence, value: str, order: Sequence[str]) -> DataFrame:
    """A column a name with the first value by the order; null where the name has no row."""
    return df.groupBy(key).agg(*[F.min_by(F.when(F.col(names) == v, F.col(value)), F.when(F.col(names) == v, F.struct(*order))).alias(str(v)) for v in values])


def dedupe(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The best row of each key by the order, and the others: one window, split by rank."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_k = 1").drop("_k"), ranked.where("_k > 1").withColumn("drop_reason", F.lit("duplicate")).drop("_k")


def hash_order(seed: str, id_: str) -> Column:
    """A text that orders rows at random but the same anywhere."""
    return F.md5(F.concat(F.lit(seed), F.col(id_).cast("string")))


def capped_sample(df: DataFrame, by: str, id_: str, cap: int, seed: str = "s") -> DataFrame:
    """Up to ``cap`` random rows of each class."""
    w = Window.partitionBy(by).orderBy(hash_order(seed, id_), id_)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def stratified_sample(df: DataFrame, strata: Sequence[str], id_: str, size: int, seed: str = "s") -> DataFrame:
    """About size * stratum / n rows of each stratum, then the first by hash until the size is met."""
    n = df.count()
    if n <= size:
        return df
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, id_), id_)
    all_ = Window.partitionBy(*strata)
    r = df.withColumns({"_k": F.row_number().over(w), "_want": F.floor(F.count("*").over(all_) * F.lit(size) / F.lit(n))})
    taken = F.col("_k") <= F.col("_want")
    have = r.where(taken).count()
    base = r.where(taken).drop("_k", "_want")
    extra = r.where(~taken).drop("_k", "_want").orderBy(hash_order(seed, id_), id_).limit(max(0, size - have))
    return base.union(extra)


def confusion(truth: DataFrame, predicted: DataFrame, key: Sequence[str], label: str, guess: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1; a wrong answer counts as a false positive and as a miss."""
    j = truth.select(*key, F.col(label).alias("_t")).join(predicted.select(*key, F.col(guess).alias("_p")), list(key), "full")
    right = F.coalesce(F.col("_t") == F.col("_p"), F.lit(False))
    c = j.agg(F.count_if(right).alias("tp"), F.count_if(F.col("_p").isNotNull() & ~right).alias("fp"), F.count_if(F.col("_t").isNotNull() & ~right).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def document_frequency(docs: DataFrame, id_: str, tokens: Column, least: int) -> DataFrame:
    """Tokens that occur in at least so many documents, with the number of them."""
    each = docs.select(id_, F.explode(F.array_distinct(tokens)).alias("token")).where("token <> ''")
    return each.groupBy("token").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def split_factor(bars: DataFrame, splits: DataFrame, entity: str, day: str, split_day: str, ratio: str) -> DataFrame:
    """Product of the ratios of all splits after a bar; 1 without any. A scan from the end, in which a day's bars come before its splits."""
    out = beside(bars, splits, entity, F.col(day), split_day, [ratio], ("sum", F.ln(ratio)), backward=True, targets_first=True)
    return out.select(*bars.columns, F.exp(F.coalesce("_run", F.lit(0.0))).alias("split_factor"))
