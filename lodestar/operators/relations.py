"""Joins of kinds that entity resolution needs: fallbacks, cascades, overlays, anti and semi unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the frame lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame without rows whose key is null, or an error if a key occurs twice."""
    df = df.dropna(subset=list(keys))
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the key {tuple(keys)} isn't unique: {twice[0].asDict()}")
    return df


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """many-to-one join (or one-to-one) that fails rather than multiply rows; null keys match nothing."""
    if one_to_one:
        left = assert_unique(left, keys)
    return left.join(assert_unique(right, keys), list(keys), how)


def member_of_any(df: DataFrame, key: str, *members: DataFrame) -> DataFrame:
    """Rows whose key is in any of the one-column frames: one semi join over their union."""
    union = reduce(DataFrame.union, [m.select(F.col(m.columns[0]).alias(key)) for m in members])
    return df.join(union.distinct(), key, "left_semi")


def todo(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def counts_of(df: DataFrame, key: str, **facts: DataFrame) -> DataFrame:
    """A count column for each fact table, pre-aggregated, 0 where it has no row of the key."""
    for name, fact in facts.items():
        n = fact.groupBy(F.col(key)).agg(F.count("*").alias(name))
        df = df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def cascade(df: DataFrame, id_: str, rules: Sequence[tuple[str, Column, DataFrame, str, str]]) -> DataFrame:
    """Resolve rows by the first rule that finds something; adds resolved and method.

    A rule is (method, key of the row, lookup table, its key column, its value column); a lookup key
    with several values gives the smallest.
    """
    values = []
    for i, (_, key, table, k, v) in enumerate(rules):
        side = table.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(v).alias(f"_v{i}"))
        df = df.withColumn(f"_q{i}", key).join(side, F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
        values.append(f"_v{i}")
    method = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(r[0])) for v, r in zip(values, rules)], F.lit("miss"))
    out = df.withColumns({"resolved": F.coalesce(*values), "method": method})
    return out.drop(*values, *[f"_{x}{i}" for x in "qk" for i in range(len(rules))])


def unique_only(df: DataFrame, candidates: DataFrame, key: str, candidate: str, limit: int = 20) -> DataFrame:
    """Resolve only keys with one candidate; else ambiguous with the first ``limit`` of them, or none."""
    each = candidates.where(F.col(candidate).isNotNull()).select(key, candidate).distinct()
    # The listed ones are cut by a ranked window, which Spark limits before the shuffle: no list of all of them is made.
    first = each.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(candidate))).where(F.col("_k") <= limit)
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(candidate)).alias("_all"), F.min(candidate).alias("_one"))
    c = each.groupBy(key).agg(F.count("*").alias("n_candidates")).join(listed, key)
    out = df.join(c, key, "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return out.select(*df.columns, F.when(n == 1, F.col("_one")).alias("resolved"), F.when(n == 1, "unique").when(n == 0, "none").otherwise("ambiguous").alias("outcome"), F.when(n > 1, F.array_join(F.col("_all").cast("array<string>"), "|")).alias("candidates"))


def merge_resolvers(strict: DataFrame, extended: DataFrame, key: str, value: str) -> DataFrame:
    """Full join of two resolvers: the strict answer wins; source is both, strict or extended."""
    a, b = strict.select(key, F.col(value).alias("_a")), extended.select(key, F.col(value).alias("_b"))
    source = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "strict").when(F.col("_b").isNotNull(), "extended")
    return a.join(b, key, "full").select(key, F.coalesce("_a", "_b").alias(value), source.alias("source"))


def overlay(df: DataFrame, verdicts: DataFrame, key: str, value: str, verdict: str) -> DataFrame:
    """A person's verdict replaces the automatic value."""
    v = verdicts.select(key, F.col(verdict).alias("_verdict"))
    out = df.join(v, key, "left")
    return out.withColumns({value: F.coalesce("_verdict", value), "value_source": F.when(F.col("_verdict").isNotNull(), "human").otherwise("auto")}).drop("_verdict")


def first_candidate(df: DataFrame, candidates: str, titles: DataFrame, title: str, keep: Column) -> DataFrame:
    """The first candidate of each row's list, most specific first, that exists and passes ``keep``."""
    each = df.select(*[c for c in df.columns if c != candidates], F.posexplode(candidates).alias("pos", title))
    found = each.join(titles, title).where(keep)
    keys = [c for c in df.columns if c != candidates]
    best = found.groupBy(*keys).agg(F.min_by(title, "pos").alias("attributed"), F.count("*").alias("n_found"))
    return df.drop(candidates).join(best, keys, "left")


def follow(df: DataFrame, edges: DataFrame, column: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """One hop over an alias map; names without an alias stay."""
    e = edges.groupBy(F.col(src).alias("_s")).agg(F.min(dst).alias("_d"))
    return df.join(e, F.col(column) == F.col("_s"), "left").withColumn("target", F.coalesce("_d", column)).drop("_s", "_d")


def relation_candidates(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """One hop over typed edges (src, rule, rule_rank, dst): candidates for review by rank."""
    j = nodes.join(edges, F.col(node) == F.col("src"))
    return j.groupBy(node).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rule_rank", "dst", "rule"))), lambda x: F.concat_ws(":", x["rule"], x["dst"])), "|").alias("candidates"), F.count("*").alias("n_edges"))


def ranked_fallback(df: DataFrame, table: DataFrame, keys: Sequence[tuple[str, str, str]], prefer: Sequence[Column], values: Sequence[str], id_: str) -> DataFrame:
    """Join by the first of several keys that matches; among a key's rows the best by ``prefer`` wins.

    ``keys`` holds (label, column of df, column of table). Adds matched_by and the values.
    """
    ranked = [table.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min_by(F.struct(*values), F.struct(*prefer)).alias("_v")) for _, _, k in keys]
    out = df
    for i, ((_, own, _), side) in enumerate(zip(keys, ranked)):
        out = out.join(side.select(F.col("_k").alias(f"_k{i}"), F.col("_v").alias(f"_v{i}")), F.col(own) == F.col(f"_k{i}"), "left")
    v = F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])
    by = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(k[0])) for i, k in enumerate(keys)])
    return out.select(*df.columns, by.alias("matched_by"), *[v[c].alias(c) for c in values])


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Two feeds side by side: both values, their distance, and whether it is within tolerance."""
    j = a.select(*keys, F.col(value).alias(f"{value}_a")).join(b.select(*keys, F.col(value).alias(f"{value}_b")), list(keys))
    d = F.abs(F.col(f"{value}_a") - F.col(f"{value}_b"))
    return j.withColumns({"abs_diff": d, "agrees": d <= tolerance})
