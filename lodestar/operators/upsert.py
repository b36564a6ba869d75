"""Merging updates into snapshots: per-column rules over base and updates, in one aggregate by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules: the last value; the last or first that isn't null; the first; smallest, largest, any true.
LAST, LAST_KNOWN, FIRST, LEAST, GREATEST, ANY = "last", "last_known", "first", "least", "greatest", "any"


def _rule(rule, column: str, seq: Column) -> Column:
    known = F.col(column).isNotNull()
    if callable(rule):
        return rule(F.col(column), seq)
    return {
        LAST: lambda: F.max_by(F.struct(column), seq)[column], FIRST: lambda: F.min_by(F.struct(column), seq)[column],
        LAST_KNOWN: lambda: F.max_by(column, F.when(known, seq)), LEAST: lambda: F.min(column), GREATEST: lambda: F.max(column), ANY: lambda: F.bool_or(column),
    }[rule]()


def merge_snapshot(base: DataFrame, updates: DataFrame, key: Sequence[str], rules: dict, order: str) -> DataFrame:
    """The new snapshot: each column of a key by its rule, rows of base before updates, updates by ``order``.

    Idempotent for a replayed batch. The result is written as a new table; nothing is changed in place.
    """
    columns = [*key, *rules]
    seq = F.struct("_batch", "_seq")
    old = base.select(*columns, F.lit(0).alias("_batch"), F.lit(0).cast("long").alias("_seq"))
    new = updates.select(*columns, F.lit(1).alias("_batch"), F.col(order).cast("long").alias("_seq"))
    return old.union(new).groupBy(*key).agg(*[_rule(r, c, seq).alias(c) for c, r in rules.items()])


def ladder(steps: Sequence[str], sticky: Sequence[str] = ()):
    """A rule for a status that only moves forward on its steps; a sticky status, once there, stays."""

    def rule(c: Column, seq: Column) -> Column:
        rank = F.coalesce(*[F.when(c == s, F.lit(i)) for i, s in enumerate(steps)])
        best = F.element_at(F.array(*[F.lit(s) for s in steps]), F.max(rank) + 1)
        for s in sticky:
            best = F.when(F.bool_or(c == s), s).otherwise(best)
        return best

    return rule


def insert_ignore(base: DataFrame, updates: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New keys only, the first row of each; and the count of what was ignored, as a frame of one row."""
    rest = [c for c in updates.columns if c not in key]
    fresh = updates.join(base.select(*key), list(key), "left_anti")
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    n = updates.agg(F.count("*").alias("offered")).crossJoin(first.agg(F.count("*").alias("inserted")))
    return first, n.select("offered", "inserted", (F.col("offered") - F.col("inserted")).alias("ignored"))


def apply_review(mentions: DataFrame, decisions: DataFrame, id_: str) -> DataFrame:
    """Confirmed rows get confidence 1, rejected ones lose their entity; only rows still in review change."""
    d = decisions.select(id_, F.col("decision").alias("_d"))
    j = mentions.join(d, id_, "left")
    act = F.col("needs_review") & F.col("_d").isNotNull()
    return j.withColumns({
        "issuer_id": F.when(act & (F.col("_d") == "reject"), F.lit(None)).otherwise(F.col("issuer_id")),
        "confidence": F.when(act & (F.col("_d") == "confirm"), F.lit(1.0)).when(act & (F.col("_d") == "reject"), F.lit(0.0)).otherwise(F.col("confidence")),
        "needs_review": F.col("needs_review") & ~F.coalesce(act, F.lit(False)),
    }).drop("_d")


def retention(mentions: DataFrame, rollup: DataFrame, today: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """What stays, and a row with expired, deleted and withheld.

    A row has expired if its UTC day is more than ``days`` days old; it goes if it names no entity or
    its entity's day is in the rollup, else it is withheld until it is.
    """
    mark = rollup.select("issuer_id", "day", "source").distinct().withColumn("_rolled", F.lit(True))
    j = mentions.withColumn("day", F.to_date("posted_at")).join(mark, ["issuer_id", "day", "source"], "left")
    expired = F.col("day") < F.date_sub(today, days)
    gone = expired & (F.col("issuer_id").isNull() | F.col("_rolled").isNotNull())
    report = j.agg(F.count_if(expired).alias("expired"), F.count_if(gone).alias("deleted"), F.count_if(expired & ~gone).alias("withheld"))
    return j.where(~F.coalesce(gone, F.lit(False))).select(*mentions.columns), report
