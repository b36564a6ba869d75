"""Running values along an entity's rows, however many one entity has: a segmented scan.

Rows are keyed by (entity, bucket of time). A value runs within its bucket in a window of that key; what a bucket
leaves behind (its last value, sum, extreme) is one row, and these rows run along the entity to give what each bucket
starts from. No step holds more of an entity than one bucket, or one row a bucket, and nothing is joined on the entity alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def month(at: Column) -> Column:
    """The bucket of daily series: a calendar month."""
    return F.trunc(at, "MM")


def hour(at: Column) -> Column:
    """The bucket of series of events."""
    return F.date_trunc("hour", at)


_INNER = {"last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True), "sum": F.sum, "max": F.max, "min": F.min}
_MERGED = {
    "last": lambda carry, own: F.coalesce(own, carry), "first": lambda carry, own: F.coalesce(carry, own), "sum": lambda carry, own: F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own),
    "max": F.greatest, "min": F.least,
}


def running(df: DataFrame, entity: str, bucket: Column, order: Sequence[str], runs: dict[str, tuple[str, Column]], backward: bool = False, upto: int = 0) -> DataFrame:
    """Adds each name of ``runs``, a (kind, column): that of the entity's rows from the first to ``upto`` places from here.

    Kinds are last and first (of what isn't null), sum, max, min. ``bucket`` has to be monotonic in the first of the order's
    columns. ``backward`` runs from an entity's last row to its first. Nulls come first in the order.
    """
    turn = (lambda c: F.col(c).desc_nulls_last()) if backward else (lambda c: F.col(c).asc_nulls_first())
    keyed = df.withColumns({"_bucket": bucket, **{f"_of_{n}": c for n, (_, c) in runs.items()}})
    rank = F.struct(*order)
    first, last = (F.max_by, F.min_by) if backward else (F.min_by, F.max_by)

    def end(name: str, kind: str) -> Column:
        x = F.col(f"_of_{name}")
        here = F.when(x.isNotNull(), rank)
        return (last(x, here) if kind == "last" else first(x, here) if kind == "first" else _INNER[kind](x)).alias(f"_end_{name}")

    ends = keyed.groupBy(entity, "_bucket").agg(*[end(n, kind) for n, (kind, _) in runs.items()])
    along = Window.partitionBy(entity).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(entity).alias("_entity"), F.col("_bucket").alias("_b"), *[_INNER[kind](F.col(f"_end_{n}")).over(along).alias(f"_carry_{n}") for n, (kind, _) in runs.items()])
    inside = Window.partitionBy(entity, "_bucket").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, upto)
    own = keyed.withColumns({f"_own_{n}": _INNER[kind](F.col(f"_of_{n}")).over(inside) for n, (kind, _) in runs.items()})
    met = own.join(carried, F.col(entity).eqNullSafe(F.col("_entity")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return met.select(*df.columns, *[_MERGED[kind](F.col(f"_carry_{n}"), F.col(f"_own_{n}")).alias(n) for n, (kind, _) in runs.items()])


def beside(targets: DataFrame, series: DataFrame, entity: str, target: Column, at: str, ties: Sequence[str], run: tuple[str, Column], bucket=month, backward: bool = False, targets_first: bool = False) -> DataFrame:
    """targets with ``_run``: what runs along the series up to each target; both sides are one scan.

    ``run`` is a (kind, column of the series), rows at the target's time included unless ``targets_first``. ``ties`` orders rows of one time.
    Series rows without a time or an entity count nowhere, targets without get null. Repeated targets stay.
    """
    kind, value = run
    # At equal times the side that comes first in the direction of the scan.
    early, late = (1, 0) if backward else (0, 1)
    side, mine = (late, early) if targets_first else (early, late)
    s = series.where(F.col(at).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), F.col(at).alias("_t"), F.lit(side).alias("_side"), F.struct(*ties).alias("_o") if ties else F.struct(F.lit(0)).alias("_o"), value.alias("_x"), F.lit(None).alias("_row"))
    # A target's own columns travel as one struct.
    t = targets.select(F.col(entity).alias("_e"), target.alias("_t"), F.lit(mine).alias("_side"), F.lit(None).alias("_o"), F.lit(None).alias("_x"), F.struct(*targets.columns).alias("_row"))
    both = s.unionByName(t)
    out = running(both, "_e", bucket(F.col("_t")), ["_t", "_side", "_o"], {"_run": (kind, F.col("_x"))}, backward)
    return out.where(F.col("_side") == mine).select("_row.*", F.when(F.col("_t").isNotNull(), F.col("_run")).alias("_run"))
