"""Exact quantiles and ranks of columns that no task can sort.

Without groups, several ranks of several columns are found together: counts by value are saved once, then the cells that
hold a wanted rank are cut by one histogram a round, all at once, until what is left fits the driver. With groups, ranks come
from counts by range of values: the ranges' sums run along a group, then the values within one range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.search import cuts_below
from ..functions.workspace import folder

#: Ranges that a cell is cut into, and distinct values that are left for the driver.
PARTS, GATHER = 64, 10_000
_FRACTIONS = [i / PARTS for i in range(1, PARTS)]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, so that several passes compute it once."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@dataclass
class _Cell:
    """Values lo < v <= hi of a column (None: no bound), with how many lie below and the ranks that are wanted inside."""

    column: str
    lo: object
    hi: object
    below: int
    ranks: list

    def holds(self) -> Column:
        inside = F.col("_g") == self.column
        if self.lo is not None:
            inside &= F.col("_v") > F.lit(self.lo)
        return inside if self.hi is None else inside & (F.col("_v") <= F.lit(self.hi))


def select_ranks(counts: DataFrame, wanted: dict[str, Sequence[int]], gather: int = GATHER) -> dict[str, dict[int, object]]:
    """The values at the wanted ranks (from 0) of each column. ``counts``, a saved table, has _g (the column), _v and _c (how often)."""
    cells = [_Cell(g, None, None, 0, sorted(set(ks))) for g, ks in wanted.items() if ks]
    found: dict[str, dict[int, object]] = {g: {} for g in wanted}
    while cells:
        number = F.coalesce(*[F.when(c.holds(), F.lit(i)) for i, c in enumerate(cells)])
        inside = counts.withColumn("_cell", number).where("_cell is not null")
        facts = {r[0]: r for r in inside.groupBy("_cell").agg(F.count("*"), F.percentile_approx("_v", _FRACTIONS, 10_000)).collect()}
        if sum(r[1] for r in facts.values()) <= max(gather, 2 * len(cells)):
            break
        cuts = {i: sorted(set(r[2])) for i, r in facts.items()}
        part = F.coalesce(*[F.when(F.col("_cell") == i, cuts_below(F.col("_v"), c, inclusive=False)) for i, c in cuts.items()])
        sums: dict[int, list] = {i: [] for i in cuts}
        for i, p, n in inside.groupBy("_cell", part.alias("_p")).agg(F.sum("_c")).collect():
            sums[i].append((p, n))
        narrower = []
        for i, c in enumerate(cells):
            below, ranks = c.below, list(c.ranks)
            for p, n in sorted(sums.get(i, [])):
                mine = [k for k in ranks if k < below + n]
                ranks = ranks[len(mine) :]
                if mine:
                    lo = cuts[i][p - 1] if p else c.lo
                    narrower.append(_Cell(c.column, lo, cuts[i][p] if p < len(cuts[i]) else c.hi, below, mine))
                below += n
        cells = narrower
    if cells:
        rows: dict[int, list] = {i: [] for i in range(len(cells))}
        for i, v, n in inside.select("_cell", "_v", "_c").collect():  # at most ``gather`` values
            rows[i].append((v, n))
        for i, c in enumerate(cells):
            below, ranks = c.below, list(c.ranks)
            for v, n in sorted(rows[i]):
                below += n
                while ranks and ranks[0] < below:
                    found[c.column][ranks.pop(0)] = v
    return found


def _between(low, high, at: float):
    """The value at a fractional rank between its neighbours."""
    k = math.floor(at)
    return float(low) if at == k else (k + 1 - at) * float(low) + (at - k) * float(high)


def quantiles(df: DataFrame, columns: dict[str, Column], at: Sequence[float], gather: int = GATHER) -> tuple[dict[str, list], dict[str, int]]:
    """Interpolated quantiles of each named column and how many values it has; None for a column without any."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("_g"), c.cast("double").alias("_v")) for n, c in columns.items()]))).where("_v is not null")
    counts = saved(long.groupBy("_g", "_v").agg(F.count("*").alias("_c")), "quantiles")
    n = dict(counts.groupBy("_g").agg(F.sum("_c")).collect())
    places = {g: [q * (n[g] - 1) for q in at] for g in columns if n.get(g)}
    got = select_ranks(counts, {g: [k for p in ps for k in (math.floor(p), math.ceil(p))] for g, ps in places.items()}, gather)
    return {g: [_between(got[g][math.floor(p)], got[g][math.ceil(p)], p) for p in places[g]] if g in places else [None] * len(at) for g in columns}, {g: n.get(g, 0) for g in columns}


def kth_value(df: DataFrame, value: str, k: int, gather: int = GATHER):
    """The k-th smallest value (from 0) of a column; None beyond its end."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.lit("v").alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    return select_ranks(saved(counts, "kth"), {"v": [k]}, gather)["v"].get(k)


def running_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds to distinct values (by, _v, _n), a saved table, how many rows of the group lie below (_below) and in all (_all).

    Any cuts of the range of values give the same counts; they decide only how evenly it is dealt.
    """
    cuts = sorted(set(counts.agg(F.percentile_approx("_v", _FRACTIONS, 10_000)).first()[0] or []))
    ranged = counts.withColumn("_p", cuts_below(F.col("_v"), cuts, inclusive=False))
    along = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_s"))  # at most PARTS rows a group
    parts = parts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(*by)).alias("_all"))
    inner = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    met = ranged.withColumn("_i", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(parts if by else F.broadcast(parts), same)
    return met.select(*counts.columns, (F.col("_b") + F.col("_i")).alias("_below"), "_all")


def grouped_quantiles(df: DataFrame, by: Sequence[str], columns: dict[str, tuple[Column, float]]) -> DataFrame:
    """A row a group with a column for each name: the interpolated quantile of a (column, q); null where a group has no value."""
    distinct = list(dict.fromkeys(str(c) for c, _ in columns.values()))
    of = {str(c): c for c, _ in columns.values()}
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), of[s].cast("double").alias("_v")) for i, s in enumerate(distinct)])))
    counts = saved(long.where("_v is not null").groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n")), "quantiles")
    ranked = running_counts(counts, [*by, "_c"])

    def at(i: int, q: float, side) -> Column:
        k = side((F.col("_all") - 1) * q)
        return F.max(F.when((F.col("_c") == i) & (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col("_v")))

    sides = [(n, distinct.index(str(c)), q) for n, (c, q) in columns.items()]
    sizes = [F.max(F.when(F.col("_c") == i, F.col("_all"))).alias(f"_all{i}") for i in range(len(distinct))]
    g = ranked.groupBy(*by).agg(*sizes, *[x for n, i, q in sides for x in (at(i, q, F.floor).alias(f"_lo_{n}"), at(i, q, F.ceil).alias(f"_hi_{n}"))])

    def between(n: str, i: int, q: float) -> Column:
        place = (F.col(f"_all{i}") - 1) * q
        k = F.floor(place)
        low, high = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        return F.when(place == k, low).otherwise((k + 1 - place) * low + (place - k) * high).alias(n)

    return g.select(*by, *[between(*s) for s in sides])
