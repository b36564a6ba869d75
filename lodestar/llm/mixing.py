"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give c words for each of its own (0 <= c <= 2) gives every document c copies on
average: floor(c) certainly, and one more with the fractional probability p. Probabilities are rounded
in pairs: word mass moves at random from one document to the other, in the direction that keeps each
one's expectation, until one is at 0 or 1. A pair's mass is kept, so a source's total is kept but for
one last document. Pairs meet in groups of bounded size; each group leaves one fractional document,
and those residuals meet in further rounds: a reduction tree over the cluster, as high as each source needs.
Some rounded documents go up with them: at a source's last level they are flipped, one or two at a time, to make up for the residual.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, row_hashes, small, unused

#: Documents that one group of the reduction tree holds on average.
GROUP = 4096
#: Rounded documents that a group sends up at least; with few groups more, a group of the next level in all.
CARRIED = 16
#: Documents of a source's last level that settling starts from.
STARTS = 32
#: Equal rows that are rounded in one group.
CHUNK = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Targets of sources: (source, source_size) -> source, source_size, target.

    Sources in code-point order, null last, get the weights in turn and share ``share`` of all words;
    a target stops at ``ceiling`` times its source's size and the excess goes to the others by weight.
    That is min(cap, level * weight) for one level: with sources by cap / weight, those below the level
    are a prefix, found from running sums. One row a source comes in, so one small task does it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", weight).withColumn("cap", ceiling * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    by_r = Window.orderBy("r", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(by_r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "free": F.sum("w").over(by_r.rowsBetween(0, Window.unboundedFollowing)), "all": share * F.sum("source_size").over(everything)})
    # The level if this source is the first that is not capped; the right one is the first that does not pass its own ratio.
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("free"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).cast("double").alias("target"))


def _pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round p in place, largest documents first; returns p and the index of the fractional one (or -1)."""
    order = np.lexsort((np.arange(len(p)), -size))
    rest = -1
    u = rng.random(len(p))
    for k in order:
        if not 1e-12 < p[k] < 1 - 1e-12:
            p[k] = round(p[k])
            continue
        if rest < 0:
            rest = k
            continue
        a, b = size[rest], size[k]
        # Word mass that can move to `rest`, and away from it.
        up, down = min((1 - p[rest]) * a, p[k] * b), min(p[rest] * a, (1 - p[k]) * b)
        moved = up if u[k] * (up + down) < down else -down
        p[rest] += moved / a
        p[k] -= moved / b
        for i in (rest, k):
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        frac = [i for i in (rest, k) if 0 < p[i] < 1]
        rest = frac[0] if frac else -1
    return p, rest


def _descend(size: np.ndarray, p: np.ndarray, goal: float) -> np.ndarray:
    """Bring the sum of size * p, p all 0 or 1, nearer to the goal by flips of one or two while one helps."""
    gap = goal - float(size @ p)
    while len(size):  # the gap shrinks with every step
        change = np.where(p > 0, -size, size)
        one = int(np.argmin(np.abs(gap - change)))
        best, flips = abs(gap - change[one]), [one]
        if len(size) > 1:
            # For each document the best partner: the neighbours of what is then left, in sorted order.
            order = np.argsort(change, kind="stable")
            near = np.searchsorted(change[order], gap - change)
            for step in (-1, 0):
                other = order[np.clip(near + step, 0, len(order) - 1)]
                left = np.abs(gap - change - change[other])
                left[other == np.arange(len(size))] = np.inf
                i = int(np.argmin(left))
                if left[i] < best - 1e-9:
                    best, flips = left[i], [i, int(other[i])]
        if best >= abs(gap) - 1e-9:
            break
        gap -= float(change[flips].sum())
        p[flips] = 1 - p[flips]
    return p


def _settle(size: np.ndarray, p: np.ndarray, goal: float) -> np.ndarray:
    """_descend, also from beside where it ends: some documents, evenly spread by size, are flipped first and stay so."""
    p = _descend(size, p, goal)
    gap = abs(goal - float(size @ p))
    by_size = np.argsort(-size, kind="stable")
    for i in by_size[:: max(1, len(by_size) // STARTS)]:
        if gap <= size.min() / 2:
            break
        others, q = np.arange(len(p)) != i, p.copy()
        q[i] = 1 - q[i]
        q[others] = _descend(size[others], q[others], goal - size[i] * q[i])
        if abs(goal - float(size @ q)) < gap - 1e-9:
            p, gap = q, abs(goal - float(size @ q))
    return p


def _carried(open_: np.ndarray, count: int) -> np.ndarray:
    """Of the indexes, sorted by size, ``count`` spread evenly, the smallest document among them."""
    return open_ if len(open_) <= count else open_[len(open_) - 1 - np.arange(count) * len(open_) // count]


def _round_groups(rows: DataFrame, seed: int, group: int) -> DataFrame:
    """One level of the tree: every (source, group) is rounded; what goes up, its residual and some others, has open = true.

    A source with one group left is at its last level and is settled.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "tie"], kind="stable", ascending=[False, True]).reset_index(drop=True)
        rng = np.random.default_rng([seed, len(pdf), int(pdf["tie"].iloc[0]) & 0xFFFFFFFF])
        size, before = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        p, rest = _pivot(size, before.copy(), rng)
        groups, free = int(pdf["groups"].iloc[0]), pdf["free"].to_numpy(bool)
        last = groups <= 1
        if last and free.any():
            if rest >= 0:
                p[rest] = float(p[rest] >= 0.5)
            p[free] = _settle(size[free], p[free], float(size[free] @ before[free]))
        pdf["p"], pdf["open"] = p, False
        if not last:
            count = max(CARRIED, group // min(groups, group)) // 2
            rounded = free & (np.arange(len(p)) != rest)
            up = [_carried(np.flatnonzero(rounded & (p == k)), count) for k in (0, 1)]
            pdf.loc[np.concatenate([*up, [rest] if rest >= 0 else []]).astype(int), "open"] = True
        return pdf

    return rows.groupBy("source", "grp").applyInPandas(run, rows.schema)


def mix(df: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 17, group: int = GROUP) -> DataFrame:
    """How often each document enters the mix.

    Returns one row a document: doc_id, size (words), source, source_size, target, copies and taken
    (copies times size). A source's taken words miss its target by less than half the size of its last
    fractional document; what is missed is then made smaller by flips of documents of its last level. Null texts and
    texts without words have size 0 and take 0 words; null sources are a source of their own, last in
    order; rows with the same id are rounded each for itself; an empty table gives no rows. The same
    rows give the same result whatever their order or partitioning, up to swaps between rows that are
    equal in id, size and source.
    """
    sized = df.select(F.col(id_).cast("long").alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"))
    return _mix(sized, ["doc_id"], weights, share, ceiling, seed, group)


def _mix(sized: DataFrame, key: list[str], weights: tuple[float, ...], share: float, ceiling: float, seed: int, group: int) -> DataFrame:
    """As mix() for rows (*key, size, source); rows that are equal in all of them are one another's stand-ins."""
    scratch = Scratch(sized.sparkSession, "mix")
    # Equal rows are counted and come back in chunks, so that however many there are they spread over groups.
    sized = scratch.save(sized.groupBy(*key, "size", "source").agg(F.count("*").alias("rows")), "sized")
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs"))
    goal = scratch.save(targets(per.drop("n_docs"), weights, share, ceiling).join(per.select(F.col("source").alias("s2"), "n_docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    side = small(goal.select(F.col("source").alias("s2"), "source_size", "target", "n_docs"))
    rows = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    rows = rows.withColumns({"rows": F.least(F.lit(CHUNK), F.col("rows") - CHUNK * F.col("chunk")).cast("long"), "tie": F.xxhash64(*key, "size", "chunk", F.lit(seed))})
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(mean + 1e-12).cast("long")).withColumn("p", F.greatest(mean - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("free", (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12))
    groups = F.greatest(F.ceil(F.col("n_docs") / group), F.lit(1)).cast("long")
    rows = rows.withColumns({"groups": groups, "grp": F.pmod("tie", groups), "open": F.lit(False)}).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "chunk", "n_docs", "i")
    level, done = rows.where("size > 0"), rows.where("size = 0")

    widest = (goal.agg(F.max("n_docs")).first()[0] or 0) / group
    depth = 0
    while True:
        level = scratch.save(_round_groups(level, seed + depth, group), f"level{depth}")
        done = done.unionByName(level.where("not open"))
        if widest <= 1:  # of the largest source; smaller ones are done
            break
        # Residuals of a source meet, `group` at a time.
        widest, depth = widest / group, depth + 1
        level = level.where("open").withColumns({"grp": F.floor(F.col("grp") / group), "groups": F.ceil(F.col("groups") / group), "open": F.lit(False)})
    copies = F.col("base") + F.round("p").cast("long")
    return done.select(*key, "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(df: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 17, group: int = GROUP) -> DataFrame:
    """The rows of ``df`` as often as mix() takes them; columns as they are.

    Every row has its own copies, whatever its id, also rows that share an id and those without one.
    Wholly equal rows have their copies together. Rows without words aren't taken unless a whole copy is.
    """
    a, b = unused(df, "ra"), unused(df, "rb")
    hashed = df.withColumns(dict(zip((a, b), row_hashes(df))))
    sized = hashed.select(F.col(a).alias("ra"), F.col(b).alias("rb"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"))
    got = _mix(sized, ["ra", "rb"], weights, share, ceiling, seed, group)
    n = unused(df, "copies")
    got = Scratch(df.sparkSession, "apply").save(got.groupBy(F.col("ra").alias(a), F.col("rb").alias(b)).agg(F.count("*").alias("rows"), F.sum("copies").alias(n)), "copies")
    repeated = small(got.where("rows > 1").select(a, b))
    once = hashed.join(repeated, [a, b], "left_anti").unionByName(hashed.join(repeated, [a, b], "left_semi").dropDuplicates([a, b]))
    out = once.join(got.drop("rows").where(F.col(n) > 0), [a, b])
    # In two steps, so that no array grows with the number of equal rows.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK)))
    chunk = unused(df, "chunk")
    out = out.withColumn(chunk, some).withColumn(chunk, F.explode(F.array_repeat(F.lit(0), F.least(F.lit(CHUNK), F.col(n) - CHUNK * F.col(chunk)).cast("int"))))
    return out.select(*df.columns)
