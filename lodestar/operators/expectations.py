"""Constraints of tables as checks: each gives a row (check, bad) or the offending rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break each check, all checks in one pass. As in SQL, a null condition breaks nothing."""
    one = df.agg(*[F.count_if(~c).alias(k) for k, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("bad")) for k in checks])))


def in_set(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(*values)


def in_range(column: str, lo, hi) -> Column:
    return F.col(column).between(lo, hi)


def not_null(*columns: str) -> dict[str, Column]:
    return {f"{c}_not_null": F.col(c).isNotNull() for c in columns}


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    return df.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti")


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)
