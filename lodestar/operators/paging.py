"""Order, limits and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for "no date", older than any.
OLDEST = "0001-01-01"


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns: one partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def keyset_page(df: DataFrame, key: str, id_: str, size: int, after: tuple | None = None, where: dict | None = None) -> DataFrame:
    """One page by (date key, id) descending, null keys oldest; has_more tells whether rows follow.

    ``after`` is the (key, id) of the last row seen; ``where`` holds optional equality filters. Spark
    keeps size + 1 rows a task and never sorts the table.
    """
    for c, v in (where or {}).items():
        if v is not None:
            df = df.where(F.col(c) == v)
    df = df.withColumn("sort_key", F.coalesce(key, F.lit(OLDEST).cast("date")))
    if after:
        k, i = after[0] or OLDEST, after[1]
        k = F.lit(str(k)).cast("date")
        df = df.where((F.col("sort_key") < k) | ((F.col("sort_key") == k) & (F.col(id_) < i)))
    some = df.orderBy(F.desc("sort_key"), F.desc(id_)).limit(size + 1)
    n = some.agg((F.count("*") > size).alias("has_more"))
    return some.crossJoin(F.broadcast(n)).orderBy(F.desc("sort_key"), F.desc(id_)).limit(size)


def top(df: DataFrame, by: Sequence, k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)
