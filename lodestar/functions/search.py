"""Binary search in a sorted list, as a Column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cuts_below(value: Column, cuts: Sequence, inclusive: bool = True) -> Column:
    """How many of the ascending cuts are at or below the value (below it, if not inclusive); 0 for null."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    at = F.array(*[F.lit(c) for c in cuts])

    def step(low: Column, n: Column) -> Column:
        cut = F.get(at, low + n - 1)
        return F.when(cut <= value if inclusive else cut < value, low + n).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
