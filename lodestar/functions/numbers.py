"""Arithmetic that the session's ANSI mode would stop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """a / b in doubles as IEEE 754 has it: by zero an infinity, 0 / 0 not a number; null only where a side is."""
    a, b = a.cast("double"), b.cast("double")
    # A power keeps the sign of a zero and never raises an error.
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)
