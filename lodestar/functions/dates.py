"""Dates: gaps, months and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_between(a: Column, b: Column) -> Column:
    """Calendar months from a to b: (y - y0) * 12 + (m - m0)."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def gap_days(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def year_quarter(d: Column) -> Column:
    return F.concat(F.year(d), F.lit("Q"), F.quarter(d))


def parse_created_at(s: Column) -> Column:
    """'Wed Oct 10 20:19:24 +0000 2018' -> timestamp; bad input null. The weekday is not looked at."""
    return F.try_to_timestamp(F.regexp_extract(s, r"^[A-Z][a-z]{2} (.*)$", 1), F.lit("MMM dd HH:mm:ss Z yyyy"))
