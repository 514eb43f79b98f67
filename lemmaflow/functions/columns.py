"""Small builders for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(c: Column, digits: int = 4) -> Column:
    """Rounded with halves towards plus infinity."""
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)
