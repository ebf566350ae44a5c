"""Clamp, rounding and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.fixed_values import CLAMP_HIGH, CLAMP_LOW


def clamp(c: Column, low: float = CLAMP_LOW, high: float = CLAMP_HIGH) -> Column:
    """``c`` limited to [low, high]; null and NaN pass through (``least``/``greatest`` would not)."""
    return F.when(c.isNull() | F.isnan(c), c).when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded without a negative zero, so equal numbers have equal texts and hashes."""
    return F.round(c, digits) + F.lit(0.0)


def value_text(c: Column, is_integer: bool = False) -> Column:
    """Display text of a feature value: integers plain, other numbers with 4 decimals."""
    return c.cast("bigint").cast("string") if is_integer else F.format_string("%.4f", c)


def signed_text(c: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", c)


def sign_class(c: Column) -> Column:
    return F.when(c >= 0, F.lit("pos")).otherwise(F.lit("neg"))
