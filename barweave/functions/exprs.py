"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from barweave.schemas import RISK_FREE, TRADING_DAYS


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def full_frame(agg: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """A rolling value that is NULL until all n rows of the frame hold a value."""
    return F.when(F.count(counted).over(w) == n, agg.over(w))


def annual_return(total: Column, n: Column, days: int = TRADING_DAYS) -> Column:
    return F.pow(1.0 + total, F.lit(float(days)) / n) - 1.0


def sharpe(annual: Column, vol: Column, rf: float = RISK_FREE) -> Column:
    return ratio_or_zero(annual - rf, vol)


def annualised(std: Column, days: int = TRADING_DAYS) -> Column:
    return std * math.sqrt(days)
