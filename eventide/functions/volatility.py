"""Range and return volatility estimators and implied-variance algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 252


def parkinson(h: Column, low: Column) -> Column:
    """Daily variance from the range; null unless 0 < low <= high."""
    return F.when((low > 0) & (h >= low), F.pow(F.ln(h / low), 2) / (4 * math.log(2)))


def garman_klass(o: Column, h: Column, low: Column, c: Column, floor: bool = False) -> Column:
    """Daily variance from open, high, low and close; null on invalid bars, floored at 0 on demand."""
    ok = (o > 0) & (low > 0) & (c > 0) & (h >= low)
    v = 0.5 * F.pow(F.ln(h / low), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(c / o), 2)
    return F.when(ok, F.greatest(v, F.lit(0.0)) if floor else v)


def annualise(var: Column) -> Column:
    """Percent a year; null where the variance is not positive."""
    return F.when(var > 0, F.sqrt(YEAR * var) * 100)


def log_return(p: Column, before: Column) -> Column:
    return F.when((p > 0) & (before > 0), F.ln(p / before))


def strip_index_vol(pre: Column, post: Column) -> Column:
    """Event volatility from an index before and after: sqrt(30 * (pre^2 - post^2)) where positive, else pre."""
    v = (pre * pre - post * post) * (30 / YEAR) * YEAR
    return F.when(v > 0, F.sqrt(v)).otherwise(pre)


def kink(iv_pre: Column, t_pre: Column, iv_post: Column, t_post: Column) -> tuple[Column, Column]:
    """(event variance, event volatility in percent) from two expiries; times in days over 365.25."""
    a, b = t_pre / 365.25, t_post / 365.25
    var = iv_post * iv_post * b - iv_pre * iv_pre * a
    vol = F.sqrt(F.greatest(F.lit(0.0), var) / F.greatest(b - a, F.lit(1 / 365.25))) * 100
    return var, vol


def horizon_scale(iv: Column, t: Column) -> Column:
    return iv * F.sqrt(t)


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))
