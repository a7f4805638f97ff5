"""Scalar helpers: lenient casts, guards, rounding, business days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r6_scaled(c: Column) -> Column:
    """Six decimals by way of the product with 10^6, as DuckDB rounds. ``r6`` rounds the number's decimal digits: a difference that should end in
    a 5 at the seventh decimal, but lies an ulp below, then goes the other way."""
    return F.round(c * 1e6) / 1e6


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def lenient_double(c: Column) -> Column:
    """Number or null; '.' and other text give null."""
    return c.try_cast("double")


def lenient_date(c: Column) -> Column:
    return c.try_cast("date")


def clip(c: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        c = F.when(c < low, F.lit(low)).otherwise(c)
    return F.when(c > high, F.lit(high)).otherwise(c) if high is not None else c


def masked(mask: Column, new: Column, old: Column) -> Column:
    """new where mask holds, else old (a null mask keeps old)."""
    return F.when(mask, new).otherwise(old)


def onehot(c: Column, levels: list[str], prefix: str, drop_first: bool = False) -> list[Column]:
    return [F.when(c == v, 1).otherwise(0).alias(f"{prefix}{v}") for v in levels[int(drop_first) :]]


def interactions(features: list[str], by: list[str]) -> list[Column]:
    return [(F.col(f) * F.col(b)).alias(f"{f}_x_{b}") for f in features for b in by]


def priority(*tagged: tuple[Column, str]) -> tuple[Column, Column]:
    """(first value that is not null, its tag)."""
    return F.coalesce(*[c for c, _ in tagged]), reduce(lambda acc, t: F.when(t[0].isNotNull(), t[1]).otherwise(acc), reversed(tagged), F.lit(None).cast("string"))


def business_days_before(d: Column, n: int) -> Column:
    """The n-th weekday before a date (weekends skipped, holidays not); a weekend counts as the Saturday after its week."""
    wd = F.least(F.weekday(d), F.lit(5))  # Monday 0 .. Friday 4, weekend 5
    back = F.when(F.weekday(d) == 6, 1).otherwise(0)  # Sunday as Saturday
    need = n - wd
    weeks = F.when(need > 0, F.ceil(need / 5)).otherwise(0)
    return F.date_sub(d, (back + n + 2 * weeks).cast("int"))


def snap(c: Column, grid: float) -> Column:
    """Half-even rounding to a grid, as Python rounds."""
    return F.bround(c / grid) * grid


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def url_key(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 16)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas, where common subexpressions are not shared."""
    return F.transform(F.array(value), body)[0]
