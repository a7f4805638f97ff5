"""Statistics as Columns: intervals, distributions without a special-function library, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z90 = 1.645


def wilson(k: Column, n: Column, z: float = Z90, empty: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Wilson interval of a share; ``empty`` is what n = 0 gives (two conventions exist: (0, 1) and (0, 0))."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / d
    half = z / d * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n * n, F.lit(0))))
    none = n == 0
    return F.when(none, empty[0]).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, empty[1]).otherwise(F.least(F.lit(1.0), mid + half))


def corr_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation."""
    return r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))


def student_t_two_sided(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p of Student's t by Simpson's rule over the angle atan(t / sqrt(df)): the density is cos^(df - 1)."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    power = df - 1
    h = lambda top: top / steps
    f = lambda a: F.pow(F.cos(a), power)

    def simpson(top: Column) -> Column:
        step = h(top)
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda acc, i: acc + F.when(i % 2 == 1, 4.0).otherwise(2.0) * f(i * step))
        return (f(F.lit(0.0)) + inner + f(top)) * step / 3

    return F.greatest(F.lit(0.0), 1 - simpson(theta) / simpson(F.lit(math.pi / 2)))


def verdict(low: Column, win: Column, weak: float = 0.65) -> Column:
    return F.when(low > 0, "PASS").when(win > weak, "WEAK").otherwise("FLAG")
