"""Units, realised and implied curves, gaps and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import volatility as V


def detect_units(df: DataFrame, x: str, cap: float) -> DataFrame:
    """Scale by the median over all cells (over 100: to percent; under 1: from fractions), then null cells over ``cap``."""
    median = F.broadcast(df.agg(F.percentile(x, F.lit(0.5)).alias("_median")))
    scaled = df.crossJoin(median).withColumn(x, F.col(x) * F.when(F.col("_median") > 100, 0.01).when(F.col("_median") < 1, 100.0).otherwise(1.0))
    return scaled.withColumn("nulled", F.coalesce(F.col(x) > cap, F.lit(False))).withColumn(x, F.when(F.col(x) <= cap, F.col(x))).drop("_median")


def vrp(implied: DataFrame, realised: DataFrame, on: list[str]) -> DataFrame:
    """vrp_iv_minus_rv, ratio and underpriced flag of the rows both sides have."""
    both = implied.join(realised, on)
    return both.withColumns({"vrp_iv_minus_rv": F.col("iv") - F.col("rv"), "ratio": F.col("rv") / F.nullif(F.col("iv"), F.lit(0.0)), "underpriced": F.col("rv") > F.col("iv")})


def range_curve(bars: DataFrame, floor: bool = False) -> DataFrame:
    """Daily Parkinson and Garman-Klass variances with their annualised volatilities."""
    gk = V.garman_klass(F.col("o"), F.col("h"), F.col("l"), F.col("c"), floor)
    out = bars.withColumn("park_var", V.parkinson(F.col("h"), F.col("l"))).withColumn("gk_var", gk)
    return out.withColumn("park_vol", V.annualise(F.col("park_var"))).withColumn("gk_vol", V.annualise(F.col("gk_var")))


def front_minus_back(gaps: DataFrame, on: str, leg: str, front: str, back: str, x: str) -> DataFrame:
    """Spread of one leg over another by a pivot with named legs; null where a leg is missing."""
    wide = gaps.groupBy(on).pivot(leg, [front, back]).agg(F.first(x))
    return wide.select(on, F.col(front).alias("front"), F.col(back).alias("back"), (F.col(front) - F.col(back)).alias("gap_spread"), (F.col(front).isNotNull() & F.col(back).isNotNull()).alias("has_both"))
