"""Macro regimes: label cascade, policy direction, overrides, direction features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dual_mandate(inflation_gap: Column, u_gap: Column) -> Column:
    """Label cascade: overheating, supply_shock, slack, easing, at_target; missing inputs fall through to at_target."""
    hot = inflation_gap > 0.5
    return F.when(hot & (u_gap < 0), "overheating").when(hot & (u_gap >= 0), "supply_shock").when(u_gap > 0.75, "slack").when(inflation_gap < -0.5, "easing").otherwise("at_target")


def override(df: DataFrame, dates: DataFrame, at: str, label: str, value: str) -> DataFrame:
    """Rows whose date is listed get ``value`` and a flag; the list is small configuration."""
    x = df.join(F.broadcast(dates.select(F.col(at), F.lit(True).alias("_hit")).distinct()), at, "left")
    return x.withColumn("overridden", F.coalesce("_hit", F.lit(False))).withColumn(label, F.when(F.col("_hit"), value).otherwise(F.col(label))).drop("_hit")


def direction_features(df: DataFrame, by: str, at: str, inf: str, u: str) -> DataFrame:
    """First differences of both gaps, distance from the origin, its change, and a sign product."""
    w = Window.partitionBy(by).orderBy(at)
    d = lambda c: F.col(c) - F.lag(c).over(w)
    x = df.withColumns({"d_inf": d(inf), "d_u": d(u), "dist": F.sqrt(F.col(inf) * F.col(inf) + F.col(u) * F.col(u))})
    return x.withColumn("accel", F.col("dist") - F.lag("dist").over(w)).withColumn("same_way", F.signum("d_inf") * F.signum("d_u"))
