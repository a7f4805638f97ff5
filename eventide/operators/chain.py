"""Option chains: at-the-money volatilities of the expiries around an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def atm_bracket(chain: DataFrame, event: str, spot: float | str, min_oi: int = 5, weekly_days: int = 10) -> DataFrame:
    """Per event: volatilities of the last expiry before and the first on or after it, nearest strike, call and put averaged."""
    ok = chain.where((F.col("iv") > 0.0005) & (F.col("iv") < 5) & (F.col("oi") >= min_oi))
    sides = ok.groupBy(event).agg(F.max(F.when(F.col("expiry") < F.col(event), F.col("expiry"))).alias("pre"), F.min(F.when(F.col("expiry") >= F.col(event), F.col("expiry"))).alias("post"))
    x = ok.join(sides, event).where((F.col("expiry") == F.col("pre")) | (F.col("expiry") == F.col("post")))
    x = x.withColumn("side", F.when(F.col("expiry") == F.col("pre"), "pre").otherwise("post")).withColumn("weekly", F.date_diff("post", "pre") <= weekly_days)
    at = F.col(spot) if isinstance(spot, str) else F.lit(spot)
    near = Window.partitionBy(event, "side", "typ").orderBy(F.abs(F.col("strike") - at), "p_partkey")
    atm = x.withColumn("rn", F.row_number().over(near)).where("rn = 1")
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("iv")))
    return atm.groupBy(event).agg(F.first("weekly").alias("weekly"), side("pre").alias("iv_pre"), side("post").alias("iv_post"))
