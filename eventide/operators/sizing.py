"""Payoffs, stops and position sizes from observed moves: every row comes from a table of prices, none is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.ranges import bounded, lookup


def moves(series: DataFrame, by: str, at: str, x: str) -> DataFrame:
    """Absolute change of each key's series since its row before, and the key's mean of it (``fair``): by, at, jump, fair."""
    jump = bounded(series.select(by, at, x), by, at, 1, lambda w: {"jump": F.abs(F.col(x) - F.lag(x).over(w))}).where("jump IS NOT NULL")
    return lookup(jump, jump.groupBy(by).agg(F.avg("jump").alias("fair")), [by]).drop(x)


def straddle_payoffs(moves: DataFrame, by: str, at: str, bought: str, sold: str) -> DataFrame:
    """at, front, back, net: what a straddle of one key, bought at its fair move, and one of another, sold at it, gain in each period that both have."""
    gain = F.col("jump") - F.col("fair")
    leg = lambda key, v: F.max(F.when(F.col(by) == key, v))
    both = moves.where(F.col(by).isin(bought, sold)).groupBy(at).agg(leg(bought, gain).alias("front"), leg(sold, -gain).alias("back"))
    return both.where("front IS NOT NULL AND back IS NOT NULL").withColumn("net", F.col("front") + F.col("back"))


def slippage(paths: DataFrame, path: str, day: str, legs: list[str], base: float, speed: float, lookback: int) -> DataFrame:
    """Adds slip: ``base`` for each leg and ``speed`` times its mean absolute change a day over the last days, fewer at a path's start."""
    def make(w):
        n = F.least(F.row_number().over(w) - 1, F.lit(lookback))
        back = lambda c: F.coalesce(F.lag(c, lookback).over(w), F.first(c).over(w.rowsBetween(-lookback, 0)))
        return {"slip": sum((base + speed * F.coalesce(F.abs(F.col(c) - back(c)) / F.nullif(n, F.lit(0)), F.lit(0.0)) for c in legs), F.lit(0.0))}

    return bounded(paths, path, day, lookback, make)


def first_stop(paths: DataFrame, path: str, day: str, pnl: str, levels: list[float]) -> DataFrame:
    """(level, path, stopped, day, pnl): the first day a path has lost ``level``, with the result there after slippage, or its last day's result."""
    x = paths.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    hit = F.when(F.col(pnl) <= -F.col("level"), F.struct(F.col(day).alias("day"), (F.col(pnl) - F.col("slip")).alias("v")))
    g = x.groupBy("level", path).agg(F.min(hit).alias("s"), F.max_by(pnl, day).alias("end"))
    return g.select("level", path, F.col("s").isNotNull().alias("stopped"), F.col("s.day").alias("day"), F.coalesce("s.v", "end").alias("pnl"))


def kelly_var(stats: DataFrame, cap: float, budget: float) -> DataFrame:
    """Share of wealth by Kelly's rule for small gains, within 0 and ``cap``, lots by a loss budget over the 1 % quantile, and whole lots: at least one, half to even."""
    kelly = F.least(F.greatest(F.col("mu") / F.nullif(F.col("sd") * F.col("sd"), F.lit(0.0)), F.lit(0.0)), F.lit(cap))
    by_loss: Column = F.when(F.col("q01") < 0, budget / -F.col("q01"))
    return stats.withColumns({"kelly_f": kelly, "var_lots": by_loss, "final_lots": F.greatest(F.lit(1.0), F.bround(F.coalesce(by_loss * kelly / cap, F.lit(1.0)))).cast("long")})
