"""Closed-form option pricing: Bachelier and Black-76, with a polynomial normal distribution.

The coefficients are the published Abramowitz-Stegun 7.1.26 values (absolute error about 1e-7).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.scalar import let

# Abramowitz and Stegun, formula 7.1.26.
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + _P * z)
    return 0.5 * (1 + F.signum(x) * (1 - _horner(t) * F.exp(-z * z)))


def bound_cdf(x: Column) -> Column:
    """norm_cdf for use inside lambdas: the argument and the polynomial's variable are computed once."""

    def tail(v: Column) -> Column:
        return let(1 / (1 + _P * F.abs(v) / math.sqrt(2)), lambda t: 0.5 * (1 + F.signum(v) * (1 - _horner(t) * F.exp(-v * v / 2))))

    return let(x, tail)


def _horner(t: Column) -> Column:
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    return poly


def bound_black76(f: Column, k: Column, t: Column, sigma: Column) -> Column:
    """struct<straddle, delta> of an undiscounted Black-76 straddle, for use inside lambdas."""
    live = (t > 0) & (sigma > 0)

    def priced(s: Column) -> Column:
        return let((F.ln(f / k) + s * s / 2) / s, lambda d1: let(F.struct(bound_cdf(d1).alias("a"), bound_cdf(d1 - s).alias("b")), lambda n: F.struct((2 * (f * n["a"] - k * n["b"]) - (f - k)).alias("straddle"), (2 * n["a"] - 1).alias("delta"))))

    return F.when(live, let(sigma * F.sqrt(F.greatest(t, F.lit(0.0))), priced)).otherwise(F.struct(F.abs(f - k).alias("straddle"), F.signum(f - k).alias("delta")))


def bachelier(f: Column, k: Column, t: Column, sigma: Column) -> dict[str, Column]:
    """Call and put with delta, gamma, vega and theta of the call; intrinsic value at or past expiry."""
    live = (t > 0) & (sigma > 0)
    s = sigma * F.sqrt(F.greatest(t, F.lit(0.0)))
    d = F.when(live, (f - k) / F.nullif(s, F.lit(0.0)))
    call = F.when(live, (f - k) * norm_cdf(d) + s * norm_pdf(d)).otherwise(F.greatest(f - k, F.lit(0.0)))
    put = F.when(live, call - (f - k)).otherwise(F.greatest(k - f, F.lit(0.0)))
    return {
        "call": call,
        "put": put,
        "delta": F.when(live, norm_cdf(d)).otherwise(F.when(f > k, 1.0).otherwise(0.0)),
        "gamma": F.when(live, norm_pdf(d) / F.nullif(s, F.lit(0.0))).otherwise(0.0),
        "vega": F.when(live, F.sqrt(F.greatest(t, F.lit(0.0))) * norm_pdf(d)).otherwise(0.0),
        "theta": F.when(live, -sigma * norm_pdf(d) / (2 * F.sqrt(F.greatest(t, F.lit(1e-300))))).otherwise(0.0),
    }


def d1_d2(f: Column, k: Column, t: Column, sigma: Column) -> tuple[Column, Column]:
    """Black-76 arguments, both 0 where any input is degenerate."""
    ok = (f > 0) & (k > 0) & (t > 0) & (sigma > 0)
    s = sigma * F.sqrt(F.greatest(t, F.lit(0.0)))
    d1 = F.when(ok, (F.ln(f / k) + sigma * sigma * t / 2) / F.nullif(s, F.lit(0.0))).otherwise(0.0)
    return d1, F.when(ok, d1 - s).otherwise(0.0)


def black76(f: Column, k: Column, t: Column, sigma: Column, r: float = 0.0) -> dict[str, Column]:
    """Call, put by parity, straddle, and the straddle's delta and gamma."""
    live = (t > 0) & (sigma > 0)
    d1, d2 = d1_d2(f, k, t, sigma)
    df = F.exp(-F.lit(float(r)) * t)
    call = F.when(live, df * (f * norm_cdf(d1) - k * norm_cdf(d2))).otherwise(F.greatest(f - k, F.lit(0.0)))
    put = F.when(live, call - df * (f - k)).otherwise(F.greatest(k - f, F.lit(0.0)))
    s = sigma * F.sqrt(F.greatest(t, F.lit(0.0)))
    return {"call": call, "put": put, "straddle": call + put, "delta": F.when(live, df * (2 * norm_cdf(d1) - 1)).otherwise(F.signum(f - k)), "gamma": F.when(live, 2 * df * norm_pdf(d1) / F.nullif(f * s, F.lit(0.0))).otherwise(0.0)}


def with_black76(df: DataFrame, f: str, k: str, t: str, sigma: str, r: float = 0.0) -> DataFrame:
    """``df`` with the columns of ``black76``, in steps: each step's values are columns, so no polynomial is written out twice."""
    d1, d2 = d1_d2(F.col(f), F.col(k), F.col(t), F.col(sigma))
    x = df.withColumn("_d1", d1).withColumn("_d2", F.when((F.col(f) > 0) & (F.col(k) > 0) & (F.col(t) > 0) & (F.col(sigma) > 0), F.col("_d1") - F.col(sigma) * F.sqrt(F.greatest(t, F.lit(0.0)))).otherwise(0.0))
    x = x.withColumns({"_t1": 1 / (1 + _P * F.abs("_d1") / math.sqrt(2)), "_t2": 1 / (1 + _P * F.abs("_d2") / math.sqrt(2)), "_df": F.exp(-F.lit(float(r)) * F.col(t))})
    cdf = lambda i: 0.5 * (1 + F.signum(f"_d{i}") * (1 - _horner(F.col(f"_t{i}")) * F.exp(-F.col(f"_d{i}") * F.col(f"_d{i}") / 2)))
    x = x.withColumns({"_n1": cdf(1), "_n2": cdf(2)})
    live = (F.col(t) > 0) & (F.col(sigma) > 0)
    x = x.withColumn("call", F.when(live, F.col("_df") * (F.col(f) * F.col("_n1") - F.col(k) * F.col("_n2"))).otherwise(F.greatest(F.col(f) - F.col(k), F.lit(0.0))))
    x = x.withColumn("put", F.when(live, F.col("call") - F.col("_df") * (F.col(f) - F.col(k))).otherwise(F.greatest(F.col(k) - F.col(f), F.lit(0.0))))
    spread = F.col(sigma) * F.sqrt(F.greatest(t, F.lit(0.0)))
    x = x.withColumns({
        "straddle": F.col("call") + F.col("put"),
        "delta": F.when(live, F.col("_df") * (2 * F.col("_n1") - 1)).otherwise(F.signum(F.col(f) - F.col(k))),
        "gamma": F.when(live, 2 * F.col("_df") * norm_pdf(F.col("_d1")) / F.nullif(F.col(f) * spread, F.lit(0.0))).otherwise(0.0),
    })
    return x.drop("_d1", "_d2", "_t1", "_t2", "_df", "_n1", "_n2")


def atm_straddle(f: Column, t: Column, sigma: Column) -> Column:
    """Black-76 straddle at the money: 2 F (2 N(sigma sqrt(t) / 2) - 1)."""
    return 2 * f * (2 * norm_cdf(sigma * F.sqrt(t) / 2) - 1)


def bisect(price: Column, low: float, high: float, value, steps: int = 60) -> Column:
    """Root of value(x) = price by ``steps`` halvings of [low, high]; ``value`` is increasing."""
    start = F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["a"] + acc["b"]) / 2
        up = value(mid) < price
        return F.struct(F.when(up, mid).otherwise(acc["a"]).alias("a"), F.when(up, acc["b"]).otherwise(mid).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: (acc["a"] + acc["b"]) / 2)


def yield_vol_from_price_vol(points: Column, dv01_points: Column) -> Column:
    return points / dv01_points


def price_vol_from_yield_vol(bps: Column, dv01_points: Column) -> Column:
    return bps * dv01_points


def event_share(sigma_event: Column, sigma_day: Column, calendar_days: Column) -> Column:
    """Share of the variance to expiry that falls on the event day; trading days are calendar days times 5/7, at least 1."""
    days = F.greatest(F.lit(1), F.floor(calendar_days * 5 / 7)).cast("double")
    total = sigma_event * sigma_event + (days - 1) * sigma_day * sigma_day
    return sigma_event * sigma_event / F.nullif(total, F.lit(0.0))


def quiet_sigma(iv: Column, t_years: Column, auction_sd: Column, event_sd: Column, n_quiet: Column, n_auction: int = 2, n_event: int = 1) -> Column:
    """Volatility of quiet days so that quiet, auction and event variances add up to iv^2 t; half of iv where nothing is left."""
    left = iv * iv * t_years - auction_sd * auction_sd * n_auction / 252 - event_sd * event_sd * n_event / 252
    return F.when((left > 0) & (n_quiet > 0), F.sqrt(F.greatest(left, F.lit(0.0)) * 252 / F.nullif(n_quiet, F.lit(0)))).otherwise(F.greatest(F.lit(0.001), iv * 0.5))


def signal_multiplier(z: Column, kappa: float, long_leg: bool) -> Column:
    up = F.greatest(F.lit(0.0), z)
    return 1 + kappa * up if long_leg else F.greatest(F.lit(0.01), 1 - kappa * up)
