"""Signals, option pricing, tickets, P&L and simulation."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import calendar, panel, series, sql, table
from eventide.catalog import register
from eventide.functions import options as O
from eventide.functions.scalar import r6
from eventide.operators import sizing as Z
from eventide.operators import windows as W

# ---- SQL fragments -----------------------------------------------------------------------------------


def cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    return f"(0.5 * (1 + sign({x}) * (1 - {_poly(t)} * exp(-({x}) * ({x}) / 2))))"


def _poly(t: str) -> str:
    out = "0.0"
    for a in ("1.061405429", "-1.453152027", "1.421413741", "-0.284496736", "0.254829592"):
        out = f"(({out} + {a}) * {t})"
    return out


def pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


_Q = "q AS (SELECT p_partkey AS k, 100 + p_size / 10.0 AS f, 100 + (p_partkey % 21 - 10) / 2.0 AS x, (p_partkey % 9) / 12.0 AS t, CAST(p_size % 13 AS DOUBLE) AS s, (p_size % 13) / 50.0 AS v FROM part)"


def quotes(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    return p.select(key.alias("k"), (100 + F.col("p_size") / 10.0).alias("f"), (100 + (key % 21 - 10) / 2.0).alias("x"), (key % 9 / 12.0).alias("t"), (F.col("p_size") % 13).cast("double").alias("s"), (F.col("p_size") % 13 / 50.0).alias("v"))



@register("opt_norm_cdf", f"SELECT k, round({cdf('z')}, 6) AS cdf FROM (SELECT p_partkey AS k, (p_partkey % 81 - 40) / 10.0 AS z FROM part)")
def _(spark, d):
    z = (F.col("p_partkey") % 81 - 40) / 10.0
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), r6(O.norm_cdf(z)).alias("cdf"))


_LIVE = "t > 0 AND s > 0"
_BD = f"b AS (SELECT *, s * sqrt(t) AS w, CASE WHEN {_LIVE} THEN (f - x) / (s * sqrt(t)) END AS z FROM q), c AS (SELECT *, CASE WHEN {_LIVE} THEN (f - x) * {cdf('z')} + w * {pdf('z')} ELSE greatest(f - x, 0) END AS call FROM b)"


@register("opt_bachelier", f"WITH {_Q}, {_BD} SELECT k, round(call, 6) + 0 AS call, round(CASE WHEN {_LIVE} THEN call - (f - x) ELSE greatest(x - f, 0) END, 6) + 0 AS put, round(CASE WHEN {_LIVE} THEN {cdf('z')} WHEN f > x THEN 1 ELSE 0 END, 6) AS delta, round(CASE WHEN {_LIVE} THEN {pdf('z')} / w ELSE 0 END, 6) AS gamma, round(CASE WHEN {_LIVE} THEN sqrt(t) * {pdf('z')} ELSE 0 END, 6) AS vega, round(CASE WHEN {_LIVE} THEN -s * {pdf('z')} / (2 * sqrt(t)) ELSE 0 END, 6) + 0 AS theta FROM c")
def _(spark, d):
    b = O.bachelier(F.col("f"), F.col("x"), F.col("t"), F.col("s"))
    return quotes(spark, d).select("k", *[r6(b[n]).alias(n) for n in ("call", "put", "delta", "gamma", "vega", "theta")])


_OKV = "f > 0 AND x > 0 AND t > 0 AND v > 0"
_D12 = f"b AS (SELECT *, CASE WHEN {_OKV} THEN (ln(f / x) + v * v * t / 2) / (v * sqrt(t)) ELSE 0 END AS d1 FROM q), e AS (SELECT *, CASE WHEN {_OKV} THEN d1 - v * sqrt(t) ELSE 0 END AS d2 FROM b)"


@register("vol_b76_d1d2", f"WITH {_Q}, {_D12} SELECT k, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM e")
def _(spark, d):
    d1, d2 = O.d1_d2(F.col("f"), F.col("x"), F.col("t"), F.col("v"))
    return quotes(spark, d).select("k", r6(d1).alias("d1"), r6(d2).alias("d2"))


@register("opt_black76", f"WITH {_Q}, {_D12}, c AS (SELECT *, t > 0 AND v > 0 AS live, exp(-0.03 * t) AS df, CASE WHEN t > 0 AND v > 0 THEN exp(-0.03 * t) * (f * {cdf('d1')} - x * {cdf('d2')}) ELSE greatest(f - x, 0) END AS call FROM e) SELECT k, round(call, 6) AS call, round(CASE WHEN live THEN call - df * (f - x) ELSE greatest(x - f, 0) END, 6) + 0 AS put, round(CASE WHEN live THEN df * (2 * {cdf('d1')} - 1) ELSE sign(f - x) END, 6) AS delta, round(CASE WHEN live THEN 2 * df * {pdf('d1')} / (f * v * sqrt(t)) ELSE 0 END, 6) AS gamma FROM c")
def _(spark, d):
    b = O.with_black76(quotes(spark, d), "f", "x", "t", "v", r=0.03)
    return b.select("k", *[r6(n).alias(n) for n in ("call", "put", "delta", "gamma")])


@register("opt_implied", f"WITH {_Q} SELECT k, round(v, 4) AS iv FROM q WHERE t > 0 AND v > 0")
def _(spark, d):
    """Inverting a priced at-the-money straddle gives its volatility back."""
    q = quotes(spark, d).where("t > 0 AND v > 0")
    price = O.atm_straddle(F.col("f"), F.col("t"), F.col("v"))
    return q.select("k", F.round(O.bisect(price, 1e-6, 5.0, lambda s: O.atm_straddle(F.col("f"), F.col("t"), s)), 4).alias("iv"))


@register("opt_units", f"WITH {_Q} SELECT k, round(s / (f / 1000), 6) AS bps, round(s * (f / 1000), 6) AS pts, round(s * sqrt(252) * f / 10000, 6) AS sigma_n, round(v * 100 / sqrt(252), 6) AS bp_day FROM q")
def _(spark, d):
    dv = F.col("f") / 1000
    return quotes(spark, d).select("k", r6(O.yield_vol_from_price_vol(F.col("s"), dv)).alias("bps"), r6(O.price_vol_from_yield_vol(F.col("s"), dv)).alias("pts"), r6(F.col("s") * math.sqrt(252) * F.col("f") / 10_000).alias("sigma_n"), r6(F.col("v") * 100 / math.sqrt(252)).alias("bp_day"))


@register("opt_event_ratio", f"WITH {_Q}, z AS (SELECT k, s AS e, v * 10 AS dd, greatest(1, floor((k % 40) * 5 / 7.0)) AS n FROM q) SELECT k, round(e * e / nullif(e * e + (n - 1) * dd * dd, 0), 6) AS share FROM z")
def _(spark, d):
    return quotes(spark, d).select("k", r6(O.event_share(F.col("s"), F.col("v") * 10, F.col("k") % 40)).alias("share"))


@register("opt_quiet_calib", f"WITH {_Q}, z AS (SELECT k, v, t, v * v * t - 0.11 * 0.11 * 2 / 252 - 0.2 * 0.2 / 252 AS r, k % 9 AS n FROM q) SELECT k, round(CASE WHEN r > 0 AND n > 0 THEN sqrt(r * 252 / n) ELSE greatest(0.001, v * 0.5) END, 6) AS quiet FROM z")
def _(spark, d):
    return quotes(spark, d).select("k", r6(O.quiet_sigma(F.col("v"), F.col("t"), F.lit(0.11), F.lit(0.2), F.col("k") % 9)).alias("quiet"))


@register("opt_fomc_sigma", f"WITH {_Q} SELECT k, round(v * (1 + 0.5 * greatest(0, s - 6)), 6) AS long_sigma, round(v * greatest(0.01, 1 - 0.5 * greatest(0, s - 6)), 6) AS short_sigma FROM q")
def _(spark, d):
    z = F.col("s") - 6
    return quotes(spark, d).select("k", r6(F.col("v") * O.signal_multiplier(z, 0.5, True)).alias("long_sigma"), r6(F.col("v") * O.signal_multiplier(z, 0.5, False)).alias("short_sigma"))


_TK = f"WITH {_Q}, {_BD}, g AS (SELECT k, t, 2 * call - (f - x) AS price, 2 * sqrt(t) * {pdf('z')} AS vega, 2 * {pdf('z')} / w AS gamma, 2 * -s * {pdf('z')} / (2 * sqrt(t)) AS theta, 1000000.0 * (1 + k % 50) AS n, 190.0 + k % 7 AS dv FROM c WHERE {_LIVE})"


def legs(spark, d):
    q = quotes(spark, d).where("t > 0 AND s > 0")
    b = O.bachelier(F.col("f"), F.col("x"), F.col("t"), F.col("s"))
    return q.select("k", "t", (b["call"] + b["put"]).alias("price"), (2 * b["vega"]).alias("vega"), (2 * b["gamma"]).alias("gamma"), (2 * b["theta"]).alias("theta"), (1000000.0 * (1 + F.col("k") % 50)).alias("n"), (190.0 + F.col("k") % 7).alias("dv"))


@register("tkt_leg", f"{_TK} SELECT k, round(price * 0.01 * n, 2) AS premium_usd, round(vega * dv * n / 1e6, 4) AS yield_vega_usd, round(gamma * 0.01 * n, 2) AS dollar_gamma, round(theta * 0.01 * n / 252, 2) + 0 AS dollar_theta_day, CAST(round_even(n / 200000.0, 0) AS BIGINT) AS contracts FROM g")
def _(spark, d):
    n, pv = F.col("n"), 0.01 * F.col("n")
    return legs(spark, d).select("k", F.round(F.col("price") * pv, 2).alias("premium_usd"), F.round(F.col("vega") * F.col("dv") * n / 1e6, 4).alias("yield_vega_usd"), F.round(F.col("gamma") * pv, 2).alias("dollar_gamma"), F.round(F.col("theta") * pv / 252, 2).alias("dollar_theta_day"), F.bround(n / 200000.0).cast("long").alias("contracts"))


@register("tkt_vega_neutral", f"{_TK} SELECT a.k, round(b.n * b.vega * b.dv / (a.vega * a.dv), 2) AS vega_neutral, round(b.n * b.gamma / a.gamma, 2) AS gamma_neutral FROM g a JOIN g b ON b.k = a.k + 1")
def _(spark, d):
    a = legs(spark, d)
    b = a.select((F.col("k") - 1).alias("k"), *[F.col(c).alias(f"b_{c}") for c in ("n", "vega", "dv", "gamma")])
    return a.join(b, "k").select("k", F.round(F.col("b_n") * F.col("b_vega") * F.col("b_dv") / (F.col("vega") * F.col("dv")), 2).alias("vega_neutral"), F.round(F.col("b_n") * F.col("b_gamma") / F.col("gamma"), 2).alias("gamma_neutral"))


@register("tkt_compute", f"{_TK}, p AS (SELECT a.k, b.n * b.vega * b.dv / (a.vega * a.dv) AS nf, a.vega AS va, a.dv AS da, a.price AS pa, b.n AS nb, b.vega AS vb, b.dv AS db, b.price AS pb FROM g a JOIN g b ON b.k = a.k + 1) SELECT k, round(pa * 0.01 * nf - pb * 0.01 * nb, 2) AS net_premium, abs(va * da * nf - vb * db * nb) <= 0.02 * vb * db * nb AS vega_ok, abs(nf / nb - db * vb / (da * va)) <= 0.1 * nf / nb AS ratio_ok FROM p")
def _(spark, d):
    a = legs(spark, d)
    b = a.select((F.col("k") - 1).alias("k"), *[F.col(c).alias(f"b_{c}") for c in ("n", "vega", "dv", "price")])
    x = a.join(b, "k").withColumn("nf", F.col("b_n") * F.col("b_vega") * F.col("b_dv") / (F.col("vega") * F.col("dv")))
    mine, theirs = F.col("vega") * F.col("dv") * F.col("nf"), F.col("b_vega") * F.col("b_dv") * F.col("b_n")
    ratio = F.col("nf") / F.col("b_n")
    return x.select("k", F.round(F.col("price") * 0.01 * F.col("nf") - F.col("b_price") * 0.01 * F.col("b_n"), 2).alias("net_premium"), (F.abs(mine - theirs) <= 0.02 * theirs).alias("vega_ok"), (F.abs(ratio - F.col("b_dv") * F.col("b_vega") / (F.col("dv") * F.col("vega"))) <= 0.1 * ratio).alias("ratio_ok"))


# ---- signals -----------------------------------------------------------------------------------------
_Z = "z AS (SELECT tenor, m, gap, (gap - 12) / greatest(rv / 10, 1e-8) AS z FROM panel WHERE gap IS NOT NULL)"


def zs(spark, d):
    return panel(spark, d).where("gap IS NOT NULL").select("tenor", "m", "gap", ((F.col("gap") - 12) / F.greatest(F.col("rv") / 10, F.lit(1e-8))).alias("z"))


@register("sig_table", sql("panel", f"WITH {_Z}, b AS (SELECT m, arg_max(tenor, gap) AS trade_tenor, arg_max(z, gap) AS z FROM z GROUP BY m) SELECT m, trade_tenor, round(z, 5) AS z, round(1 + 0.3 * greatest(0, z), 5) AS signal_mult, CASE WHEN z > 0.5 THEN 'sell_vol' ELSE 'none' END AS trade_signal FROM b"), dates="m")
def _(spark, d):
    b = zs(spark, d).groupBy("m").agg(F.max_by("tenor", "gap").alias("trade_tenor"), F.max_by("z", "gap").alias("z"))
    return b.select("m", "trade_tenor", F.round("z", 5).alias("z"), F.round(1 + 0.3 * F.greatest(F.lit(0.0), "z"), 5).alias("signal_mult"), F.when(F.col("z") > 0.5, "sell_vol").otherwise("none").alias("trade_signal"))


@register("sig_spread", sql("panel", f"WITH {_Z}, c AS (SELECT tenor, m, least(greatest(z, -10), 10) AS z FROM z) SELECT tenor, m, CASE WHEN z > 0.5 THEN 'steepener' WHEN z < -0.5 THEN 'flattener' ELSE 'flat' END AS signal, round(1 + 0.5 * greatest(0, z), 5) AS mult_front, round(greatest(0.01, 1 - 0.5 * greatest(0, z)), 5) AS mult_back FROM c"), dates="m")
def _(spark, d):
    z = F.least(F.greatest("z", F.lit(-10.0)), F.lit(10.0))
    return zs(spark, d).withColumn("z", z).select("tenor", "m", F.when(F.col("z") > 0.5, "steepener").when(F.col("z") < -0.5, "flattener").otherwise("flat").alias("signal"), F.round(O.signal_multiplier(F.col("z"), 0.5, True), 5).alias("mult_front"), F.round(O.signal_multiplier(F.col("z"), 0.5, False), 5).alias("mult_back"))


@register("sig_mult_backtest", sql("panel", "SELECT tenor, m, round(coalesce(gap / nullif(rv, 0), 1.0), 6) AS mult FROM panel"), dates="m")
def _(spark, d):
    return panel(spark, d).select("tenor", "m", r6(F.coalesce(F.col("gap") / F.nullif("rv", F.lit(0.0)), F.lit(1.0))).alias("mult"))


@register("sig_load_latest", sql("panel", f"WITH {_Z} SELECT tenor, max(m) AS m, round(coalesce(arg_max(z, m), 0), 5) AS z, coalesce(arg_max(round(1 + 0.5 * greatest(0, z), 5), m), 1.0) AS mult FROM z GROUP BY 1"), dates="m")
def _(spark, d):
    x = zs(spark, d).groupBy("tenor").agg(F.max("m").alias("m"), F.max_by("z", "m").alias("z"))
    return x.select("tenor", "m", F.round(F.coalesce("z", F.lit(0.0)), 5).alias("z"), F.coalesce(F.round(O.signal_multiplier(F.col("z"), 0.5, True), 5), F.lit(1.0)).alias("mult"))


@register("sig_legacy_mult", sql("panel", f"WITH {_Z}, r AS (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY m DESC) AS rn FROM z WHERE m <= DATE '2000-03-15') SELECT tenor, round(1 + 0.3 * greatest(0, z), 5) AS mult FROM r WHERE rn = 1"))
def _(spark, d):
    x = zs(spark, d).where("m <= DATE '2000-03-15'").groupBy("tenor").agg(F.max_by("z", "m").alias("z"))
    return x.select("tenor", F.round(1 + 0.3 * F.greatest(F.lit(0.0), "z"), 5).alias("mult"))


@register("sim_inputs", sql("panel", f"WITH {_Z} SELECT p.tenor, p.m, round(p.rv * 10 / sqrt(252), 6) AS implied_event_sd, round(coalesce(z.z, 0), 5) AS z FROM panel p LEFT JOIN z ON z.tenor = p.tenor AND z.m = p.m"), dates="m")
def _(spark, d):
    return panel(spark, d).join(zs(spark, d).select("tenor", "m", "z"), ["tenor", "m"], "left").select("tenor", "m", r6(F.col("rv") * 10 / math.sqrt(252)).alias("implied_event_sd"), F.round(F.coalesce("z", F.lit(0.0)), 5).alias("z"))


# ---- P&L ---------------------------------------------------------------------------------------------
_A, _B2 = math.sqrt(14 / 365) * math.sqrt(2 / math.pi), math.sqrt(2 / math.pi) / math.sqrt(252)
_PNL = f"w AS (SELECT m, max(iv) FILTER (tenor = '1-URGENT') AS iv2, max(iv) FILTER (tenor = '5-LOW') AS iv30, max(rv) FILTER (tenor = '1-URGENT') AS rv2, max(rv) FILTER (tenor = '5-LOW') AS rv30, max(gap) FILTER (tenor = '1-URGENT') - max(gap) FILTER (tenor = '5-LOW') AS z, any_value(month(m) % 3) AS regime FROM panel GROUP BY m), p AS (SELECT m, regime, z, (rv2 * 9 * {_B2} - iv2 * {_A}) * 4 - (rv30 * 9 * {_B2} - iv30 * {_A}) * 4 - 0.5 AS pnl FROM w WHERE z IS NOT NULL)"


def pnl(spark, d):
    p = panel(spark, d)
    pick = lambda t, c: F.max(F.when(F.col("tenor") == t, F.col(c)))
    w = p.groupBy("m").agg(pick("1-URGENT", "iv").alias("iv2"), pick("5-LOW", "iv").alias("iv30"), pick("1-URGENT", "rv").alias("rv2"), pick("5-LOW", "rv").alias("rv30"), (pick("1-URGENT", "gap") - pick("5-LOW", "gap")).alias("z")).where("z IS NOT NULL")
    leg = lambda i: (F.col(f"rv{i}") * 9 * _B2 - F.col(f"iv{i}") * _A) * 4
    return w.select("m", (F.month("m") % 3).alias("regime"), "z", (leg(2) - leg(30) - 0.5).alias("pnl"))


@register("pnl_build", sql("panel", f"WITH {_PNL} SELECT m, round(z, 6) AS z, round(pnl, 5) AS pnl FROM p"), dates="m")
def _(spark, d):
    return pnl(spark, d).select("m", r6("z").alias("z"), F.round("pnl", 5).alias("pnl"))


_SH = "avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(8)"


@register("pnl_sizing", sql("panel", f"WITH {_PNL}, n AS (SELECT *, row_number() OVER (ORDER BY m) <= floor(0.55 * count(*) OVER ()) AS train FROM p), r AS (SELECT avg(z) AS mz, stddev_samp(z) AS sz FROM n WHERE train AND z > 0), s AS (SELECT kappa, train, pnl * CASE WHEN z > 0 THEN least(greatest(1 + kappa * (z - mz) / sz, 0), 5) ELSE 0 END AS x FROM n, r, (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0)) k(kappa)), g AS (SELECT kappa, round({_SH.format(x='x')}, 5) AS sharpe FROM s WHERE train AND x <> 0 GROUP BY 1) SELECT kappa, sharpe, kappa = (SELECT arg_max(kappa, sharpe) FROM g) AS best FROM g"))
def _(spark, d):
    p = pnl(spark, d)
    order = Window.partitionBy(F.lit(0)).orderBy("m")  # one row per event
    n = p.withColumn("train", F.row_number().over(order) <= F.floor(0.55 * F.count("*").over(Window.partitionBy(F.lit(0)))))
    r = F.broadcast(n.where("train AND z > 0").agg(F.avg("z").alias("mz"), F.stddev_samp("z").alias("sz")))
    k = F.broadcast(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "kappa double"))
    size = F.when(F.col("z") > 0, F.least(F.greatest(1 + F.col("kappa") * (F.col("z") - F.col("mz")) / F.col("sz"), F.lit(0.0)), F.lit(5.0))).otherwise(0.0)
    g = n.where("train").crossJoin(r).crossJoin(k).withColumn("x", F.col("pnl") * size).where("x <> 0").groupBy("kappa").agg(F.round(F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0)) * F.sqrt(F.lit(8.0)), 5).alias("sharpe"))
    best = F.broadcast(g.agg(F.max_by("kappa", "sharpe").alias("b")))
    return g.crossJoin(best).select("kappa", "sharpe", (F.col("kappa") == F.col("b")).alias("best"))


@register("pnl_stop", sql("panel", f"WITH {_PNL} SELECT m, pnl < -2.0 AS stopped, round(CASE WHEN pnl < -2.0 THEN -2.0 - 0.7 ELSE pnl END, 5) AS pnl FROM p"), dates="m")
def _(spark, d):
    hit = F.col("pnl") < -2.0
    return pnl(spark, d).select("m", hit.alias("stopped"), F.round(F.when(hit, -2.0 - 0.7).otherwise(F.col("pnl")), 5).alias("pnl"))


@register("pnl_regime", sql("panel", f"WITH {_PNL} SELECT 'by' AS kind, regime, count(*) AS n, round({_SH.format(x='pnl')}, 5) AS sharpe FROM p GROUP BY regime UNION ALL SELECT 'without', k.regime, count(*), round({_SH.format(x='pnl')}, 5) FROM p JOIN (SELECT DISTINCT regime FROM p) k ON k.regime <> p.regime GROUP BY k.regime UNION ALL SELECT 'double_cost', regime, count(*), round({_SH.format(x='(pnl - 0.5)')}, 5) FROM p GROUP BY regime"))
def _(spark, d):
    p = pnl(spark, d)
    sh = lambda x: F.round(F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.lit(8.0)), 5).alias("sharpe")
    by = p.groupBy("regime").agg(F.count("*").alias("n"), sh("pnl")).select(F.lit("by").alias("kind"), "regime", "n", "sharpe")
    k = F.broadcast(p.select(F.col("regime").alias("out")).distinct())
    loro = p.join(k, F.col("out") != F.col("regime")).groupBy("out").agg(F.count("*").alias("n"), sh("pnl")).select(F.lit("without").alias("kind"), F.col("out").alias("regime"), "n", "sharpe")
    cost = p.groupBy("regime").agg(F.count("*").alias("n"), sh(F.col("pnl") - 0.5)).select(F.lit("double_cost").alias("kind"), "regime", "n", "sharpe")
    return by.union(loro).union(cost)


@register("pnl_waterfall", sql("panel", f"WITH {_PNL}, s AS (SELECT 1 AS step, 'always' AS strategy, avg(pnl) AS v FROM p UNION ALL SELECT 2, 'signal', avg(CASE WHEN z > 0 THEN pnl ELSE 0 END) FROM p UNION ALL SELECT 3, 'stopped', avg(greatest(CASE WHEN z > 0 THEN pnl ELSE 0 END, -2.7)) FROM p) SELECT step, strategy, round(v, 5) AS mean_pnl, round(v - (SELECT v FROM s WHERE step = 1), 5) AS delta FROM s"))
def _(spark, d):
    sig = F.when(F.col("z") > 0, F.col("pnl")).otherwise(0.0)
    a = pnl(spark, d).agg(F.avg("pnl").alias("always"), F.avg(sig).alias("signal"), F.avg(F.greatest(sig, F.lit(-2.7))).alias("stopped"))
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("strategy"), F.col(n).alias("v"), F.col("always").alias("base")) for i, n in enumerate(("always", "signal", "stopped"), 1)]))
    return a.select(rows).select("step", "strategy", F.round("v", 5).alias("mean_pnl"), F.round(F.col("v") - F.col("base"), 5).alias("delta"))


# ---- payoffs, stops and sizes over observed paths ------------------------------------------------------
# Two keys of the daily series are the legs; paths are the rows that follow each event of the calendar.

_FRONT, _BACK, _DAYS = "1-URGENT", "5-LOW", 15
_JUMP = f"r AS (SELECT tenor, d, abs(px - lag(px) OVER (PARTITION BY tenor ORDER BY d)) AS jump FROM series), m AS (SELECT tenor, avg(jump) AS fair FROM r GROUP BY 1), w AS (SELECT d, max(jump - fair) FILTER (r.tenor = '{_FRONT}') AS front, max(fair - jump) FILTER (r.tenor = '{_BACK}') AS back FROM r JOIN m ON m.tenor = r.tenor WHERE jump IS NOT NULL GROUP BY 1), j AS (SELECT * FROM w WHERE front IS NOT NULL AND back IS NOT NULL)"


def payoffs(spark, d):
    return Z.straddle_payoffs(Z.moves(series(spark, d), "tenor", "d", "px"), "tenor", "d", _FRONT, _BACK)


@register("sim_event_mc", sql("series", f"WITH {_JUMP}, u AS (SELECT 'front' AS leg, front AS x FROM j UNION ALL SELECT 'back', back FROM j UNION ALL SELECT 'net', front + back FROM j), q AS (SELECT leg, quantile_cont(x, 0.01) AS v FROM u GROUP BY 1) SELECT u.leg, round(avg(x), 5) + 0 AS mean, round(avg(CAST(x > 0 AS INTEGER)), 5) AS p_profit, round(quantile_cont(x, 0.05), 5) AS p5, round(quantile_cont(x, 0.95), 5) AS p95, round(any_value(v), 5) AS var99, round(avg(x) FILTER (x <= v), 5) AS es99 FROM u JOIN q ON q.leg = u.leg GROUP BY 1"))
def _(spark, d):
    """Distribution of each leg's gain over all observed periods."""
    u = payoffs(spark, d).unpivot([], ["front", "back", "net"], "leg", "x")
    q = u.groupBy("leg").agg(F.percentile("x", F.lit(0.01)).alias("v"))
    r = lambda c, n: F.round(c, 5).alias(n)
    return u.join(q, "leg").groupBy("leg").agg(r(F.avg("x"), "mean"), r(F.avg((F.col("x") > 0).cast("int")), "p_profit"), r(F.percentile("x", F.lit(0.05)), "p5"), r(F.percentile("x", F.lit(0.95)), "p95"), r(F.first("v"), "var99"), r(F.avg(F.when(F.col("x") <= F.col("v"), F.col("x"))), "es99"))


@register("tkt_sweep", sql("series", f"WITH {_JUMP}, s AS (SELECT i / 10.0 AS share, front * (i / 10.0) + back * (1 - i / 10.0) AS x FROM j, range(11) t(i)), g AS (SELECT share, avg(x) AS mean, avg(x) / stddev_pop(x) AS ratio FROM s GROUP BY 1) SELECT share::DOUBLE AS share, round(mean, 5) + 0 AS mean, round(ratio, 5) + 0 AS ratio FROM g"))
def _(spark, d):
    """Mixes of the two legs, share by share."""
    x = payoffs(spark, d).withColumn("share", F.explode(F.expr("transform(sequence(0, 10), i -> i / 10.0D)")))
    x = x.withColumn("x", F.col("front") * F.col("share") + F.col("back") * (1 - F.col("share")))
    return x.groupBy("share").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.avg("x") / F.stddev_pop("x"), 5).alias("ratio"))


@register("siz_kelly_var", sql("series", f"WITH {_JUMP}, s AS (SELECT avg(front + back) AS mu, stddev_samp(front + back) AS sd, quantile_cont(front + back, 0.01) AS q01 FROM j), k AS (SELECT *, least(greatest(mu / nullif(sd * sd, 0), 0), 0.2) AS f, CASE WHEN q01 < 0 THEN 900 / -q01 END AS v FROM s) SELECT round(f, 6) AS kelly_f, round(v, 6) AS var_lots, CAST(greatest(1, round_even(coalesce(v * f / 0.2, 1), 0)) AS BIGINT) AS final_lots FROM k"))
def _(spark, d):
    s = payoffs(spark, d).agg(F.avg("net").alias("mu"), F.stddev_samp("net").alias("sd"), F.percentile("net", F.lit(0.01)).alias("q01"))
    return Z.kelly_var(s, cap=0.2, budget=900.0).select(r6("kelly_f").alias("kelly_f"), r6("var_lots").alias("var_lots"), "final_lots")


_PATH = f"n AS (SELECT meeting_date, tenor, px, row_number() OVER (PARTITION BY meeting_date, tenor ORDER BY d) AS day FROM cal JOIN series ON d > meeting_date), v AS (SELECT meeting_date, day, max(px) FILTER (tenor = '{_FRONT}') AS vf, max(px) FILTER (tenor = '{_BACK}') AS vb FROM n WHERE day <= {_DAYS} GROUP BY 1, 2 HAVING vf IS NOT NULL AND vb IS NOT NULL)"


def paths(spark, d):
    """meeting_date, day (from 1), vf, vb: both legs' prices on the rows after each event."""
    x = W.event_rows(calendar(spark, d), series(spark, d), "tenor", "meeting_date", "d", 0, _DAYS).where("pos > 0").withColumnRenamed("pos", "day")
    leg = lambda key: F.max(F.when(F.col("tenor") == key, F.col("px")))
    return x.groupBy("meeting_date", "day").agg(leg(_FRONT).alias("vf"), leg(_BACK).alias("vb")).where("vf IS NOT NULL AND vb IS NOT NULL")


@register("sim_vol_paths", sql("cal series", f"WITH {_PATH} SELECT day, count(*) AS n, round(avg(vf), 5) AS mean_front, round(stddev_samp(vf), 5) AS sd_front, round(avg(vf - vb), 5) AS mean_spread, round(quantile_cont(vf - vb, 0.05), 5) AS p5_spread FROM v GROUP BY 1"))
def _(spark, d):
    s = F.col("vf") - F.col("vb")
    return paths(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("vf"), 5).alias("mean_front"), F.round(F.stddev_samp("vf"), 5).alias("sd_front"), F.round(F.avg(s), 5).alias("mean_spread"), F.round(F.percentile(s, F.lit(0.05)), 5).alias("p5_spread"))


_LEGSLIP = lambda c: f"0.25 + 0.6 * coalesce(abs({c} - coalesce(lag({c}, 2) OVER w, first_value({c}) OVER w)) / nullif(least(row_number() OVER w - 1, 2), 0), 0)"
_SLIP = f"s AS (SELECT *, vf - vb AS spread, {_LEGSLIP('vf')} + {_LEGSLIP('vb')} AS slip FROM v WINDOW w AS (PARTITION BY meeting_date ORDER BY day))"


def slipped(spark, d):
    x = Z.slippage(paths(spark, d), "meeting_date", "day", ["vf", "vb"], base=0.25, speed=0.6, lookback=2)
    return x.withColumn("spread", F.col("vf") - F.col("vb"))


@register("sim_slippage", sql("cal series", f"WITH {_PATH}, {_SLIP} SELECT day, round(avg(slip), 5) AS mean_slip, round(max(slip), 5) AS worst FROM s GROUP BY 1"))
def _(spark, d):
    return slipped(spark, d).groupBy("day").agg(F.round(F.avg("slip"), 5).alias("mean_slip"), F.round(F.max("slip"), 5).alias("worst"))


_LEVELS = [5.0, 10.0, 20.0, 40.0]


@register("sim_stop_first", sql("cal series", f"WITH {_PATH}, {_SLIP}, b AS (SELECT *, spread - first_value(spread) OVER (PARTITION BY meeting_date ORDER BY day) AS pnl FROM s), l AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in _LEVELS)}]) AS level), t AS (SELECT level, meeting_date, min(day) FILTER (pnl <= -level) AS d0, max(day) AS d1 FROM b, l GROUP BY 1, 2), f AS (SELECT t.level, t.meeting_date, d0, CASE WHEN d0 IS NULL THEN e.pnl ELSE h.pnl - h.slip END AS pnl FROM t JOIN b e ON e.meeting_date = t.meeting_date AND e.day = d1 LEFT JOIN b h ON h.meeting_date = t.meeting_date AND h.day = d0) SELECT level, round(avg(CAST(d0 IS NOT NULL AS INTEGER)), 6) AS stop_rate, round(avg(d0), 5) AS mean_day, round(avg(pnl), 5) AS mean_pnl, round(avg(pnl) FILTER (d0 IS NOT NULL), 5) AS mean_stopped FROM f GROUP BY 1"))
def _(spark, d):
    x = slipped(spark, d)
    x = x.withColumn("pnl", F.col("spread") - F.first("spread").over(Window.partitionBy("meeting_date").orderBy("day")))  # at most _DAYS rows each
    s = Z.first_stop(x, "meeting_date", "day", "pnl", _LEVELS)
    return s.groupBy("level").agg(r6(F.avg(F.col("stopped").cast("int"))).alias("stop_rate"), F.round(F.avg("day"), 5).alias("mean_day"), F.round(F.avg("pnl"), 5).alias("mean_pnl"), F.round(F.avg(F.when(F.col("stopped"), F.col("pnl"))), 5).alias("mean_stopped"))
