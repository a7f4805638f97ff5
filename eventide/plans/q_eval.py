"""Evaluation, inference and study tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import calendar, macro, panel, series, sql, table
from eventide.catalog import register
from eventide.functions import stats as ST
from eventide.functions import volatility as V
from eventide.functions.scalar import r6
from eventide.operators import evaluate as E
from eventide.operators import regression as R
from eventide.operators import resample as RS
from eventide.operators import windows as W
from eventide.plans.q_aggs import FC, forecasts


#: Signed forecast errors: value and forecasts around the long-run mean of 50, per hour bar.
S = f"f AS ({FC}), s AS (SELECT tenor, ts, regime, actual - 50 AS y, pred - 50 AS p, pred2 - 50 AS p2 FROM f WHERE pred IS NOT NULL)"


def signed(spark, d):
    f = forecasts(spark, d).where("pred IS NOT NULL")
    return f.select("tenor", "ts", "regime", (F.col("actual") - 50).alias("y"), (F.col("pred") - 50).alias("p"), (F.col("pred2") - 50).alias("p2"))


def _wilson(k: str, n: str) -> str:
    z = 1.645
    mid = f"({k} * 1.0 / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    half = f"{z} / (1 + {z * z} / {n}) * sqrt(({k} * 1.0 / {n}) * (1 - {k} * 1.0 / {n}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    return f"round(CASE WHEN {n} = 0 THEN 0 ELSE greatest(0, {mid} - {half}) END, 6) AS lo, round(CASE WHEN {n} = 0 THEN 1 ELSE least(1, {mid} + {half}) END, 6) AS hi"


@register("ev_wilson", f"SELECT k, n, {_wilson('k', 'n')} FROM (SELECT c_custkey AS n, c_custkey % 7 * c_custkey // 7 AS k FROM customer UNION ALL SELECT 0, 0)".replace("c_custkey % 7 * c_custkey // 7", "(c_custkey % 7) * c_custkey // 7"))
def _(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.expr("(c_custkey % 7) * c_custkey div 7").alias("k")).union(spark.createDataFrame([(0, 0)], "n long, k long"))
    lo, hi = ST.wilson(F.col("k"), F.col("n"))
    return x.select("k", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))


@register("ev_sign_hit", sql("bars", f"WITH {S}, h AS (SELECT tenor, count(*) FILTER (sign(p) = sign(y)) AS hits, count(*) AS n FROM s GROUP BY 1) SELECT tenor, hits, n, round(hits * 1.0 / n, 6) AS rate, {_wilson('hits', 'n')} FROM h"))
def _(spark, d):
    x = E.sign_hits(signed(spark, d), ["tenor"], "p", "y")
    return x.select("tenor", "hits", "n", *[r6(c).alias(c) for c in ("rate", "lo", "hi")])


@register("ev_benchmarks", sql("bars", f"WITH {S}, b AS (SELECT CASE WHEN regime = 'day' THEN 'hiking' ELSE 'other' END AS sub, sign(p) = sign(y) AS model, y > 0 AS always, p > 0 AS pct FROM s), u AS (SELECT sub, strategy, hit FROM b UNPIVOT (hit FOR strategy IN (model, always, pct))) SELECT coalesce(sub, 'full') AS sub, strategy, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 6) AS rate FROM u GROUP BY GROUPING SETS ((sub, strategy), (strategy))"))
def _(spark, d):
    b = signed(spark, d).select(F.when(F.col("regime") == "day", "hiking").otherwise("other").alias("sub"), (F.signum("p") == F.signum("y")).alias("model"), (F.col("y") > 0).alias("always"), (F.col("p") > 0).alias("pct"))
    u = b.unpivot(["sub"], ["model", "always", "pct"], "strategy", "hit")
    return u.groupingSets([["sub", "strategy"], ["strategy"]], "sub", "strategy").agg(F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("int"))).alias("rate")).select(F.coalesce("sub", F.lit("full")).alias("sub"), "strategy", "n", "rate")


@register("ev_rolling_hit", sql("bars", f"WITH {S} SELECT tenor, ts, round(avg(CAST(sign(p) = sign(y) AS INTEGER)) OVER (PARTITION BY tenor ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rate FROM s"), dates="ts")
def _(spark, d):
    w = Window.partitionBy("tenor").orderBy("ts").rowsBetween(-19, 0)
    return signed(spark, d).select("tenor", "ts", r6(F.avg((F.signum("p") == F.signum("y")).cast("int")).over(w)).alias("rate"))


@register("ev_pnl_sign", sql("bars", f"WITH {S}, u AS (SELECT 'model' AS strategy, sign(p) * sign(y) AS pnl FROM s UNION ALL SELECT 'long', sign(y) FROM s UNION ALL SELECT 'short', -sign(y) FROM s UNION ALL SELECT 'second', sign(p2) * sign(y) FROM s) SELECT strategy, count(*) AS n, round(avg(pnl), 6) AS mean, round(avg(pnl) / CASE WHEN stddev_samp(pnl) > 0 THEN stddev_samp(pnl) ELSE 1 END, 6) AS sharpe FROM u GROUP BY 1"))
def _(spark, d):
    y = F.signum("y")
    x = signed(spark, d).select((F.signum("p") * y).alias("model"), y.alias("long"), (-y).alias("short"), (F.signum("p2") * y).alias("second"))
    u = x.unpivot([], ["model", "long", "short", "second"], "strategy", "pnl")
    sd = F.stddev_samp("pnl")
    return u.groupBy("strategy").agg(F.count("*").alias("n"), r6(F.avg("pnl")).alias("mean"), r6(F.avg("pnl") / F.when(sd > 0, sd).otherwise(1.0)).alias("sharpe"))


# Bootstraps run over the event panel; weights come from md5, so both engines draw the same rows.
_B = "e AS (SELECT m, avg(gap) - 12 AS y, avg(iv) - 26.5 AS p, avg(rv) - 14 AS p2 FROM panel WHERE gap IS NOT NULL GROUP BY m)"


def _U(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || (rep // 4) || ':' || CAST(m AS VARCHAR)), 1 + 8 * (rep % 4), 8) AS BIGINT)"


def _drawn(seed: int, reps: int, cells: str) -> str:
    """A SELECT of rep, n and sums of cells ``name=expression``, each row counted Poisson(1) times."""
    weight = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in RS.poisson_steps())
    sums = ", ".join(f"sum(w * ({c.split('=')[1]})) AS {c.split('=')[0]}" for c in cells.split("; "))
    return f"SELECT rep, sum(w) AS n, {sums} FROM (SELECT *, {weight} AS w FROM (SELECT e.*, rep, {_U(seed)} AS u FROM e, range({reps}) r(rep))) WHERE w > 0 GROUP BY rep"


def event_panel(spark, d):
    return panel(spark, d).where("gap IS NOT NULL").groupBy("m").agg((F.avg("gap") - 12).alias("y"), (F.avg("iv") - 26.5).alias("p"), (F.avg("rv") - 14).alias("p2"))


@register("ev_bootstrap_coef", sql("panel", f"WITH {_B}, s AS ({_drawn(7, 300, 'y=y; p=p; yp=y * p; pp=p * p')}), b AS (SELECT (n * yp - y * p) / nullif(n * pp - p * p, 0) AS slope FROM s) SELECT round(quantile_cont(slope, 0.05), 5) AS p5, round(quantile_cont(slope, 0.5), 5) AS p50, round(quantile_cont(slope, 0.95), 5) AS p95, quantile_cont(slope, 0.05) > 0 OR quantile_cont(slope, 0.95) < 0 AS sig FROM b"))
def _(spark, d):
    y, p = F.col("y"), F.col("p")
    b = RS.bootstrap_sums(event_panel(spark, d), "m", {"y": y, "p": p, "yp": y * p, "pp": p * p}, 300, 7)
    b = b.select(((F.col("n") * F.col("yp") - y * p) / F.nullif(F.col("n") * F.col("pp") - p * p, F.lit(0.0))).alias("slope"))
    q = lambda p: F.percentile("slope", F.lit(p))
    return b.agg(q(0.05).alias("a"), q(0.5).alias("b"), q(0.95).alias("c")).select(F.round("a", 5).alias("p5"), F.round("b", 5).alias("p50"), F.round("c", 5).alias("p95"), ((F.col("a") > 0) | (F.col("c") < 0)).alias("sig"))


@register("ev_bootstrap_rmse", sql("panel", f"WITH {_B}, a AS ({_drawn(11, 400, 'ss=pow(y - p, 2)')}), b AS ({_drawn(12, 400, 'ss=pow(y - p2, 2)')}), x AS (SELECT sqrt(a.ss / a.n) - sqrt(b.ss / b.n) AS diff FROM a JOIN b ON a.rep = b.rep) SELECT round(quantile_cont(diff, 0.05), 5) AS p5, round(quantile_cont(diff, 0.95), 5) AS p95, round(avg(CAST(diff > 0 AS INTEGER)), 6) AS win FROM x"))
def _(spark, d):
    """Difference of two models' RMSE with independent (unpaired) draws for each."""
    e = event_panel(spark, d)
    rmse = lambda c, seed: RS.bootstrap_sums(e, "m", {"ss": F.pow(F.col("y") - F.col(c), 2)}, 400, seed).select("rep", F.sqrt(F.col("ss") / F.col("n")).alias(c))
    x = rmse("p", 11).join(rmse("p2", 12), "rep").withColumn("diff", F.col("p") - F.col("p2"))
    return x.agg(F.round(F.percentile("diff", F.lit(0.05)), 5).alias("p5"), F.round(F.percentile("diff", F.lit(0.95)), 5).alias("p95"), r6(F.avg((F.col("diff") > 0).cast("int"))).alias("win"))


@register("ev_bootstrap_sharpe", sql("panel", f"WITH {_B}, s AS ({_drawn(21, 500, 'y=y; yy=y * y')}), b AS (SELECT y / n / nullif(sqrt(greatest(yy - y * y / n, 0) / (n - 1)), 0) * sqrt(8) AS s FROM s WHERE n >= 6) SELECT round(quantile_cont(s, 0.025), 5) AS lo, round(quantile_cont(s, 0.975), 5) AS hi FROM b"))
def _(spark, d):
    y, n = F.col("y"), F.col("n")
    b = RS.bootstrap_sums(event_panel(spark, d), "m", {"y": y, "yy": y * y}, 500, 21).where("n >= 6")
    b = b.select((y / n / F.nullif(F.sqrt(F.greatest(F.col("yy") - y * y / n, F.lit(0.0)) / (n - 1)), F.lit(0.0)) * F.sqrt(F.lit(8.0))).alias("s"))
    return b.agg(F.round(F.percentile("s", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("s", F.lit(0.975)), 5).alias("hi"))


@register("ev_bootstrap_hit", sql("panel", f"WITH {_B}, s AS ({_drawn(31, 300, 'hits=CAST(sign(p) IS NOT DISTINCT FROM sign(y) AS INTEGER)')}), b AS (SELECT hits / n AS h FROM s) SELECT round(quantile_cont(h, 0.05), 6) AS lo, round(quantile_cont(h, 0.95), 6) AS hi FROM b"))
def _(spark, d):
    b = RS.bootstrap_sums(event_panel(spark, d), "m", {"hits": (F.signum("p") == F.signum("y")).cast("int")}, 300, 31).select((F.col("hits") / F.col("n")).alias("h"))
    return b.agg(r6(F.percentile("h", F.lit(0.05))).alias("lo"), r6(F.percentile("h", F.lit(0.95))).alias("hi"))


@register("ev_permutation", sql("panel", f"WITH {_B}, h AS (SELECT count(*) FILTER (sign(p) = sign(y)) AS h FROM e), d AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {_U(41)}, m) AS r FROM range(300) x(rep), e), b AS (SELECT rep, avg(CASE WHEN r <= h THEN abs(y) ELSE -abs(y) END) AS mean FROM d, h GROUP BY 1) SELECT round(quantile_cont(mean, 0.5), 5) AS p50, round(quantile_cont(mean, 0.95), 5) AS p95 FROM b"))
def _(spark, d):
    """Random masks with as many hits as the model has."""
    b = RS.permuted_hits(event_panel(spark, d), "y", F.signum("p") == F.signum("y"), "m", 300, 41)
    return b.agg(F.round(F.percentile("mean", F.lit(0.5)), 5).alias("p50"), F.round(F.percentile("mean", F.lit(0.95)), 5).alias("p95"))


@register("ev_verdict", "SELECT p_partkey, CASE WHEN lo > 0 THEN 'PASS' WHEN win > 0.65 THEN 'WEAK' ELSE 'FLAG' END AS verdict, CASE WHEN lo > 0 THEN 'PASS' WHEN win > 0.75 THEN 'WEAK' ELSE 'FLAG' END AS strict FROM (SELECT p_partkey, (p_size - 25) / 10.0 AS lo, (p_partkey % 100) / 100.0 AS win FROM part)")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_size") - 25) / 10.0).alias("lo"), (F.col("p_partkey") % 100 / 100.0).alias("win"))
    return p.select("p_partkey", ST.verdict(F.col("lo"), F.col("win")).alias("verdict"), ST.verdict(F.col("lo"), F.col("win"), 0.75).alias("strict"))


@register("ev_lock", "WITH s AS (SELECT p_type AS spec, round(avg(p_retailprice), 4) AS rmse, avg(p_size) > 25 AS pass FROM part GROUP BY 1) SELECT coalesce(arg_min(spec, rmse) FILTER (pass), 'baseline') AS locked FROM s")
def _(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_type").alias("spec")).agg(F.round(F.avg("p_retailprice"), 4).alias("rmse"), (F.avg("p_size") > 25).alias("ok"))
    return s.agg(F.coalesce(F.min_by("spec", F.when(F.col("ok"), F.col("rmse"))), F.lit("baseline")).alias("locked"))


@register("ev_diagnose", sql("bars", f"WITH {S}, r AS (SELECT regime, count(*) AS n, sqrt(avg(pow(y - p, 2))) - sqrt(avg(pow(y - p2, 2))) AS d FROM s GROUP BY 1) SELECT regime, n, round(d, 6) AS d_rmse, round(9.0 / sum(n) OVER (), 6) AS ratio, round(max(n) OVER () * 1.0 / min(n) OVER (), 6) AS imbalance FROM r"))
def _(spark, d):
    rm = lambda c: F.sqrt(F.avg(F.pow(F.col("y") - F.col(c), 2)))
    r = signed(spark, d).groupBy("regime").agg(F.count("*").alias("n"), (rm("p") - rm("p2")).alias("d"))
    t = F.broadcast(r.agg(F.sum("n").alias("s"), F.max("n").alias("hi"), F.min("n").alias("lo")))
    return r.crossJoin(t).select("regime", "n", r6("d").alias("d_rmse"), r6(9.0 / F.col("s")).alias("ratio"), r6(F.col("hi") / F.col("lo")).alias("imbalance"))


@register("ev_balance", sql("panel", "SELECT tenor, month(m) % 3 AS regime, count(gap) AS n, CASE WHEN count(gap) < 25 THEN 'INSUFFICIENT' ELSE 'OK' END AS state FROM panel GROUP BY 1, 2"))
def _(spark, d):
    n = F.count("gap")
    return panel(spark, d).groupBy("tenor", (F.month("m") % 3).alias("regime")).agg(n.alias("n"), F.when(n < 25, "INSUFFICIENT").otherwise("OK").alias("state"))


@register("ev_consistency", sql("panel", "WITH t AS (SELECT tenor, avg(iv) AS a, stddev_samp(iv) AS b, avg(rv) AS c, stddev_samp(rv) AS d FROM panel WHERE m < DATE '2001-06-01' GROUP BY 1) SELECT p.tenor, round((iv - a) / b, 5) AS z_iv, round((rv - c) / d, 5) AS z_rv, abs((iv - a) / b) > 3 AS warn FROM panel p JOIN t ON t.tenor = p.tenor WHERE m = DATE '2001-06-01'"))
def _(spark, d):
    p = panel(spark, d)
    t = p.where("m < DATE '2001-06-01'").groupBy("tenor").agg(F.avg("iv").alias("a"), F.stddev_samp("iv").alias("b"), F.avg("rv").alias("c"), F.stddev_samp("rv").alias("e"))
    z = (F.col("iv") - F.col("a")) / F.col("b")
    return p.where("m = DATE '2001-06-01'").join(t, "tenor").select("tenor", F.round(z, 5).alias("z_iv"), F.round((F.col("rv") - F.col("c")) / F.col("e"), 5).alias("z_rv"), (F.abs(z) > 3).alias("warn"))


_PCT = "round(100.0 * count(*) FILTER (h.v < e.v) / count(*), 6)"


@register("ev_case_study", sql("panel", f"WITH u AS (SELECT tenor, m, feature, v FROM panel UNPIVOT (v FOR feature IN (iv, rv))), e AS (SELECT * FROM u WHERE m = DATE '2001-06-01') SELECT e.tenor, e.feature, any_value(e.v) AS value, {_PCT} AS pct, CASE WHEN {_PCT} >= 80 THEN 'HIGH' WHEN {_PCT} <= 20 THEN 'LOW' ELSE 'MID' END AS flag FROM e JOIN u h ON h.tenor = e.tenor AND h.feature = e.feature AND h.m < e.m GROUP BY 1, 2"))
def _(spark, d):
    return E.event_percentiles(panel(spark, d), "tenor", "m", "2001-06-01", ["iv", "rv"]).select("tenor", "feature", "value", r6("pct").alias("pct"), "flag")


@register("ev_percentile_bars", sql("panel", f"WITH u AS (SELECT tenor, m, feature, v FROM panel UNPIVOT (v FOR feature IN (iv, rv))), e AS (SELECT * FROM u WHERE m >= DATE '2001-01-01') SELECT e.tenor, e.m, e.feature, {_PCT} AS pct, {_PCT} <= 20 OR {_PCT} >= 80 AS extreme FROM e JOIN u h ON h.tenor = e.tenor AND h.feature = e.feature AND h.m < e.m GROUP BY 1, 2, 3"), dates="m")
def _(spark, d):
    u = panel(spark, d).unpivot(["tenor", "m"], ["iv", "rv"], "feature", "v").where("v IS NOT NULL")
    x = W.expanding_rank(u.withColumn("key", F.concat_ws("|", "tenor", "feature")), "v", "key", "m", "pct")
    n = F.count("v").over(W.expanding("key", "m"))
    eq = F.count("*").over(Window.partitionBy("key", "v").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    pct = r6(100.0 * (F.col("pct") * n - (eq + 1) / 2) / F.nullif(n - 1, F.lit(0)))
    return x.withColumn("p", pct).where("m >= DATE '2001-01-01'").select("tenor", "m", "feature", F.col("p").alias("pct"), ((F.col("p") <= 20) | (F.col("p") >= 80)).alias("extreme"))


@register("ev_acceptance", sql("bars", f"WITH {S} SELECT tenor, arg_max(p, ts) > 0 AS predicted_up, sign(arg_max(p, ts)) = sign(arg_max(y, ts)) AS match FROM s GROUP BY 1"))
def _(spark, d):
    last = lambda c: F.max_by(c, "ts")
    return signed(spark, d).groupBy("tenor").agg((last("p") > 0).alias("predicted_up"), (F.signum(last("p")) == F.signum(last("y"))).alias("match"))


@register("ev_analog", sql("bars", f"WITH {S} SELECT tenor, round(avg(abs(p - y)), 6) AS mae_y, round(avg(abs(p - p2)), 6) AS mae_p2, round(corr(p, y), 6) AS r_y, round(corr(p, p2), 6) AS r_p2 FROM s GROUP BY 1"))
def _(spark, d):
    mae = lambda a, b: r6(F.avg(F.abs(F.col(a) - F.col(b))))
    return signed(spark, d).groupBy("tenor").agg(mae("p", "y").alias("mae_y"), mae("p", "p2").alias("mae_p2"), r6(F.corr("p", "y")).alias("r_y"), r6(F.corr("p", "p2")).alias("r_p2"))


_MET = "count(*) AS n, round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, round(1 - sum(pow(y - p, 2)) / sum(pow(y - mu, 2)), 6) AS r2, round(avg(CAST((p > mu) = (y > mu) AS INTEGER)), 6) AS shr"


@register("ev_oos_summary", sql("bars", f"WITH {S}, u AS (SELECT 'nlp' AS mode, y, p FROM s UNION ALL SELECT 'regime', y, p2 FROM s UNION ALL SELECT 'market', y, p FROM s WHERE regime = 'day'), g AS (SELECT *, avg(y) OVER (PARTITION BY mode) AS mu FROM u) SELECT mode, {_MET} FROM g GROUP BY 1"))
def _(spark, d):
    s = signed(spark, d).select("y", F.col("p").alias("nlp"), F.col("p2").alias("regime"), F.when(F.col("regime") == "day", F.col("p")).alias("market"))
    u = s.unpivot(["y"], ["nlp", "regime", "market"], "mode", "p").where("p IS NOT NULL")
    x = E.regression_metrics(u, ["mode"], "y", "p")
    return x.select("mode", "n", *[r6(c).alias(c) for c in ("rmse", "r2", "shr")])


@register("ev_readout_direction", sql("bars", f"WITH {S}, h AS (SELECT tenor, avg(y) AS mu FROM s GROUP BY 1), l AS (SELECT tenor, arg_max(p, ts) AS p, arg_max(y, ts) AS y FROM s GROUP BY 1) SELECT l.tenor, (p > mu) = (y > mu) AS direction_ok, round(p - y, 6) AS error, round((p - y) / nullif(abs(y), 0) * 100, 4) AS pct_error FROM l JOIN h ON h.tenor = l.tenor"))
def _(spark, d):
    x = signed(spark, d).groupBy("tenor").agg(F.avg("y").alias("mu"), F.max_by("p", "ts").alias("p"), F.max_by("y", "ts").alias("y"))
    return x.select("tenor", ((F.col("p") > F.col("mu")) == (F.col("y") > F.col("mu"))).alias("direction_ok"), r6(F.col("p") - F.col("y")).alias("error"), F.round((F.col("p") - F.col("y")) / F.nullif(F.abs("y"), F.lit(0.0)) * 100, 4).alias("pct_error"))


@register("ev_vrp_readout", sql("panel", "SELECT tenor, m, round(sign(gap - 12) * sqrt(abs(gap - 12)), 6) AS root, round((gap - avg(gap) OVER w) / stddev_samp(gap) OVER w, 5) AS z FROM panel WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY tenor)"), dates="m")
def _(spark, d):
    p = panel(spark, d).where("gap IS NOT NULL")
    s = p.groupBy("tenor").agg(F.avg("gap").alias("mu"), F.stddev_samp("gap").alias("sd"))
    return p.join(s, "tenor").select("tenor", "m", r6(V.signed_root(F.col("gap") - 12)).alias("root"), F.round((F.col("gap") - F.col("mu")) / F.col("sd"), 5).alias("z"))


@register("ev_g_posterior", sql("panel", "SELECT m, round(avg(gap), 6) AS mean, round(avg(gap) - 1.96 * stddev_samp(gap) / sqrt(count(gap)), 6) AS lo, round(avg(gap) + 1.96 * stddev_samp(gap) / sqrt(count(gap)), 6) AS hi FROM panel WHERE gap IS NOT NULL GROUP BY m ORDER BY m DESC LIMIT 10"), dates="m")
def _(spark, d):
    se = 1.96 * F.stddev_samp("gap") / F.sqrt(F.count("gap"))
    return panel(spark, d).where("gap IS NOT NULL").groupBy("m").agg(r6(F.avg("gap")).alias("mean"), r6(F.avg("gap") - se).alias("lo"), r6(F.avg("gap") + se).alias("hi")).orderBy(F.desc("m")).limit(10)


@register("ev_handoff_rank", sql("bars", f"WITH {S}, l AS (SELECT tenor, arg_max(p, ts) AS last_p FROM s GROUP BY 1) SELECT s.tenor, round(avg(CAST(p <= last_p AS INTEGER)), 6) AS pct, round(avg(CAST(p > 0 AS INTEGER)), 6) AS share_positive FROM s JOIN l ON l.tenor = s.tenor GROUP BY 1"))
def _(spark, d):
    s = signed(spark, d)
    last = s.groupBy("tenor").agg(F.max_by("p", "ts").alias("last_p"))
    return s.join(last, "tenor").groupBy("tenor").agg(r6(F.avg((F.col("p") <= F.col("last_p")).cast("int"))).alias("pct"), r6(F.avg((F.col("p") > 0).cast("int"))).alias("share_positive"))


@register("ev_group_distribution", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 3) AS q1, round(median(o_totalprice), 3) AS q2, round(quantile_cont(o_totalprice, 0.75), 3) AS q3 FROM orders GROUP BY 1, 2 HAVING count(*) >= 3")
def _(spark, d):
    q = lambda p: F.round(F.percentile("o_totalprice", F.lit(p)), 3)
    return table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3")).where("n >= 3")


@register("ev_corr_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def _(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = table(spark, d, "lineitem").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    part = F.split("pair", "\\|")
    return long.select(F.get(part, F.lit(0)).alias("a"), F.get(part, F.lit(1)).alias("b"), r6("r").alias("r"))


@register("ev_year_means", sql("panel", "SELECT tenor, year(m) AS y, round(sqrt(greatest(0, avg(gap - 12))) * 100, 4) AS vol, round(avg(iv), 6) AS mean_iv FROM panel GROUP BY 1, 2"))
def _(spark, d):
    return panel(spark, d).groupBy("tenor", F.year("m").alias("y")).agg(F.round(F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("gap") - 12))) * 100, 4).alias("vol"), r6(F.avg("iv")).alias("mean_iv"))


@register("st_nw_test", sql("panel", "WITH g AS (SELECT tenor, count(gap) AS n, avg(gap) - 12 AS mean FROM panel GROUP BY 1), e AS (SELECT p.tenor, m, g.n, mean, gap - 12 - mean AS e FROM panel p JOIN g ON g.tenor = p.tenor WHERE gap IS NOT NULL), l AS (SELECT *, e * lag(e, 1) OVER w AS l1, e * lag(e, 2) OVER w AS l2 FROM e WINDOW w AS (PARTITION BY tenor ORDER BY m)) SELECT tenor, any_value(n) AS n, round(any_value(mean) / sqrt((sum(e * e) + 2 * (sum(l1) * 2 / 3 + sum(l2) / 3)) / count(*) / count(*) * CASE WHEN any_value(n) > 4 THEN count(*) / (count(*) - 1.0) ELSE 1 END), 4) AS t FROM l GROUP BY 1"))
def _(spark, d):
    x = R.newey_west_mean(panel(spark, d).where("gap IS NOT NULL").withColumn("x", F.col("gap") - 12), ["tenor"], ["m"], "x", lags=2)
    small = F.when(F.col("n") > 4, F.col("n") / (F.col("n") - 1.0)).otherwise(1.0)
    return x.select("tenor", "n", F.round(F.col("t") / F.sqrt(small), 4).alias("t"))


@register("viz_phase_map", sql("panel", "WITH x AS (SELECT tenor, m, abs(iv - 26.5) + abs(rv - 14) AS s, gap FROM panel) SELECT tenor, m, round(s / max(s) OVER (PARTITION BY tenor), 6) AS size, round(quantile_cont(gap, 0.05) OVER (PARTITION BY tenor), 6) AS lo, round(quantile_cont(gap, 0.95) OVER (PARTITION BY tenor), 6) AS hi FROM x"), dates="m")
def _(spark, d):
    x = panel(spark, d).withColumn("s", F.abs(F.col("iv") - 26.5) + F.abs(F.col("rv") - 14))
    k = x.groupBy("tenor").agg(F.max("s").alias("top"), F.percentile("gap", F.lit(0.05)).alias("lo"), F.percentile("gap", F.lit(0.95)).alias("hi"))
    return x.join(k, "tenor").select("tenor", "m", r6(F.col("s") / F.col("top")).alias("size"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@register("viz_classifier_rolling", sql("bars", f"WITH {S} SELECT regime, tenor, count(*) AS n, round(avg(CAST((p > 0) = (y > 0) AS INTEGER)), 6) AS hit, round(avg(CAST(y > 0 AS INTEGER)), 6) AS base FROM s GROUP BY 1, 2"))
def _(spark, d):
    return signed(spark, d).groupBy("regime", "tenor").agg(F.count("*").alias("n"), r6(F.avg(((F.col("p") > 0) == (F.col("y") > 0)).cast("int"))).alias("hit"), r6(F.avg((F.col("y") > 0).cast("int"))).alias("base"))


@register("viz_coverage", "SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) AS total FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("source") == "src0").alias("src0"), F.count_if(F.col("source") == "src1").alias("src1"), F.count("*").alias("total"))


@register("viz_histogram", "SELECT event_type, CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 5).alias("bin")).agg(F.count("*").alias("n"))
