"""Linear models, walk-forward and feature preparation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import panel, sql, table
from eventide.catalog import register
from eventide.functions.scalar import r6
from eventide.operators import models as M
from eventide.operators import prefix_gram as PG
from eventide.operators import ranges as R
from eventide.operators import walkforward as WF
from eventide.operators import windows as W


def by_m():
    return Window.partitionBy("tenor").orderBy("m")


@register("ml_scaler", sql("panel", "SELECT a.tenor, a.m, round((any_value(a.iv) - avg(b.iv)) / CASE WHEN stddev_pop(b.iv) > 0 THEN stddev_pop(b.iv) ELSE 1 END, 5) AS z FROM panel a JOIN panel b ON a.tenor = b.tenor AND b.m < a.m GROUP BY a.tenor, a.m HAVING count(*) >= 5"), dates="m")
def _(spark, d):
    # the folds of one key are expanding frames: a window, not a self-join
    w = W.expanding("tenor", "m", current=False)
    sd = F.stddev_pop("iv").over(w)
    x = panel(spark, d).withColumn("n", F.count("iv").over(w)).withColumn("z", (F.col("iv") - F.avg("iv").over(w)) / F.when(sd > 0, sd).otherwise(1.0))
    return x.where("n >= 5").select("tenor", "m", F.round("z", 5).alias("z"))


@register("ml_ols_1", sql("panel", "SELECT tenor, month(m) % 3 AS regime, regr_count(gap, iv) AS n, round(regr_slope(gap, iv), 6) AS slope FROM panel GROUP BY 1, 2"))
def _(spark, d):
    return panel(spark, d).groupBy("tenor", (F.month("m") % 3).alias("regime")).agg(F.regr_count("gap", "iv").alias("n"), r6(F.regr_slope("gap", "iv")).alias("slope"))


@register("ml_polyfit", sql("panel", "SELECT tenor, round(regr_slope(rv, n), 6) AS slope, round(regr_intercept(rv, n), 6) AS intercept FROM panel GROUP BY 1"))
def _(spark, d):
    p = panel(spark, d).withColumn("n", F.col("n").cast("double"))
    return p.groupBy("tenor").agg(r6(F.regr_slope("rv", "n")).alias("slope"), r6(F.regr_intercept("rv", "n")).alias("intercept"))


_X = "x AS (SELECT tenor, m, rv AS y, iv AS x FROM panel WHERE rv IS NOT NULL)"


@register("ml_ols_hac", sql("panel", f"WITH {_X}, s AS (SELECT tenor, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2 FROM x GROUP BY 1), u AS (SELECT x.tenor, x.m, n, b, r2, (y - a - b * x) * (x - mx) / sxx AS u FROM x JOIN s ON s.tenor = x.tenor), l AS (SELECT *, u * lag(u, 1) OVER w AS l1, u * lag(u, 2) OVER w AS l2, u * lag(u, 3) OVER w AS l3, u * lag(u, 4) OVER w AS l4, u * lag(u, 5) OVER w AS l5 FROM u WINDOW w AS (PARTITION BY tenor ORDER BY m)) SELECT tenor, any_value(n) AS n, round(any_value(b), 6) AS coef, round(sqrt(any_value(n) / (any_value(n) - 2.0) * (sum(u * u) + 2 * (sum(l1) * 5 / 6 + sum(l2) * 4 / 6 + sum(l3) * 3 / 6 + sum(l4) * 2 / 6 + sum(l5) / 6))), 6) AS se, round(any_value(r2), 6) AS r2 FROM l GROUP BY 1"))
def _(spark, d):
    x = panel(spark, d).where("rv IS NOT NULL")
    out = M.ols_hac(x, ["iv"], "rv", ["tenor"], ["m"], lags=5).where("term = 'iv'")
    return out.select("tenor", "n", r6("coef").alias("coef"), r6("se").alias("se"), r6("r2").alias("r2"))


@register("ml_ols_interact", sql("panel", f"WITH {_X} SELECT r.tenor, count(*) AS n, round(regr_r2(y, x), 6) AS r2 FROM x r GROUP BY 1"))
def _(spark, d):
    # fully interacted with the tenor, every tenor's fit is its own; R2 per tenor
    x = panel(spark, d).where("rv IS NOT NULL")
    out = M.ols(x, ["iv"], "rv", ["tenor"]).where("term = 'iv'")
    return out.select("tenor", "n", r6("r2").alias("r2"))


# Regime dummies with interactions are one line per regime: its intercepts and slopes against those of regime 0.
_POOLED = """WITH x AS (SELECT month(m) % 3 AS g, iv, rv FROM panel WHERE rv IS NOT NULL),
l AS (SELECT g, regr_intercept(rv, iv) AS a, regr_slope(rv, iv) AS b, regr_sxx(rv, iv) AS sxx, avg(iv) AS mx, count(*) AS n FROM x GROUP BY 1),
e AS (SELECT sum(pow(rv - a - b * iv, 2)) AS sse, regr_syy(rv, iv) AS sst, count(*) AS n FROM x JOIN l USING (g)),
v AS (SELECT l.*, sse / (e.n - 6) * (1.0 / l.n + mx * mx / sxx) AS va, sse / (e.n - 6) / sxx AS vb FROM l, e),
c AS (SELECT z.a AS a0, z.b AS b0, z.va AS va0, z.vb AS vb0, o.a AS a1, o.b AS b1, o.va AS va1, o.vb AS vb1, t.a AS a2, t.b AS b2, t.va AS va2, t.vb AS vb2 FROM v z, v o, v t WHERE z.g = 0 AND o.g = 1 AND t.g = 2),
r AS (SELECT unnest(['const', 'iv', 'r1', 'r2f', 'iv_r1', 'iv_r2']) AS term, unnest([a0, b0, a1 - a0, a2 - a0, b1 - b0, b2 - b0]) AS coef, unnest([va0, vb0, va1 + va0, va2 + va0, vb1 + vb0, vb2 + vb0]) AS var FROM c)
SELECT term, round(coef, 6) AS coef, round(sqrt(var), 6) AS se, round(1 - sse / sst, 6) AS r2, n FROM r, e"""


@register("ml_ols_interact_pooled", sql("panel", _POOLED))
def _(spark, d):
    """One pooled regression with regime dummies and interactions: coefficients, errors, R2."""
    p = panel(spark, d).where("rv IS NOT NULL")
    reg = F.month("m") % 3
    x = p.withColumns({"r1": (reg == 1).cast("double"), "r2f": (reg == 2).cast("double")}).withColumns({"iv_r1": F.col("iv") * F.col("r1"), "iv_r2": F.col("iv") * F.col("r2f")})
    out = M.ols(x, ["iv", "r1", "r2f", "iv_r1", "iv_r2"], "rv")
    return out.select("term", r6("coef").alias("coef"), r6("se").alias("se"), r6("r2").alias("r2"), "n")


@register("ml_loco", sql("panel", f"WITH {_X} SELECT k.tenor AS left_out, count(*) AS n, round(regr_slope(y, x), 6) AS coef FROM x JOIN (SELECT DISTINCT tenor FROM x) k ON k.tenor <> x.tenor GROUP BY 1"))
def _(spark, d):
    x = panel(spark, d).where("rv IS NOT NULL")
    k = F.broadcast(x.select(F.col("tenor").alias("left_out")).distinct())
    out = M.ols(x.join(k, F.col("tenor") != F.col("left_out")), ["iv"], "rv", ["left_out"]).where("term = 'iv'")
    return out.select("left_out", "n", r6("coef").alias("coef"))


@register("ml_ridge", sql("panel", f"WITH {_X} SELECT tenor, round(regr_sxy(y, x) / (regr_sxx(y, x) + 50), 6) AS coef FROM x GROUP BY 1"))
def _(spark, d):
    out = M.ols(panel(spark, d).where("rv IS NOT NULL"), ["iv"], "rv", ["tenor"], ridge=50.0).where("term = 'iv'")
    return out.select("tenor", r6("coef").alias("coef"))


@register("ml_pca", sql("panel", "SELECT tenor, round((1 + abs(corr(iv, rv))) / 2, 6) AS share1, round(sqrt(0.5), 6) AS loading FROM panel WHERE rv IS NOT NULL GROUP BY 1"))
def _(spark, d):
    out = M.pca(panel(spark, d).where("rv IS NOT NULL"), ["iv", "rv"], ["tenor"])
    return out.where("component = 1 AND feature = 'iv'").select("tenor", r6("share").alias("share1"), r6(F.abs("loading")).alias("loading"))


@register("ml_bayes_ridge", sql("panel", f"WITH {_X} SELECT tenor, round((sum(x * y * (1.0 / (1 + month(m)))) + 5 * 0.4) / (sum(x * x * (1.0 / (1 + month(m)))) + 5), 6) AS coef FROM x GROUP BY 1"))
def _(spark, d):
    x = panel(spark, d).where("rv IS NOT NULL").withColumn("w", 1.0 / (1 + F.month("m")))
    return M.bayes_ridge(x, ["iv"], "rv", "w", prior=[0.4], strength=[5.0], by=["tenor"]).select("tenor", r6("coef").alias("coef"))


@register("ml_kernel_weights", sql("panel", "WITH f AS (SELECT a.tenor, a.m AS fold, a.iv AS ti, a.rv AS tr, b.m, b.iv, b.rv FROM panel a JOIN panel b ON a.tenor = b.tenor AND b.m < a.m WHERE a.rv IS NOT NULL AND b.rv IS NOT NULL AND a.m >= DATE '2000-06-01' AND b.gap IS NOT NULL), k AS (SELECT *, exp(-sqrt(pow((iv - ti) / stddev_pop(iv) OVER w, 2) + pow((rv - tr) / stddev_pop(rv) OVER w, 2)) / 2.0) AS k FROM f WINDOW w AS (PARTITION BY tenor, fold)) SELECT tenor, fold, m, round(k / sum(k) OVER (PARTITION BY tenor, fold), 6) AS weight FROM k"), dates="fold m")
def _(spark, d):
    p = panel(spark, d).where("rv IS NOT NULL")
    tests = p.where("m >= DATE '2000-06-01'").select("tenor", F.col("m").alias("fold"), F.col("iv").alias("t_iv"), F.col("rv").alias("t_rv"))
    f = tests.join(p.where("gap IS NOT NULL"), "tenor").where("m < fold")
    return M.kernel_weights(f, ["tenor", "fold"], ["iv", "rv"], bandwidth=2.0).select("tenor", "fold", "m", r6("weight").alias("weight"))


_FEAT = "SELECT tenor, m, 1.0::DOUBLE AS const, iv, rv, lag(iv) OVER w AS iv_lag1, lag(rv) OVER w AS rv_lag1, round(iv * (month(m) % 2), 6) AS iv_odd, CAST(month(m) % 3 = 1 AS DOUBLE) AS r1, CAST(month(m) % 3 = 2 AS DOUBLE) AS r2, gap FROM panel WINDOW w AS (PARTITION BY tenor ORDER BY m)"


def features(spark, d):
    mo = F.month("m")
    return panel(spark, d).select("tenor", "m", F.lit(1.0).alias("const"), "iv", "rv", F.lag("iv").over(by_m()).alias("iv_lag1"), F.lag("rv").over(by_m()).alias("rv_lag1"), r6(F.col("iv") * (mo % 2)).alias("iv_odd"), (mo % 3 == 1).cast("double").alias("r1"), (mo % 3 == 2).cast("double").alias("r2"), "gap")


@register("ml_feature_matrix", sql("panel", _FEAT), dates="m")
def _(spark, d):
    return features(spark, d)


@register("ml_feature_select", "SELECT unnest(['iv', 'iv_lag1', 'iv_odd', 'r1', 'r2', 'rv', 'rv_lag1']) AS feature")
def _(spark, d):
    cols = M.numeric_columns(features(spark, d), leaks=["gap", "const"])
    return spark.createDataFrame([(c,) for c in cols], "feature string")


@register("ml_loo_cv", sql("panel", f"WITH {_X}, s AS (SELECT tenor, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM x GROUP BY 1) SELECT x.tenor, x.m, round(y - (y - a - b * x) / (1 - 1.0 / n - pow(x - mx, 2) / sxx), 5) AS pred FROM x JOIN s ON s.tenor = x.tenor"), dates="m")
def _(spark, d):
    return M.loo_simple(panel(spark, d).where("rv IS NOT NULL"), ["tenor"], "iv", "rv").select("tenor", "m", F.round("pred", 5).alias("pred"))


@register("ml_kfold", sql("panel", "SELECT tenor, m, CAST('0x' || substr(md5(tenor || ':' || CAST(m AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 5 AS fold FROM panel"), dates="m")
def _(spark, d):
    return panel(spark, d).select("tenor", "m", M.fold_id(["tenor", "m"], 5, 42).alias("fold"))


@register("ml_contrib", sql("panel", f"WITH {_X}, c AS (SELECT tenor, regr_slope(y, x) AS b, avg(x) AS mx, stddev_pop(x) AS sx FROM x GROUP BY 1) SELECT x.tenor, x.m, round(b * (x - mx), 5) AS contrib FROM x JOIN c ON c.tenor = x.tenor QUALIFY row_number() OVER (PARTITION BY x.tenor ORDER BY abs(round(b * (x - mx), 5)) DESC, x.m) <= 5"), dates="m")
def _(spark, d):
    x = panel(spark, d).where("rv IS NOT NULL")
    b = M.ols(x, ["iv"], "rv", ["tenor"]).where("term = 'iv'").select("tenor", "coef")
    mu = x.groupBy("tenor").agg(F.avg("iv").alias("mu"))
    y = x.join(b, "tenor").join(mu, "tenor").select("tenor", "m", F.round(F.col("coef") * (F.col("iv") - F.col("mu")), 5).alias("contrib"))
    return W.top_k(y, ["tenor"], [F.desc(F.abs("contrib")), F.col("m")], 5)


@register("wf_baseline_mean", sql("panel", "SELECT tenor, m, round(avg(gap) OVER (PARTITION BY tenor ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS baseline FROM panel"), dates="m")
def _(spark, d):
    return R.running(panel(spark, d), "tenor", "m", {"mean": ("avg", "gap")}, current=False).select("tenor", "m", r6("mean").alias("baseline"))


_FS = ["iv_lag1", "rv_lag1"]
_FX = [*_FS, "r1", "r2", "iv_odd"]


def model_panel(spark, d):
    return features(spark, d).withColumn("regime", F.when(F.col("r1") == 1, "easing").when(F.col("r2") == 1, "at_target").otherwise("slack"))


def _walk(spark, d, feats, fit, keep=None, test="m >= DATE '2000-01-01'", **kw):
    return WF.walk_forward(model_panel(spark, d), ["tenor"], "m", feats, "gap", fit, test=test, keep=keep, **kw)


# Counts and baselines of every walk-forward have a SQL twin; predictions are checked in tests against numpy.
_N = "SELECT a.tenor, a.m AS fold, count(b.gap) AS n_train, round(CASE WHEN count(b.gap) >= {least} AND any_value(a.iv_lag1) IS NOT NULL AND any_value(a.rv_lag1) IS NOT NULL THEN avg(b.gap) END, 6) AS baseline FROM f a LEFT JOIN f b ON a.tenor = b.tenor AND b.m < a.m AND b.gap IS NOT NULL AND b.iv_lag1 IS NOT NULL AND b.rv_lag1 IS NOT NULL WHERE a.m >= DATE '{start}' GROUP BY 1, 2"


def _ridge(spark, d, feats, test="m >= DATE '2000-01-01'", min_train=15):
    return PG.ridge_walk_forward(features(spark, d), ["tenor"], "m", feats, "gap", min_train=min_train, test=test)


def _frame(spark, d, test, min_train):
    folds = PG.fold_sums(features(spark, d), ["tenor"], "m", _FS, "gap", test)
    return PG.frame(folds, ["tenor"], len(_FS), min_train).select("tenor", "fold", "n_train", r6("baseline").alias("baseline"))


@register("wf_two_mode_frame", sql("panel", f"WITH f AS ({_FEAT}) " + _N.format(least=15, start="2000-01-01")), dates="fold")
def _(spark, d):
    return _frame(spark, d, "m >= DATE '2000-01-01'", 15)


@register("wf_two_mode")
def _(spark, d):
    a = _ridge(spark, d, _FS).withColumnRenamed("pred", "pred_nlp")
    b = _ridge(spark, d, _FX).select("tenor", "fold", F.col("pred").alias("pred_regime"))
    return a.join(b, ["tenor", "fold"]).withColumns({"err_nlp": F.col("pred_nlp") - F.col("actual"), "err_regime": F.col("pred_regime") - F.col("actual")})


@register("wf_elasticnet")
def _(spark, d):
    return _walk(spark, d, _FX, WF.elastic_fit, test="m >= DATE '2001-01-01'", min_train=30, impute=True)


@register("wf_spread")
def _(spark, d):
    x = _walk(spark, d, _FX, WF.spread_fit())
    z = F.least(F.greatest(F.col("pred") / F.greatest(F.col("sigma"), F.lit(1e-8)), F.lit(-10.0)), F.lit(10.0))
    x = x.withColumn("z", F.when(F.col("pred").isNotNull(), z))  # greatest() and least() skip nulls
    return x.withColumn("signal", F.when(F.col("z") > 0.5, "steepener").when(F.col("z") < -0.5, "flattener").when(F.col("z").isNotNull(), "flat"))


@register("wf_full_regime")
def _(spark, d):
    """Same-regime rows plus the last year as a recency supplement, three models."""
    keep = lambda train, t: (train["regime"] == t["regime"]) | (train["m"] >= t["m"].replace(year=t["m"].year - 1))
    out = _walk(spark, d, _FS, WF.ridge_cv_fit, keep=keep, min_train=10).withColumnRenamed("pred", "pred_ridge")
    for name, feats, fit in (("pred_gbm", _FX, WF.boosted_fit), ("pred_spread", _FS, WF.spread_fit())):
        out = out.join(_walk(spark, d, feats, fit, keep=keep, min_train=10).select("tenor", "fold", F.col("pred").alias(name)), ["tenor", "fold"])
    return out


@register("wf_sign")
def _(spark, d):
    return _walk(spark, d, _FX, WF.sign_fit).withColumn("up", F.col("pred") > 0.5)


@register("wf_classify", sql("panel", "SELECT tenor, m, CAST(gap > quantile_cont(gap, 2.0 / 3) OVER (PARTITION BY tenor) AS INTEGER) AS top FROM panel WHERE gap IS NOT NULL"), dates="m")
def _(spark, d):
    """Labels of the top-tercile classifier; its threshold sees the full sample, as in the study it follows."""
    p = panel(spark, d).where("gap IS NOT NULL")
    t = p.groupBy("tenor").agg(F.percentile("gap", F.lit(2.0 / 3)).alias("cut"))
    return p.join(t, "tenor").select("tenor", "m", (F.col("gap") > F.col("cut")).cast("int").alias("top"))


@register("wf_classify_fit")
def _(spark, d):
    return _walk(spark, d, _FX, WF.sign_fit, min_train=20)


@register("wf_full_history", sql("panel", f"WITH f AS ({_FEAT}) " + _N.format(least=20, start="1995-01-01")), dates="fold")
def _(spark, d):
    return _frame(spark, d, None, 20)


@register("wf_iv_era")
def _(spark, d):
    x = _ridge(spark, d, _FS, test="m >= DATE '1999-01-01'", min_train=20)
    return x.join(panel(spark, d).select("tenor", F.col("m").alias("fold"), "iv", "rv"), ["tenor", "fold"]).withColumns({"iv_gap": F.col("pred") - F.col("iv"), "rv_gap": F.col("pred") - F.col("rv")})


@register("wf_forward_once")
def _(spark, d):
    a = _ridge(spark, d, _FS, test="m = DATE '2001-06-01'")
    b = _ridge(spark, d, _FX, test="m = DATE '2001-06-01'")
    return a.withColumn("mode", F.lit("nlp")).unionByName(b.withColumn("mode", F.lit("regime")))


@register("wf_forward_locked")
def _(spark, d):
    x = _ridge(spark, d, _FS, test="m = DATE '2001-06-01'")
    return x.withColumn("pct_error", (F.col("pred") - F.col("actual")) / F.nullif(F.abs("actual"), F.lit(0.0)) * 100)


@register("wf_ablation")
def _(spark, d):
    out = None
    for name, feats in (("all", _FX), ("no_regime", _FS), ("no_level", ["r1", "r2", "iv_odd"]), ("no_rv", ["iv_lag1", "r1", "r2"])):
        x = _ridge(spark, d, feats, test="m >= DATE '2001-01-01'").where("pred IS NOT NULL AND actual IS NOT NULL")
        s = x.agg(F.lit(name).alias("config"), F.count("*").alias("n"), F.avg(((F.col("pred") > F.col("baseline")) == (F.col("actual") > F.col("baseline"))).cast("double")).alias("shr"))
        out = s if out is None else out.unionByName(s)
    return out


@register("ml_loading_matrix", sql("panel", f"WITH f AS ({_FEAT}), z AS (SELECT tenor, gap AS y, (iv_lag1 - avg(iv_lag1) OVER w) / stddev_pop(iv_lag1) OVER w AS x FROM f WHERE gap IS NOT NULL AND iv_lag1 IS NOT NULL WINDOW w AS (PARTITION BY tenor)) SELECT tenor, 'iv_lag1' AS feature, round(regr_sxy(y, x) / (regr_sxx(y, x) + 1), 6) AS coef FROM z GROUP BY 1"))
def _(spark, d):
    x = features(spark, d).where("gap IS NOT NULL AND iv_lag1 IS NOT NULL")
    s = x.groupBy("tenor").agg(F.avg("iv_lag1").alias("mu"), F.stddev_pop("iv_lag1").alias("sd"))
    z = x.join(s, "tenor").withColumn("iv_lag1", (F.col("iv_lag1") - F.col("mu")) / F.col("sd"))
    return M.ols(z, ["iv_lag1"], "gap", ["tenor"], ridge=1.0).where("term = 'iv_lag1'").select("tenor", F.col("term").alias("feature"), r6("coef").alias("coef"))


@register("ml_ridge_cv")
def _(spark, d):
    return M.grouped_fit(features(spark, d), ["tenor"], _FX, "gap", "ridge_cv")


@register("ml_elasticnet_cv")
def _(spark, d):
    return M.grouped_fit(features(spark, d), ["tenor"], _FX, "gap", "elastic_net_cv")


@register("ml_logistic")
def _(spark, d):
    return M.grouped_fit(features(spark, d), ["tenor"], _FX, "gap", "logistic")


@register("ml_gbm")
def _(spark, d):
    return M.grouped_predict_boosted(features(spark, d), ["tenor"], "m", _FX, "gap")
