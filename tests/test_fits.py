"""Registered queries that SQL cannot express, or only in part, each against a slow version written from its definition."""

import math
import os

import numpy as np
import pytest
from eventide import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")

PLAIN = ["iv_lag1", "rv_lag1"]
FULL = [*PLAIN, "r1", "r2", "iv_odd"]
ALPHAS = np.logspace(-2, 3, 40)


@pytest.fixture(scope="module")
def features(spark):
    """Rows of each tenor in order of month, from a query that has a DuckDB twin."""
    df = catalog.queries()["ml_feature_matrix"](spark, SF).toPandas()
    df["m"] = df["m"].astype(str)
    df["regime"] = np.where(df.r1 == 1, "easing", np.where(df.r2 == 1, "at_target", "slack"))
    return {t: g.sort_values("m").reset_index(drop=True) for t, g in df.groupby("tenor")}


def result(spark, name):
    df = catalog.queries()[name](spark, SF).toPandas()
    for c in ("fold", "m"):
        if c in df:
            df[c] = df[c].astype(str)
    assert len(df)
    return df


def scaled(x, xt):
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    return (x - mu) / sd, (xt - mu) / sd


def slow_ridge(x, y, alpha):
    """Intercept free: an augmented least-squares problem."""
    n, k = x.shape
    a = np.vstack([np.column_stack([np.ones(n), x]), np.column_stack([np.zeros(k), math.sqrt(alpha) * np.eye(k)])])
    return np.linalg.lstsq(a, np.r_[y, np.zeros(k)], rcond=None)[0]


def slow_ridge_cv(x, y):
    """The penalty with the least mean squared error over refits that leave one row out."""
    def error(alpha):
        out = 0.0
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            b = slow_ridge(x[keep], y[keep], alpha)
            out += (y[i] - b[0] - x[i] @ b[1:]) ** 2
        return out / len(y)

    return min(ALPHAS, key=error)


def one_ridge(x, y, xt):
    a, b = scaled(x, xt)
    w = slow_ridge(a, y, slow_ridge_cv(a, y))
    return w[0] + b @ w[1:]


def slow_logit(x, y):
    """Gradient descent with halved steps on the penalised loss."""
    a, w = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    pen = np.r_[0.0, np.ones(x.shape[1])]
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + (pen * w * w).sum() / 2
    step = 1.0
    for _ in range(20_000):
        g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y) + pen * w
        if np.abs(g).max() < 1e-7:
            break
        while loss(w - step * g) > loss(w) - step * (g @ g) / 2 and step > 1e-12:
            step /= 2
        w, step = w - step * g, step * 1.5
    return w


def one_sign(x, y, xt):
    a, b = scaled(x, xt)
    w = slow_logit(a, (y > np.median(y)).astype(float))
    return 1 / (1 + math.exp(-(w[0] + b @ w[1:])))


def one_spread(x, y, xt, bandwidth=2.0, strength=5.0):
    a, b = scaled(x, xt)
    w = np.exp(-np.linalg.norm(a - b, axis=1) / bandwidth)
    w /= w.sum()
    one, tail = np.column_stack([np.ones(len(a)), a]), np.r_[1.0, b]
    inv = np.linalg.inv(one.T @ np.diag(w) @ one + strength * np.eye(one.shape[1]))
    beta = inv @ one.T @ (w * y)
    s2 = ((w * (y - one @ beta) ** 2).sum() + strength * beta @ beta) / len(y)
    return tail @ beta, math.sqrt(tail @ (s2 * inv) @ tail + s2)


def slow_boost(x, y, leaves=4, rounds=100, rate=0.08, l2=5.0, bins=32, share=0.8, least=5):
    """Every leaf, feature and cut is tried by masks; returns the function of fitted trees."""
    rng = np.random.default_rng(0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    base, fit, trees = y.mean(), np.full(len(y), y.mean()), []
    for _ in range(rounds):
        r, pick = y - fit, sorted(rng.permutation(x.shape[1])[: max(1, round(share * x.shape[1]))])
        leaf, splits, n = np.zeros(len(y), dtype=int), [], 1
        while n < leaves:
            best = None
            for i in range(n):
                inside = leaf == i
                for j in pick:
                    for cut in cuts[j]:
                        left, right = inside & (x[:, j] <= cut), inside & (x[:, j] > cut)
                        if left.sum() >= least and right.sum() >= least:
                            gain = sum(r[s].sum() ** 2 / (s.sum() + l2) for s in (left, right)) - r[inside].sum() ** 2 / (inside.sum() + l2)
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                                best = gain, i, j, cut
            if best is None:
                break
            _, i, j, cut = best
            leaf[leaf > i] += 1
            leaf[(leaf == i) & (x[:, j] > cut)] = i + 1
            splits.append((i, j, cut))
            n += 1
        value = [r[leaf == i].sum() / ((leaf == i).sum() + l2) for i in range(n)]
        fit = fit + rate * np.array(value)[leaf]
        trees.append((splits, value))

    def predict(z):
        out = np.full(len(z), base)
        for splits, value in trees:
            at = np.zeros(len(z), dtype=int)
            for i, j, cut in splits:
                at[at > i] += 1
                at[(at == i) & (z[:, j] > cut)] = i + 1
            out += rate * np.array(value)[at]
        return out

    return predict


def folds(features, test, names, min_train=15, keep=None):
    """(tenor, fold, x, y, x_test, actual): training rows strictly earlier, complete, and enough of them."""
    for tenor, g in features.items():
        for _, t in g[g.m.map(test)].iterrows():
            train = g[(g.m < t.m) & g.gap.notna() & g[names].notna().all(axis=1)]
            if keep:
                train = train[[keep(r, t) for _, r in train.iterrows()]]
            x, xt = train[names].to_numpy(float), t[names].to_numpy(float)
            ok = len(train) >= min_train and np.isfinite(xt).all()
            yield tenor, t.m, x, train.gap.to_numpy(float), xt if ok else None, t.gap


def compare(found, want, column="pred", every=1, rel=1e-5):
    """``want(x, y, xt)`` for every n-th fold that has a prediction; n_train, baseline and missing predictions for all."""
    found = found.set_index(["tenor", "fold"])
    seen = 0
    for k, (tenor, fold, x, y, xt, actual) in enumerate(want[0]):
        row = found.loc[(tenor, fold)]
        assert row["n_train"] == len(y) if "n_train" in row else True
        assert row["actual"] == pytest.approx(actual) or (row["actual"] != row["actual"] and actual != actual)
        if xt is None:
            assert row[column] != row[column] or row[column] is None
        elif k % every == 0:
            assert row[column] == pytest.approx(want[1](x, y, xt), rel=rel, abs=1e-7), (tenor, fold)
            seen += 1
    assert seen > 3


def from_month(start):
    return lambda m: m >= start


def test_wf_two_mode(spark, features):
    out = result(spark, "wf_two_mode")
    compare(out, (folds(features, from_month("2000-01-01"), PLAIN), one_ridge), "pred_nlp", every=9)
    compare(out.drop(columns="n_train"), (folds(features, from_month("2000-01-01"), FULL), one_ridge), "pred_regime", every=23)
    assert np.allclose(out.err_nlp.dropna(), (out.pred_nlp - out.actual).dropna())


def test_wf_iv_era_and_forward_tests(spark, features):
    compare(result(spark, "wf_iv_era"), (folds(features, from_month("1999-01-01"), PLAIN, min_train=20), one_ridge), every=17)
    locked = result(spark, "wf_forward_locked")
    compare(locked, (folds(features, lambda m: m == "2001-06-01", PLAIN), one_ridge))
    assert np.allclose(locked.pct_error.dropna(), ((locked.pred - locked.actual) / locked.actual.abs() * 100).dropna())
    once = result(spark, "wf_forward_once")
    for mode, names in (("nlp", PLAIN), ("regime", FULL)):
        compare(once[once["mode"] == mode], (folds(features, lambda m: m == "2001-06-01", names), one_ridge))


def test_wf_ablation(spark, features):
    out = result(spark, "wf_ablation").set_index("config")
    for name, names in (("no_regime", PLAIN), ("no_rv", ["iv_lag1", "r1", "r2"])):
        hits = []
        for _, _, x, y, xt, actual in folds(features, from_month("2001-01-01"), names):
            if xt is not None and actual == actual:
                hits.append((one_ridge(x, y, xt) > y.mean()) == (actual > y.mean()))
        assert out.n[name] == len(hits) and out.shr[name] == pytest.approx(np.mean(hits))


def test_wf_spread_and_full_regime(spark, features):
    out = result(spark, "wf_spread")
    compare(out, (folds(features, from_month("2000-01-01"), FULL), lambda *a: one_spread(*a)[0]))
    compare(out.drop(columns="pred").rename(columns={"sigma": "pred"}), (folds(features, from_month("2000-01-01"), FULL), lambda *a: one_spread(*a)[1]))
    z = (out.pred / out.sigma.clip(lower=1e-8)).clip(-10, 10)
    assert np.allclose(out.z.dropna(), z.dropna())
    assert (out.signal[out.z > 0.5] == "steepener").all() and (out.signal[out.z < -0.5] == "flattener").all()

    def recent(r, t):
        year, month, _ = map(int, t.m.split("-"))
        return r.regime == t.regime or r.m >= f"{year - 1}-{month:02d}-01"

    regime = result(spark, "wf_full_regime")
    compare(regime, (folds(features, from_month("2000-01-01"), PLAIN, 10, recent), one_ridge), "pred_ridge", every=13)
    compare(regime, (folds(features, from_month("2000-01-01"), PLAIN, 10, recent), lambda *a: one_spread(*a)[0]), "pred_spread")
    compare(regime.drop(columns="n_train"), (folds(features, from_month("2000-01-01"), FULL, 10, recent), lambda x, y, xt: slow_boost(x, y)(xt[None])[0]), "pred_gbm", every=12, rel=1e-6)


def test_wf_sign(spark, features):
    compare(result(spark, "wf_sign"), (folds(features, from_month("2000-01-01"), FULL), one_sign), every=3, rel=1e-4)
    compare(result(spark, "wf_classify_fit"), (folds(features, from_month("2000-01-01"), FULL, 20), one_sign), every=3, rel=1e-4)
    out = result(spark, "wf_sign").dropna()
    assert (out.up == (out.pred > 0.5)).all()


def net_path(x, y, alpha, l1, steps=4000):
    """Proximal gradient on centred data."""
    n, w = len(y), np.zeros(x.shape[1])
    rate = 1 / (np.linalg.eigvalsh(x.T @ x / n).max() + alpha * (1 - l1) + 1e-12)
    for _ in range(steps):
        v = w - rate * (x.T @ (x @ w - y) / n + alpha * (1 - l1) * w)
        new = np.sign(v) * np.maximum(np.abs(v) - rate * alpha * l1, 0)
        if np.abs(new - w).max() < 1e-10:
            return new
        w = new
    return w


def net_error(x, y, alpha, l1, k=5):
    out = 0.0
    for f in np.array_split(np.arange(len(y)), min(k, len(y))):
        keep = np.setdiff1d(np.arange(len(y)), f)
        mx, my = x[keep].mean(0), y[keep].mean()
        w = net_path(x[keep] - mx, y[keep] - my, alpha, l1)
        out += ((y[f] - my - (x[f] - mx) @ w) ** 2).sum()
    return out


def best_net(x, y, n_alphas=30):
    grid = []
    for l1 in (0.1, 0.5, 0.9, 0.99):
        top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / len(y) / l1
        grid += [(net_error(x, y, a, l1), a, l1) for a in np.geomspace(top, top * 1e-3, n_alphas)]
    return min(grid)


def test_ml_elasticnet_cv_and_wf_elasticnet(spark, features):
    out = result(spark, "ml_elasticnet_cv")
    for k, (tenor, g) in enumerate(features.items()):
        rows = g.dropna(subset=[*FULL, "gap"])
        x, _ = scaled(rows[FULL].to_numpy(float), rows[FULL].to_numpy(float))
        y = rows.gap.to_numpy(float)
        mine = out[out.tenor == tenor].set_index("term")
        w, pen = mine.coef[FULL].to_numpy(), mine.penalty.iloc[0]
        assert mine.coef["const"] == pytest.approx(y.mean() - x.mean(0) @ w)
        fits = [np.abs(net_path(x - x.mean(0), y - y.mean(), pen, l1) - w).max() for l1 in (0.1, 0.5, 0.9, 0.99)]
        assert min(fits) < 1e-4
        if k == 0:  # no other penalty of the grid predicts better
            best = best_net(x, y)
            assert net_error(x, y, pen, (0.1, 0.5, 0.9, 0.99)[int(np.argmin(fits))]) == pytest.approx(best[0], rel=1e-3)
    walk = result(spark, "wf_elasticnet").set_index(["tenor", "fold"])
    tenor, g = next(iter(features.items()))
    t = g[g.m >= "2001-01-01"].iloc[-1]
    train = g[(g.m < t.m) & g.gap.notna()]
    x, xt = train[FULL].to_numpy(float), t[FULL].to_numpy(float)
    mu = np.nanmean(x, axis=0)
    a, b = scaled(np.where(np.isfinite(x), x, mu), np.where(np.isfinite(xt), xt, mu))
    y = train.gap.to_numpy(float)
    _, alpha, l1 = best_net(a, y)
    w = net_path(a - a.mean(0), y - y.mean(), alpha, l1)
    assert walk.pred[tenor, t.m] == pytest.approx(y.mean() + (b - a.mean(0)) @ w, rel=2e-3)


def test_ml_ridge_cv_logistic_and_gbm(spark, features):
    ridge, logit, boost = (result(spark, n) for n in ("ml_ridge_cv", "ml_logistic", "ml_gbm"))
    for k, (tenor, g) in enumerate(features.items()):
        rows = g.dropna(subset=[*FULL, "gap"])
        raw, y = rows[FULL].to_numpy(float), rows.gap.to_numpy(float)
        x, _ = scaled(raw, raw)
        mine = ridge[ridge.tenor == tenor].set_index("term")
        alpha = slow_ridge_cv(x, y)
        assert mine.penalty.iloc[0] == pytest.approx(alpha) and mine.coef[["const", *FULL]].to_numpy() == pytest.approx(slow_ridge(x, y, alpha), abs=1e-8)
        assert (mine.n == len(y)).all()
        w = logit[logit.tenor == tenor].set_index("term").coef[["const", *FULL]].to_numpy()
        assert w == pytest.approx(slow_logit(x, (y > np.median(y)).astype(float)), abs=1e-4)
        if k < 2:
            fitted = boost[boost.tenor == tenor].sort_values("m")
            assert list(fitted.m) == list(rows.m) and fitted.actual.to_numpy() == pytest.approx(y)
            assert fitted.pred.to_numpy() == pytest.approx(slow_boost(raw, y)(raw), rel=1e-9)


def test_pooled_regression_with_interactions(spark, features):
    import pandas as pd

    out = result(spark, "ml_ols_interact_pooled").set_index("term")
    p = pd.concat(features.values())
    p = p[p.rv.notna()]
    month = p.m.str[5:7].astype(int) % 3
    r1, r2 = (month == 1).astype(float), (month == 2).astype(float)
    x = np.column_stack([np.ones(len(p)), p.iv, r1, r2, p.iv * r1, p.iv * r2])
    beta, *_ = np.linalg.lstsq(x, p.rv.to_numpy(), rcond=None)
    res = p.rv.to_numpy() - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / (len(p) - 6))
    terms = ["const", "iv", "r1", "r2f", "iv_r1", "iv_r2"]
    assert out.coef[terms].to_numpy() == pytest.approx(beta, rel=1e-5, abs=1e-6) and out.se[terms].to_numpy() == pytest.approx(se, rel=1e-4, abs=1e-6)
    assert out.r2.iloc[0] == pytest.approx(1 - res @ res / ((p.rv - p.rv.mean()) ** 2).sum(), abs=2e-6)


def test_correlation_p_values(spark, features):
    out = result(spark, "agg_corr_pvalue").set_index("tenor")
    for tenor, g in features.items():
        g = g[g.gap.notna()]
        n, r = len(g), np.corrcoef(g.iv, g.gap)[0, 1]
        t, v = r * math.sqrt((n - 2) / (1 - r * r)), n - 2
        u = np.linspace(0, math.atan(abs(t) / math.sqrt(v)), 200_001)  # x = sqrt(v) tan u: the density is cos^(v - 1)
        area = np.trapezoid(np.cos(u) ** (v - 1), u) * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)
        assert out.r[tenor] == pytest.approx(r, abs=1e-6) and out.t[tenor] == pytest.approx(t, abs=1e-6) and out.p[tenor] == pytest.approx(1 - 2 * area, abs=1e-6)
