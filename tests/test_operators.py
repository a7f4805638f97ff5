"""Operators against hand-computed or scalar versions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from eventide.functions import options as O
from eventide.functions import scalar as SC
from eventide.functions import stats as ST
from eventide.functions import text as T
from eventide.functions import volatility as V
from eventide.operators import fits, models, ranges, walkforward
from eventide.operators import windows as W
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def series(spark, xs, key="k"):
    return spark.createDataFrame([(key, DAY + dt.timedelta(i), x) for i, x in enumerate(xs)], "k string, d date, x double")


def column(df, c="y"):
    return [None if r[c] is None else round(r[c], 4) for r in df.orderBy("d").collect()]


GAPS = [3.0, 1.0, 4.0, 1.0, 5.0, None, 9.0, 2.0]


def test_ewma_over_gaps(spark):
    df = ranges.ewma(series(spark, [None, *GAPS]), "x", "k", "d", 3, "y")
    want = pd.Series([None, *GAPS], dtype=float).ewm(span=3, adjust=False).mean()
    assert column(df) == [None if math.isnan(v) else round(v, 4) for v in want]


def test_expanding_rank_median_and_trailing_std(spark):
    df = series(spark, GAPS)
    assert column(W.expanding_rank(df, "x", "k", "d", "y")) == [1, 0.5, 1, 0.375, 1, None, 1, 0.4286]
    assert column(df.withColumn("y", F.percentile("x", F.lit(0.5)).over(W.expanding("k", "d")))) == [3, 2, 3, 2, 3, 3, 3.5, 3]
    assert column(ranges.bounded(df, "k", "d", 4, lambda w: {"y": W.trailing("x", w, 4)[1]})) == [None, None, 1.4142, 1.5275, 1.5, 2.0616, 2.0817, 4]


@pytest.mark.parametrize("how,want", [("lt", [None, 1, 2]), ("le", [1, 1, 3]), ("ge", [1, 2, 3])])
@pytest.mark.parametrize("bucket", ["day", "month", "year"])
def test_asof(spark, how, want, bucket):
    day = lambda n: DAY + dt.timedelta(n)
    left = spark.createDataFrame([(day(5),), (day(10),), (day(20),)], "e date")
    right = spark.createDataFrame([(day(5), 1), (day(12), 2), (day(20), 3), (None, 9)], "d date, v int")
    got = W.asof(left, right, ("e", "d"), ["v"], how=how, bucket=bucket).orderBy("e").collect()
    assert [r.v for r in got] == want


def test_asof_random_against_scan(spark):
    rng = np.random.default_rng(1)
    left = [(k, DAY + dt.timedelta(int(n))) for k in "ab" for n in rng.integers(0, 2000, 40)]
    right = [(k, DAY + dt.timedelta(int(n)), float(i)) for k in "ab" for i, n in enumerate(rng.permutation(2000)[:60])]
    l, r = spark.createDataFrame(left, "k string, e date"), spark.createDataFrame(right, "k string, d date, v double")
    got = sorted((x.k, x.e, x.v) for x in W.asof(l, r, ("e", "d"), ["v"], by=["k"], how="lt").collect())
    pick = lambda k, e: max(((d, v) for kk, d, v in right if kk == k and d < e), default=(None, None))[1]
    assert got == sorted((k, e, pick(k, e)) for k, e in left)


def test_interval_end_is_open(spark):
    days = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(9),), (DAY + dt.timedelta(10),)], "at date")
    span = spark.createDataFrame([(DAY, DAY + dt.timedelta(9), "x")], "s date, e date, label string")
    label = lambda closed: [r.label for r in W.interval_label(days, span, "at", "s", "e", ["label"], closed).orderBy("at").collect()]
    assert label(False) == ["x", None, None] and label(True) == ["x", "x", None]


def test_event_rows_count_from_the_event(spark):
    s = series(spark, [float(i) for i in range(10)]).withColumnRenamed("d", "at")
    e = spark.createDataFrame([(DAY + dt.timedelta(4),)], "ev date")
    got = {r.pos: r.x for r in W.event_rows(e, s, "k", "ev", "at", 1, 2).collect()}
    assert got == {-1: 3.0, 0: 4.0, 1: 5.0, 2: 6.0}


def test_range_estimators_guard_bad_bars(spark):
    bars = spark.createDataFrame([(1.0, 1.0, 2.0, 1.0), (0.0, 2.0, 1.0, 1.0), (2.0, 2.0, 2.0, 2.0), (1.0, 2.0, 1.0, 1.5)], "o double, h double, l double, c double")
    gk = V.garman_klass(*[F.col(c) for c in "ohlc"])
    rows = bars.select(V.parkinson(F.col("h"), F.col("l")).alias("p"), gk.alias("g"), V.annualise(gk).alias("a")).collect()
    assert rows[0].p is None and rows[0].g is None and rows[1].g is None
    assert rows[2].p == 0 and rows[2].g == 0 and rows[2].a is None
    assert rows[3].g == pytest.approx(0.5 * math.log(2) ** 2 - (2 * math.log(2) - 1) * math.log(1.5) ** 2)


def test_pricing_parity_and_textbook_values(spark):
    grid = [(f, k, t, s) for f in (95.0, 100.0) for k in (90.0, 100.0, 110.0) for t in (0.0, 0.25, 2.0) for s in (0.0, 0.2, 5.0)]
    df = spark.createDataFrame(grid, "f double, k double, t double, s double")
    c = [F.col(x) for x in "fkts"]
    b, m, bound = O.bachelier(*c), O.black76(*c, r=0.05), O.bound_black76(*c)
    flat = O.black76(*c)
    for r in df.select("*", b["call"].alias("bc"), b["put"].alias("bp"), m["call"].alias("mc"), m["put"].alias("mp"), flat["straddle"].alias("st"), bound["straddle"].alias("bs"), flat["delta"].alias("de"), bound["delta"].alias("bd")).collect():
        assert r.bc - r.bp == pytest.approx(r.f - r.k, abs=1e-7)
        if r.t > 0 and r.s > 0:
            assert r.mc - r.mp == pytest.approx(math.exp(-0.05 * r.t) * (r.f - r.k), abs=1e-7)
            cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
            d1 = (math.log(r.f / r.k) + r.s**2 * r.t / 2) / (r.s * math.sqrt(r.t))
            assert r.mc == pytest.approx(math.exp(-0.05 * r.t) * (r.f * cdf(d1) - r.k * cdf(d1 - r.s * math.sqrt(r.t))), abs=1e-4)
        assert r.st == pytest.approx(r.bs, abs=1e-9) and r.de == pytest.approx(r.bd, abs=1e-9)


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "k long, n long")
    lo, hi = ST.wilson(F.col("k"), F.col("n"))
    rows = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (rows[0].lo, rows[0].hi) == (0, 1) and rows[1].lo == 0 and rows[2].hi == 1
    assert ST.wilson(F.col("k"), F.col("n"), empty=(0.0, 0.0))[1] is not None


def test_student_t_matches_known_quantiles(spark):
    # two-sided 5 % points of Student's t
    known = [(12.706, 1), (2.776, 4), (2.228, 10), (1.984, 100)]
    df = spark.createDataFrame([(t, float(n)) for t, n in known], "t double, n double")
    for r in df.select(ST.student_t_two_sided(F.col("t"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=2e-4)


def test_business_days(spark):
    days = [DAY + dt.timedelta(i) for i in range(14)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 2, 5, 7):
        for r in df.select("d", SC.business_days_before(F.col("d"), n).alias("b")).collect():
            x, left = r.d, n
            while left:
                x -= dt.timedelta(1)
                left -= x.weekday() < 5
            assert r.b == x, (r.d, n)


def test_text_features(spark):
    df = spark.createDataFrame([("The thing, the risk of Risks.",), ("",), (None,)], "t string")
    r = df.select(T.token_density(F.col("t"), ["the", "risk"]).alias("d"), T.bigrams(T.words(F.col("t"))).alias("b"), T.word_count(F.col("t")).alias("n")).collect()
    assert r[0].d == pytest.approx(3 / 6) and r[0].b[0] == "the thing" and r[1].d is None and r[1].n == 0 and r[1].b == []
    turns = spark.createDataFrame([("intro\nCHAIR SMITH. Hello there.\nMR JONES: Why?\nnext line\nCHAIR SMITH. Because.",)], "t string").select(T.speaker_turns(F.col("t")).alias("x")).first().x
    assert [(x.speaker, x.said) for x in turns] == [("CHAIR SMITH", "Hello there."), ("MR JONES", "Why?\nnext line"), ("CHAIR SMITH", "Because.")]


# ---- models ------------------------------------------------------------------------------------------


def data(n=60, p=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, x @ np.array([1.0, -2.0, 0.0])[:p] + rng.normal(size=n)


def test_ridge_cv_picks_the_best_leave_one_out_penalty():
    x, y = data()
    alphas = np.logspace(-2, 3, 12)
    _, _, got = fits.ridge_cv(x, y, alphas)
    loo = []
    for a in alphas:
        e = [y[i] - (x[i] @ w + b) for i in range(len(y)) for w, b in [fits.ridge(np.delete(x, i, 0), np.delete(y, i), a)]]
        loo.append(np.mean(np.square(e)))
    assert got == alphas[int(np.argmin(loo))]


def test_elastic_net_limits():
    x, y = data()
    a, t = x - x.mean(0), y - y.mean()
    assert np.allclose(fits.elastic_net(a, t, 0.0, 0.5, sweeps=2000), np.linalg.lstsq(a, t, rcond=None)[0], atol=1e-4)
    assert np.allclose(fits.elastic_net(a, t, 1e3, 0.9), 0)
    assert np.allclose(fits.elastic_net(a, t, 0.5, 0.0, sweeps=2000), np.linalg.solve(a.T @ a + 0.5 * len(t) * np.eye(3), a.T @ t), atol=1e-5)


def test_logistic_gradient_vanishes():
    x, y = data()
    b = (y > 0).astype(float)
    w, c = fits.logistic(x, b, c=2.0)
    p = 1 / (1 + np.exp(-(x @ w + c)))
    assert np.allclose(x.T @ (p - b) + w / 2.0, 0, atol=1e-6) and abs((p - b).sum()) < 1e-6


def test_boosting_reduces_error_and_pca_has_fixed_signs():
    x, y = data(200)
    m = fits.Boosted().fit(x, y)
    assert np.mean((m.predict(x) - y) ** 2) < 0.5 * y.var()
    loadings, shares = fits.principal(x, 3)
    assert np.isclose(shares.sum(), 1) and all(v[np.abs(v).argmax()] > 0 for v in loadings.T)


def test_ols_hac_matches_numpy(spark):
    x, y = data(50, 2)
    rows = [("g", i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double, y double")
    got = {r.term: (r.coef, r.se) for r in models.ols_hac(df, ["a", "b"], "y", ["g"], ["i"], 3).collect()}
    z = np.column_stack([np.ones(50), x])
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    u = z * (y - z @ beta)[:, None]
    meat = u.T @ u
    for h in range(1, 4):
        g = u[h:].T @ u[:-h]
        meat += (1 - h / 4) * (g + g.T)
    se = np.sqrt(np.diag(inv @ meat @ inv) * 50 / 47)
    for i, t in enumerate(("const", "a", "b")):
        assert got[t] == (pytest.approx(beta[i]), pytest.approx(se[i]))


def test_earlier_stats_equal_aggregates_over_earlier_rows(spark):
    from eventide.operators.folds import earlier_rows, earlier_stats

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"k{i % 3}", int(rng.integers(0, 20)), None if i % 5 == 0 else float(i)) for i in range(120)], "k string, t int, x double")
    slow = earlier_rows(df, ["k"], "t").groupBy("k", "fold").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    got = {(r.k, r.t): (r.n_train, r.mean_train) for r in earlier_stats(df, ["k"], "t", "x").collect()}
    assert got == {(r.k, r.fold): (r.n, pytest.approx(r.m) if r.m is not None else None) for r in slow.collect()}


def test_walk_forward_never_looks_ahead(spark):
    rng = np.random.default_rng(3)
    rows = [("t", DAY + dt.timedelta(i), float(rng.normal()), float(rng.normal())) for i in range(30)]
    bent = rows[:-1] + [(*rows[-1][:3], 1e6)]

    def run(data):
        df = spark.createDataFrame(data, "tenor string, m date, f double, y double")
        out = [walkforward.walk_forward(df, ["tenor"], "m", ["f"], "y", walkforward.ridge_cv_fit, min_train=10, block=block) for block in (64, 7)]
        whole, blocks = ({r.fold: r.pred for r in x.collect()} for x in out)
        assert whole == blocks
        return whole

    a, b = run(rows), run(bent)
    assert a == b and sum(p is not None for p in a.values()) == 20
    x, y = np.array([[r[2]] for r in rows[:20]]), np.array([r[3] for r in rows[:20]])
    assert a[rows[20][1]] == pytest.approx(walkforward.ridge_cv_fit(x, y, np.array([[rows[20][2]]]))[0])


# ---- simulation ----------------------------------------------------------------------------------------


def scalar_straddle(f, k, t, s):
    if t <= 0 or s <= 0:
        return abs(f - k), (1.0 if f > k else -1.0)
    d = (f - k) / (s * math.sqrt(t))
    cdf, pdf = 0.5 * (1 + math.erf(d / math.sqrt(2))), math.exp(-d * d / 2) / math.sqrt(2 * math.pi)
    return 2 * ((f - k) * cdf + s * math.sqrt(t) * pdf) - (f - k), 2 * cdf - 1


def test_payoffs_stops_and_sizes_of_observed_moves(spark):
    from eventide.operators import sizing

    days = lambda n: DAY + dt.timedelta(n)
    prices = {"a": [10.0, 13.0, 12.0, 16.0], "b": [5.0, 5.0, 9.0, 8.0]}
    df = spark.createDataFrame([(k, days(i), v) for k, vs in prices.items() for i, v in enumerate(vs)] + [("a", days(9), 20.0)], "k string, d date, x double")
    got = sizing.straddle_payoffs(sizing.moves(df, "k", "d", "x"), "k", "d", "a", "b").orderBy("d").collect()
    fair = {"a": (3 + 1 + 4 + 4) / 4, "b": (0 + 4 + 1) / 3}
    assert [(r.front, r.back) for r in got] == [pytest.approx((p - fair["a"], fair["b"] - q)) for p, q in [(3, 0), (1, 4), (4, 1)]]
    paths = spark.createDataFrame([("p", i, v, 0.0) for i, v in enumerate([0.0, -2.0, -6.0, 1.0])] + [("q", 0, 0.0, 1.0), ("q", 1, 2.0, 1.0)], "path string, day int, pnl double, other double")
    slipped = sizing.slippage(paths, "path", "day", ["pnl", "other"], base=0.5, speed=1.0, lookback=2)
    assert [round(r.slip, 6) for r in slipped.orderBy("path", "day").collect()] == [1, 3, 4, 2.5, 1, 3]
    stops = sizing.first_stop(slipped, "path", "day", "pnl", [2.0, 5.0, 9.0])
    assert sorted((r.level, r.path, r.day, r.pnl) for r in stops.collect() if r.path == "p") == [(2.0, "p", 1, -5.0), (5.0, "p", 2, -10.0), (9.0, "p", None, 1.0)]
    stats = spark.createDataFrame([(0.1, 1.0, -3.0), (-1.0, 1.0, -3.0), (9.0, 1.0, 2.0)], "mu double, sd double, q01 double")
    assert [(r.kelly_f, r.var_lots, r.final_lots) for r in sizing.kelly_var(stats, cap=0.2, budget=30.0).collect()] == [(0.1, 10.0, 5), (0.0, 10.0, 1), (0.2, None, 1)]


def test_scores_are_cached_and_misses_written_back(spark, tmp_path):
    from eventide.operators import text as X

    calls = spark.sparkContext.accumulator(0)

    def load():
        def score(texts):
            calls.add(len(texts))
            return [float(len(t)) for t in texts]

        return score

    first = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "i int, t string")
    again = spark.createDataFrame([(1, "a"), (2, "ccc"), (3, "bb"), (4, None)], "i int, t string")
    path = str(tmp_path / "scores")
    run = lambda df: sorted((r.i, r.score, r.cached) for r in X.score_through_cache(df, path, "t", "|v1", load).collect())
    assert run(first) == [(1, 1.0, False), (2, 2.0, False), (3, 1.0, False), (4, None, False)] and calls.value == 2
    assert run(again) == [(1, 1.0, True), (2, 3.0, False), (3, 2.0, True), (4, None, False)] and calls.value == 3


def test_observation_source(spark, tmp_path):
    from eventide.sources import fred

    (tmp_path / "RATE.csv").write_text("date,value\n2020-01-01,1.5\n2020-01-02,.\nnonsense\n2020-02-01,2\n")
    fred.register(spark)
    rows = spark.read.format("observations").option("path", str(tmp_path / "RATE.csv")).option("end", "2020-01-31").load().orderBy("d").collect()
    assert [(r.series, r.d.day, r.value) for r in rows] == [("RATE", 1, 1.5), ("RATE", 2, None)]
