"""Folds from prefix Gram matrices against fits of each fold's own rows, in one part and in many."""

import numpy as np
import pandas as pd
import pytest
from eventide.operators import fits, prefix_gram


def table(seed, n=90):
    rng = np.random.default_rng(seed)
    parts = []
    for key, size in (("a", n), ("b", n // 2), (None, 20)):
        x = np.column_stack([rng.normal(100, 5, size), rng.normal(0, 1e-3, size), np.full(size, 7.0)])
        y = x[:, 0] * 0.3 + x[:, 1] * 200 + rng.normal(0, 1, size)
        parts.append(pd.DataFrame({"k": key, "t": np.arange(size) * 2 // 3, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": y}))  # some rows share a time
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[::11, "y"] = np.nan
    pdf.loc[5::13, "x2"] = np.nan
    return pdf


@pytest.mark.parametrize("pack", [{}, {"part_rows": 9, "pack_rows": 8, "pack_folds": 5}])
def test_folds_equal_their_own_fits(spark, pack):
    pdf = table(1)
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "k string, t long, x1 double, x2 double, x3 double, y double").repartition(3)
    names = ["x1", "x2", "x3"]
    got = prefix_gram.ridge_walk_forward(df, ["k"], "t", names, "y", min_train=15, test="t >= 8", **pack).toPandas()
    assert len(got) == sum(g.t[g.t >= 8].nunique() for _, g in pdf.fillna({"k": "~"}).groupby("k"))
    seen = 0
    for r in got.itertuples(index=False):
        own = pdf[pdf.k.isna() if r.k is None else pdf.k == r.k]
        train = own[(own.t < r.fold) & own.y.notna() & own.x2.notna()]
        assert r.n_train == len(train)
        at = own[own.t == r.fold]
        if len(train) < 15 or (len(at) == 1 and at.x2.isna().any()):
            assert r.pred != r.pred and r.baseline != r.baseline
        elif len(at) == 1:
            x, xt = fits.standardise(train[names].to_numpy(), at[names].to_numpy())
            w, b, _ = fits.ridge_cv(x, train.y.to_numpy())
            assert r.pred == pytest.approx(float((xt @ w + b)[0]), rel=1e-6)
            assert r.baseline == pytest.approx(train.y.mean()) and r.sigma == pytest.approx((train.y - x @ w - b).std(ddof=0), rel=1e-5)
            seen += 1
    assert seen > 15


def test_no_plan_holds_a_whole_key(spark):
    rows = [("a", i, float(i % 7), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double")
    out = prefix_gram.ridge_walk_forward(df, ["k"], "t", ["x"], "y", part_rows=20, pack_rows=20, pack_folds=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    assert prefix_gram.ridge_walk_forward(df.where("false"), ["k"], "t", ["x"], "y").count() == 0
