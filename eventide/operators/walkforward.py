"""Walk-forward evaluation: training rows strictly earlier than the test row.

Folds are dealt in blocks of consecutive test rows of a key. A block gets the key's rows up to its last fold once, and fits
its folds one after the other with numpy, so rows travel once for a block of folds and not once for each fold. Nothing of a
later row reaches an earlier prediction, except where a query says so on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, float]]

#: Which earlier rows train a fold: from the earlier rows and the test row to a mask.
Keep = Callable[[pd.DataFrame, pd.Series], pd.Series]


def fold_blocks(df: DataFrame, by: list[str], at: str, test: str | None = None, block: int = 64) -> DataFrame:
    """Rows of each block (``_block``) of a key: all up to its last fold, with the block's folds as array ``_folds``."""
    tests = (df.where(test) if test else df).select(*by, F.col(at).alias("_at")).distinct()
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_at")) - 1
    blocks = tests.withColumn("_block", F.floor(number / block)).groupBy(*by, "_block").agg(F.max("_at").alias("_last"), F.array_sort(F.collect_list("_at")).alias("_folds"))
    return blocks.join(df, by).where(F.col(at) <= F.col("_last")).drop("_last")


def walk_forward(df: DataFrame, by: list[str], at: str, features: list[str], y: str, fit: Fit, min_train: int = 15, impute: bool = False, test: str | None = None, keep: Keep | None = None, block: int = 64) -> DataFrame:
    """(by, fold, actual, pred, baseline, sigma, n_train): ``fit(x, y, x_test)`` gives a prediction and its error scale.

    Below ``min_train`` rows there is no prediction. Rows without target or features are left out of training, or
    get the training mean if ``impute``.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{b} {types[b]}" for b in by] + [f"fold {types[at]}", "actual double, pred double, baseline double, sigma double, n_train long"])
    names = [*by, "fold", "actual", "pred", "baseline", "sigma", "n_train"]

    def one(train: pd.DataFrame, test_row: pd.Series) -> tuple:
        train = train[train[y].notna()]
        x = train[features].to_numpy(dtype=float)
        xt = test_row[features].to_numpy(dtype=float)[None]
        if impute and len(x):
            mu = np.nan_to_num(np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=0)) if np.isfinite(x).any() else np.zeros(x.shape[1])
            x, xt = np.where(np.isfinite(x), x, mu), np.where(np.isfinite(xt), xt, mu)
        ok = np.isfinite(x).all(1) if len(x) else np.zeros(0, dtype=bool)
        x, target = x[ok], train[y].to_numpy(dtype=float)[ok]
        pred = sigma = base = None
        if len(target) >= min_train and np.isfinite(xt).all():
            pred, sigma = fit(x, target, xt)
            base = float(target.mean())
        return test_row[y], pred, base, sigma, len(target)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        out = []
        for fold in pdf["_folds"].iloc[0]:
            test_row, train = pdf[pdf[at] == fold].iloc[0], pdf[pdf[at] < fold]
            if keep is not None and len(train):
                train = train[keep(train, test_row)]
            out.append((*[test_row[b] for b in by], fold, *one(train, test_row)))
        return pd.DataFrame(out, columns=names)

    return fold_blocks(df, by, at, test, block).groupBy(*by, "_block").applyInPandas(run, schema)


# ---- fits ------------------------------------------------------------------------------------------


def ridge_cv_fit(x, y, xt):
    from eventide.operators.fits import ridge_cv, standardise

    a, b = standardise(x, xt)
    w, c, _ = ridge_cv(a, y)
    return float((b @ w + c)[0]), float((y - a @ w - c).std())


def elastic_fit(x, y, xt):
    from eventide.operators.fits import elastic_net_cv, standardise

    a, b = standardise(x, xt)
    w, c, _, _ = elastic_net_cv(a, y, n_alphas=30)
    return float((b @ w + c)[0]), float((y - a @ w - c).std())


def boosted_fit(x, y, xt):
    from eventide.operators.fits import Boosted

    m = Boosted().fit(x, y)
    return float(m.predict(xt)[0]), float((y - m.predict(x)).std())


def sign_fit(x, y, xt):
    """Probability that the target lies above the training median."""
    from eventide.operators.fits import logistic, standardise

    a, b = standardise(x, xt)
    w, c = logistic(a, (y > np.median(y)).astype(float))
    return float(1 / (1 + np.exp(-(b @ w + c)[0]))), 0.0


def spread_fit(bandwidth: float = 2.0, strength: float = 5.0):
    """Kernel-weighted ridge towards a zero prior: weights fall with the standardised distance from the test row."""

    def fit(x, y, xt):
        from eventide.operators.fits import bayes_ridge, standardise

        a, b = standardise(x, xt)
        w = np.exp(-np.sqrt(((a - b) ** 2).sum(1)) / bandwidth)
        w /= w.sum()
        one, tail = np.column_stack([np.ones(len(a)), a]), np.r_[1.0, b[0]]
        k = one.shape[1]
        beta, cov, s2 = bayes_ridge(one, y, w, np.zeros(k), np.full(k, strength))
        return float(tail @ beta), float(np.sqrt(max(0.0, tail @ cov @ tail) + s2))

    return fit
