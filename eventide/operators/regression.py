"""Small linear models from sufficient statistics, and autocorrelation-robust means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newey_west_mean(df: DataFrame, by: list[str], order: list[str], x: str, lags: int) -> DataFrame:
    """n, mean, sd and the Bartlett-weighted t of the mean, from lagged products of deviations.

    One window and one aggregate: deviations are multiplied out, so the mean need not be known before the products are summed.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    e = df.withColumns({f"_l{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)})
    v = F.col(x)
    sums = [F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.var_pop(x).alias("_v"), F.count(x).alias("_n")]
    for k in range(1, lags + 1):
        old = F.col(f"_l{k}")
        sums += [F.sum(v * old).alias(f"_p{k}"), F.sum(F.when(v.isNotNull() & old.isNotNull(), v + old)).alias(f"_s{k}"), F.count(v + old).alias(f"_c{k}")]
    g = e.groupBy(*by).agg(*sums)
    lrv, mu = F.col("_v") * F.col("_n"), F.col("mean")
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"_p{k}") - mu * F.col(f"_s{k}") + F.col(f"_c{k}") * mu * mu, F.lit(0.0))
    g = g.withColumn("lrv", lrv / F.col("n"))
    return g.select(*by, "n", "mean", "sd", "lrv", (mu / F.sqrt(F.nullif(F.col("lrv"), F.lit(0.0)) / F.col("n"))).alias("t"))


def sufficient(df: DataFrame, features: list[str], y: str, by: list[str] = ()) -> DataFrame:
    """Per group n, X'X, X'y and y'y with a constant first; one aggregate whatever the rows."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(cols)
    xx = [F.sum(cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)]
    xy = [F.sum(cols[i] * F.col(y)).alias(f"xy_{i}") for i in range(k)]
    rows = df.na.drop(subset=[*features, y])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *xx, *xy, F.sum(F.col(y) * F.col(y)).alias("yy"))


def unpack(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    xx, xy = np.zeros((k, k)), np.array([row[f"xy_{i}"] for i in range(k)])
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"xx_{i}_{j}"]
    return xx, xy


def ols(df: DataFrame, features: list[str], y: str, by: list[str] = (), ridge: float = 0.0) -> DataFrame:
    """(by, term, coef, se, r2, n) of least squares, or of ridge with a free intercept, per group.

    Sums are built in the cluster; only k x k matrices, one per group, are solved in Python.
    """
    stats = sufficient(df, features, y, by)
    terms, k, keys = ["const", *features], len(features) + 1, list(by)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name in keys] + ["term string, coef double, se double, r2 double, n long"])

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                xx, xy = unpack(row, k)
                penalty = np.diag([0.0] + [ridge] * (k - 1))
                beta = np.linalg.pinv(xx + penalty) @ xy
                sse = row["yy"] - 2 * beta @ xy + beta @ xx @ beta
                sst = row["yy"] - xy[0] ** 2 / row["n"]
                dof = max(1, row["n"] - k)
                inv = np.linalg.pinv(xx + penalty)
                se = np.sqrt(np.maximum(0, np.diag(inv) * sse / dof))
                out += [{**{b: row[b] for b in keys}, "term": t, "coef": float(c), "se": float(s), "r2": float(1 - sse / sst) if sst > 0 else None, "n": int(row["n"])} for t, c, s in zip(terms, beta, se)]
            yield pd.DataFrame(out, columns=[*keys, "term", "coef", "se", "r2", "n"])

    return stats.mapInPandas(solve, schema)
