"""Grouped linear models. Sums are aggregated in the cluster; only small matrices are solved in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from eventide.operators.regression import ols, sufficient, unpack

__all__ = ["bayes_ridge", "fold_id", "grouped_fit", "grouped_predict_boosted", "kernel_weights", "loo_simple", "numeric_columns", "ols", "ols_hac", "pca"]


def _key_schema(df: DataFrame, by: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"{b} {types[b]}, " for b in by)


def ols_hac(df: DataFrame, features: list[str], y: str, by: list[str], order: list[str], lags: int) -> DataFrame:
    """OLS with Newey-West errors (Bartlett weights, factor n / (n - k)): by, term, coef, se, z, r2, n.

    Pass 1 gives the coefficients; pass 2 sums lagged products of the scores, whose sandwich is solved per group.
    """
    rows = df.na.drop(subset=[*features, y])
    terms, k = ["const", *features], len(features) + 1
    coef = ols(rows, features, y, by).groupBy(*by).pivot("term", terms).agg(F.first("coef"))
    coef = coef.toDF(*by, *[f"_b{i}" for i in range(k)])
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    joined = rows.join(coef, by) if by else rows.crossJoin(F.broadcast(coef))
    fit = sum((F.col(f"_b{i}") * x[i] for i in range(1, k)), F.col("_b0") * x[0])
    s = joined.withColumns({f"_s{i}": (F.col(y) - fit) * x[i] for i in range(k)})
    w = Window.partitionBy(*by).orderBy(*order)
    s = s.withColumns({f"_l{i}_{h}": F.lag(f"_s{i}", h).over(w) for i in range(k) for h in range(1, lags + 1)})
    meat = []
    for i in range(k):
        for j in range(k):
            total = F.sum(F.col(f"_s{i}") * F.col(f"_s{j}"))
            for h in range(1, lags + 1):
                total = total + (1 - h / (lags + 1)) * F.coalesce(F.sum(F.col(f"_s{i}") * F.col(f"_l{j}_{h}") + F.col(f"_l{i}_{h}") * F.col(f"_s{j}")), F.lit(0.0))
            meat.append(total.alias(f"m_{i}_{j}"))
    stats = sufficient(rows, features, y, by).join(s.groupBy(*by).agg(*meat), by)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                xx, xy = unpack(row, k)
                inv = np.linalg.pinv(xx)
                beta = inv @ xy
                m = np.array([[row[f"m_{i}_{j}"] for j in range(k)] for i in range(k)])
                n = row["n"]
                se = np.sqrt(np.maximum(0, np.diag(inv @ m @ inv)) * n / max(1, n - k))
                sst = row["yy"] - xy[0] ** 2 / n
                r2 = float(1 - (row["yy"] - beta @ xy) / sst) if sst > 0 else None
                out += [{**{b: row[b] for b in by}, "term": t, "coef": float(c), "se": float(e), "z": float(c / e) if e > 0 else None, "r2": r2, "n": int(n)} for t, c, e in zip(terms, beta, se)]
            yield pd.DataFrame(out, columns=[*by, "term", "coef", "se", "z", "r2", "n"])

    return stats.mapInPandas(solve, _key_schema(stats, by) + "term string, coef double, se double, z double, r2 double, n long")


def pca(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """by, component, feature, loading, share: eigenvectors of the correlation matrix, largest loading positive."""
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    corr = df.groupBy(*by).agg(*[F.corr(features[i], features[j]).alias(f"r_{i}_{j}") for i, j in pairs])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                r = np.eye(k)
                for i, j in pairs:
                    r[i, j] = r[j, i] = row[f"r_{i}_{j}"] if row[f"r_{i}_{j}"] == row[f"r_{i}_{j}"] else 0
                values, vectors = np.linalg.eigh(r)
                for c, o in enumerate(np.argsort(values)[::-1], 1):
                    v = vectors[:, o] * np.sign(vectors[np.abs(vectors[:, o]).argmax(), o])
                    out += [{**{b: row[b] for b in by}, "component": c, "feature": f, "loading": float(x), "share": float(values[o] / k)} for f, x in zip(features, v)]
            yield pd.DataFrame(out, columns=[*by, "component", "feature", "loading", "share"])

    return corr.mapInPandas(solve, _key_schema(corr, by) + "component int, feature string, loading double, share double")


def bayes_ridge(df: DataFrame, features: list[str], y: str, weight: str, prior: list[float], strength: list[float], by: list[str]) -> DataFrame:
    """Posterior mean and deviation of each coefficient of a weighted ridge towards a prior mean; no intercept is added."""
    k = len(features)
    cols = [F.col(f).cast("double") for f in features]
    w, t = F.col(weight), F.col(y)
    xx = [F.sum(w * cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)]
    xy = [F.sum(w * cols[i] * t).alias(f"xy_{i}") for i in range(k)]
    stats = df.na.drop(subset=[*features, y, weight]).groupBy(*by).agg(F.count("*").alias("n"), F.sum(w * t * t).alias("yy"), *xx, *xy)
    lam, mu = np.array(strength, dtype=float), np.array(prior, dtype=float)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a, b = unpack(row, k)
                inv = np.linalg.pinv(a + np.diag(lam))
                beta = inv @ (b + lam * mu)
                sse = row["yy"] - 2 * beta @ b + beta @ a @ beta + (lam * (mu - beta) ** 2).sum()
                sd = np.sqrt(np.maximum(0, np.diag(inv)) * max(0.0, sse) / max(1, row["n"]))
                out += [{**{g: row[g] for g in by}, "term": f, "coef": float(c), "sd": float(s), "n": int(row["n"])} for f, c, s in zip(features, beta, sd)]
            yield pd.DataFrame(out, columns=[*by, "term", "coef", "sd", "n"])

    return stats.mapInPandas(solve, _key_schema(stats, by) + "term string, coef double, sd double, n long")


def kernel_weights(folded: DataFrame, by: list[str], features: list[str], bandwidth: float) -> DataFrame:
    """weight: exp(-distance / bandwidth) to the fold's test row (columns t_<feature>), standardised on the fold, summing to 1."""
    stats = folded.groupBy(*by).agg(*[F.stddev_pop(f).alias(f"_sd_{f}") for f in features])
    x = folded.join(stats, by)
    scale = lambda f: F.when(F.col(f"_sd_{f}") > 0, F.col(f"_sd_{f}")).otherwise(1.0)
    dist = F.sqrt(sum(F.pow((F.col(f) - F.col(f"t_{f}")) / scale(f), 2) for f in features))
    k = x.withColumn("_k", F.exp(-dist / bandwidth))
    return k.withColumn("weight", F.col("_k") / F.sum("_k").over(Window.partitionBy(*by)))


def numeric_columns(df: DataFrame, leaks: list[str]) -> list[str]:
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in leaks)


def loo_simple(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Leave-one-out predictions of a one-regressor fit, from the residual and the leverage."""
    s = df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_sxx(y, x).alias("_sxx"))
    j = df.join(s, by)
    h = 1 / F.col("_n") + F.pow(F.col(x) - F.col("_mx"), 2) / F.nullif("_sxx", F.lit(0.0))
    e = F.col(y) - F.col("_a") - F.col("_b") * F.col(x)
    return j.withColumn("pred", F.col(y) - e / F.nullif(1 - h, F.lit(0.0)))


def fold_id(keys: list[str], k: int, seed: int) -> Column:
    """Shuffled fold of a row from its key, the same on any cluster."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % k


def grouped_fit(df: DataFrame, by: list[str], features: list[str], y: str, kind: str) -> DataFrame:
    """by, term, coef, penalty, n: a cross-validated model per group, on standardised features."""
    schema = _key_schema(df, by) + "term string, coef double, penalty double, n long"

    def run(pdf):
        from eventide.operators import fits

        rows = pdf.dropna(subset=[*features, y])
        x, t = rows[features].to_numpy(dtype=float), rows[y].to_numpy(dtype=float)
        names = [*by, "term", "coef", "penalty", "n"]
        if len(t) < 10:
            return pd.DataFrame(columns=names)
        z, _ = fits.standardise(x, x)
        if kind == "ridge_cv":
            w, b, pen = fits.ridge_cv(z, t)
        elif kind == "elastic_net_cv":
            w, b, pen, _ = fits.elastic_net_cv(z, t, n_alphas=30)
        else:
            w, b = fits.logistic(z, (t > np.median(t)).astype(float))
            pen = 1.0
        head = [rows[g].iloc[0] for g in by]
        return pd.DataFrame([[*head, n, float(c), float(pen), len(t)] for n, c in zip(["const", *features], [b, *w])], columns=names)

    return df.groupBy(*by).applyInPandas(run, schema)


def grouped_predict_boosted(df: DataFrame, by: list[str], at: str, features: list[str], y: str) -> DataFrame:
    """In-sample predictions of boosted trees per group."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = _key_schema(df, by) + f"{at} {types[at]}, actual double, pred double"

    def run(pdf):
        from eventide.operators.fits import Boosted

        rows = pdf.dropna(subset=[*features, y]).sort_values(at)
        out = rows[[*by, at]].assign(actual=rows[y])
        if len(rows) < 10:
            return out.assign(pred=np.nan)[[*by, at, "actual", "pred"]]
        x = rows[features].to_numpy(dtype=float)
        return out.assign(pred=Boosted().fit(x, rows[y].to_numpy(dtype=float)).predict(x))

    return df.groupBy(*by).applyInPandas(run, schema)
