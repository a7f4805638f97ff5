"""Walk-forward ridge regression from prefix Gram matrices.

Each fold trains on all strictly earlier rows of its key. Instead of giving a fold those rows, a row's products (1, x, y)'(1, x, y) are
summed by time and run forward by a prefix scan, so that each fold has the normal equations of its training rows: means, scales and
the standardised Gram matrix follow from them, and so do, for any penalty, coefficients and the error's scale.

The penalty is the one with the least leave-one-out error, which needs each training row's residual and leverage under the fold's
own equations. Rows are packed by parts of the key's time and folds by blocks; a pair of a block and an earlier part gives, for each
fold and penalty, one partial sum of squares, which an aggregate adds up. No frame holds more than one part and one block.

Where every key is one part, which is counted, a key's rows and folds are one frame, and its prefix sums a running sum inside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.ranges import cut, lookup, ordinal, parts_needed, running

#: Rows of a packed part and folds of a packed block; penalties tried.
PACK_ROWS, PACK_FOLDS = 4096, 256
ALPHAS = np.logspace(-2, 3, 40)


def _whole(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _pairs(k: int) -> list[tuple[int, int]]:
    """Places of the upper triangle of the Gram matrix of (1, x_1 .. x_k, y)."""
    return [(i, j) for i in range(k + 2) for j in range(i, k + 2)]


def fold_sums(df: DataFrame, by: list[str], at: str, features: list[str], y: str, test: str | None = None, part_rows: int | None = None) -> DataFrame:
    """One row for each fold: by, fold, _t (the fold's time as a number), actual, x (array of its features), gram (sums over earlier complete rows)."""
    cells = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    complete = cells[-1].isNotNull() & ~F.isnan(cells[-1]) & _whole(F.array(*cells[1:-1]))
    sums = [F.sum(F.when(complete, cells[i] * cells[j]).otherwise(0.0)).alias(f"_g{n}") for n, (i, j) in enumerate(_pairs(len(features)))]
    row = F.struct(cells[-1].alias("actual"), F.array(*cells[1:-1]).alias("x"))
    times = df.groupBy(*by, at).agg(*sums, F.first(row).alias("_row"), F.max(F.expr(test) if test else F.lit(True)).alias("_test"))
    names = [f"_g{n}" for n in range(len(sums))]
    scanned = running(times, by, at, {f"{g}_on": ("sum", g) for g in names}, current=False, part_rows=part_rows)
    gram = F.array(*[F.coalesce(f"{g}_on", F.lit(0.0)) for g in names])
    return scanned.where("_test").select(*by, F.col(at).alias("fold"), ordinal(df, at).alias("_t"), "_row.actual", "_row.x", gram.alias("gram"))


def frame(folds: DataFrame, by: list[str], k: int, min_train: int) -> DataFrame:
    """by, fold, actual, baseline (mean of the training targets) and n_train, from the sums alone."""
    n, total = F.col("gram")[0], F.col("gram")[_pairs(k).index((0, k + 1))]
    return folds.select(*by, "fold", "actual", F.when(_fits(k, min_train), total / n).alias("baseline"), n.cast("long").alias("n_train"))


def _fits(k: int, min_train: int) -> Column:
    """Whether a fold has enough training rows, and features itself."""
    return (F.col("gram")[0] >= min_train) & _whole(F.col("x"))


class Equations:
    """Standardised normal equations of many folds at once, from rows of sums."""

    def __init__(self, grams: np.ndarray, k: int) -> None:
        full = np.zeros((len(grams), k + 2, k + 2))
        for n, (i, j) in enumerate(_pairs(k)):
            full[:, i, j] = full[:, j, i] = grams[:, n]
        self.n = full[:, 0, 0]
        mean = full[:, 0, 1:] / self.n[:, None]
        self.mu, self.my = mean[:, :-1], mean[:, -1]
        centred = full[:, 1:, 1:] - self.n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        square = np.einsum("fii->fi", centred)[:, :-1]
        # a column that is constant up to rounding keeps scale 1 and has no spread
        moves = square > 1e-12 * np.einsum("fii->fi", full)[:, 1:-1]
        self.sd = np.where(moves, np.sqrt(np.maximum(square, 0) / self.n[:, None]), 1.0)
        scale = np.where(moves, 1 / self.sd, 0.0)
        s = centred[:, :-1, :-1] * scale[:, :, None] * scale[:, None, :]
        self.lam, self.v = np.linalg.eigh(s)
        self.lam = np.maximum(self.lam, 0)
        self.g = np.einsum("fji,fj->fi", self.v, centred[:, :-1, -1] * scale)
        self.yy = centred[:, -1, -1]
        self.scale = scale

    def turned(self, fold: int, x: np.ndarray) -> np.ndarray:
        """Rows standardised by the fold's training rows, on its principal axes."""
        return (x - self.mu[fold]) * self.scale[fold] @ self.v[fold]


def loo_errors(eq: Equations, fold: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of squared leave-one-out residuals of some of a fold's training rows, for each penalty."""
    z = eq.turned(fold, x)
    shrink = 1 / (eq.lam[fold][:, None] + ALPHAS)
    rest = y[:, None] - eq.my[fold] - z @ (eq.g[fold][:, None] * shrink)
    leverage = 1 / eq.n[fold] + (z * z) @ shrink
    return ((rest / np.maximum(1e-12, 1 - leverage)) ** 2).sum(0)


def solved(eq: Equations, errors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and error scales of folds with features ``x``, each at its best penalty."""
    w = eq.g / (eq.lam + ALPHAS[errors.argmin(axis=1)][:, None])
    pred = eq.my + np.array([eq.turned(f, x[f]) @ w[f] for f in range(len(x))])
    left = eq.yy - 2 * (w * eq.g).sum(1) + (w * w * eq.lam).sum(1)
    return pred, np.sqrt(np.maximum(left, 0) / eq.n)


def _errors(k: int, keys: list[str]):
    """Partial sums of a part's rows for each later fold of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, times, grams, t, xs, y in zip(*[pdf[c] for c in [*keys, "times", "grams", "ts", "xs", "ys"]]):
                eq, x = Equations(np.asarray(grams, dtype=float).reshape(len(times), -1), k), np.asarray(xs, dtype=float).reshape(-1, k)
                for fold, when in enumerate(times):
                    train = t < when
                    if not train.any():
                        continue
                    out.append((*key, float(when), loo_errors(eq, fold, x[train], y[train])))
            yield pd.DataFrame(out, columns=[*keys, "_t", "errors"])

    return run


def _finish(k: int, names: list[str]):
    """Prediction and error scale of each fold at its best penalty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pred, sigma = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            fit = np.flatnonzero(pdf["errors"].notna().to_numpy())
            if len(fit):
                stack = lambda c: np.stack(pdf[c].iloc[fit].to_numpy())
                pred[fit], sigma[fit] = solved(Equations(stack("gram"), k), stack("errors"), stack("x"))
            yield pdf.assign(pred=pred, sigma=sigma)[names]

    return run


def _whole_key(k: int, keys: list[str], min_train: int, names: list[str]):
    """All folds of keys of one part each."""

    def folds(t, fold, x, y, test):
        t, y, x = np.asarray(t, dtype=float), np.asarray(y, dtype=float), np.asarray(x, dtype=float).reshape(-1, k)
        able = np.isfinite(x).all(1)
        train = able & ~np.isnan(y)
        z = np.column_stack([np.ones(train.sum()), x[train], y[train]])
        sums = np.vstack([np.zeros(len(_pairs(k))), np.cumsum(np.column_stack([z[:, i] * z[:, j] for i, j in _pairs(k)]), axis=0)])
        first = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, dtype=bool)
        asked = np.flatnonzero(first & np.asarray(test, dtype=bool))
        upto = np.searchsorted(t[train], t[asked], "left")
        n = len(asked)
        pred, base, sigma = (np.full(n, np.nan) for _ in range(3))
        fit = np.flatnonzero((upto >= max(1, min_train)) & able[asked])
        if len(fit):
            eq, tx, ty = Equations(sums[upto[fit]], k), x[train], y[train]
            errors = np.array([loo_errors(eq, f, tx[:m], ty[:m]) for f, m in enumerate(upto[fit])])
            pred[fit], sigma[fit] = solved(eq, errors, x[asked[fit]])
            base[fit] = eq.my
        return pd.DataFrame({"fold": [fold[i] for i in asked], "actual": y[asked], "pred": pred, "baseline": base, "sigma": sigma, "n_train": upto})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *key, t, fold, x, y, test in zip(*[pdf[c] for c in [*keys, "_t", "_fold", "_x", "_y", "_test"]]):
                yield folds(t, fold, x, y, test).assign(**dict(zip(keys, key)))[names]

    return run


def ridge_walk_forward(df: DataFrame, by: list[str], at: str, features: list[str], y: str, min_train: int = 15, test: str | None = None, part_rows: int | None = None, pack_rows: int | None = None, pack_folds: int | None = None) -> DataFrame:
    """(by, fold, actual, pred, baseline, sigma, n_train): ridge on standardised features, its penalty by leave-one-out errors.

    Rows without target or features do not train; below ``min_train`` rows, or without features, there is no prediction. Of rows of one key
    and time one is the fold's, and all train later folds.
    """
    k, kinds = len(features), {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keyed = "".join(f"{b} {kinds[b]}, " for b in by)
    names = [*by, "fold", "actual", "pred", "baseline", "sigma", "n_train"]
    schema = f"{keyed}fold {kinds[at]}, actual double, pred double, baseline double, sigma double, n_train long"
    none = F.lit(None).cast("double")
    if part_rows is None and parts_needed(df, by, pack_rows or PACK_ROWS) == 1:
        nan = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        row = F.struct(ordinal(df, at).alias("_t"), F.col(at).alias("_fold"), F.array(*[nan(f) for f in features]).alias("_x"), nan(y).alias("_y"), (F.expr(test) if test else F.lit(True)).alias("_test"))
        packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        packed = packed.select(*by, "_rows._t", "_rows._fold", F.flatten("_rows._x").alias("_x"), "_rows._y", F.transform("_rows._test", lambda v: F.coalesce(v, F.lit(False))).alias("_test"))
        out = packed.mapInPandas(_whole_key(k, by, min_train, names), schema)
        return out.withColumns({c: F.nanvl(c, none) for c in ("actual", "pred", "baseline", "sigma")})
    folds = fold_sums(df, by, at, features, y, test, part_rows)
    able = folds.where(_fits(k, min_train))

    cells = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(*by, at, cells.alias("_x"), F.col(y).cast("double").alias("_y")).where(F.col("_y").isNotNull() & ~F.isnan("_y") & _whole(F.col("_x")))
    rows = cut(rows, by, at, parts_needed(rows, by, pack_rows, PACK_ROWS)).withColumn("_t", ordinal(df, at))
    place = F.array_sort(F.collect_list(F.struct("_t", "_x", "_y")))
    parts = rows.groupBy(*by, "_part").agg(place.alias("_rows"), F.min("_t").alias("_from"))
    parts = parts.select(*by, "_from", F.col("_rows._t").alias("ts"), F.flatten("_rows._x").alias("xs"), F.col("_rows._y").alias("ys"))
    blocks = cut(able, by, "_t", parts_needed(able, by, pack_folds, PACK_FOLDS))
    blocks = blocks.groupBy(*by, "_part").agg(F.array_sort(F.collect_list(F.struct("_t", "gram"))).alias("_folds"), F.max("_t").alias("_upto"))
    blocks = blocks.select(*by, "_upto", F.col("_folds._t").alias("times"), F.flatten("_folds.gram").alias("grams"))

    pairs = _joined(blocks, parts, by).where("_from < _upto").select(*by, "times", "grams", "ts", "xs", "ys")
    sums = pairs.mapInPandas(_errors(k, by), f"{keyed}_t double, errors array<double>")
    total = sums.groupBy(*by, "_t").agg(F.array(*[F.sum(F.col("errors")[i]) for i in range(len(ALPHAS))]).alias("errors"))
    chosen = lookup(folds, total, [*by, "_t"], "left")
    base = F.when(F.col("errors").isNotNull(), F.col("gram")[_pairs(k).index((0, k + 1))] / F.col("gram")[0])
    ready = chosen.select(*by, "fold", "actual", base.alias("baseline"), F.col("gram")[0].cast("long").alias("n_train"), "x", "gram", "errors")
    out = ready.mapInPandas(_finish(k, names), schema)
    return out.withColumns({c: F.nanvl(c, none) for c in ("pred", "sigma")})


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Every block of a key with every part of it."""
    held = b.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(by)], *[c for c in b.columns if c not in by])
    match = [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(by)]
    return a.join(held, match) if by else a.crossJoin(held)
