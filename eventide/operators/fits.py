"""Small dense models in numpy, fitted inside grouped Arrow batches. Inputs are a fold's rows: at most thousands."""

from __future__ import annotations

import numpy as np


def standardise(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population scaling fitted on the training rows; constant columns keep scale 1."""
    mu, sd = train.mean(0), train.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    return (train - mu) / sd, (test - mu) / sd


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and a free intercept."""
    mx, my = x.mean(0), y.mean()
    a = x - mx
    w = np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ (y - my)) if x.shape[1] else np.zeros(0)
    return w, float(my - mx @ w)


def ridge_cv(x: np.ndarray, y: np.ndarray, alphas: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Ridge whose penalty has the smallest leave-one-out error, exactly, from one decomposition."""
    alphas = np.logspace(-2, 3, 40) if alphas is None else alphas
    n, my = len(y), y.mean()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    uy, best = u.T @ (y - my), (np.inf, alphas[0])
    for a in alphas:
        d = s**2 / (s**2 + a)
        fit = u @ (d * uy) + my
        h = (u**2) @ d + 1 / n
        best = min(best, (float(np.mean(((y - fit) / np.maximum(1e-12, 1 - h)) ** 2)), float(a)))
    w, b = ridge(x, y, best[1])
    return w, b, best[1]


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, sweeps: int = 300, tol: float = 1e-7, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on centred data: squared error / 2n + alpha (l1 |w| + (1 - l1) |w|^2 / 2)."""
    n, p = x.shape
    w = np.zeros(p) if start is None else start.copy()
    norm, r = (x**2).sum(0) / n, y - x @ w
    for _ in range(sweeps):
        moved = 0.0
        for j in range(p):
            if norm[j] == 0:
                continue
            old = w[j]
            g = x[:, j] @ r / n + norm[j] * old
            w[j] = np.sign(g) * max(abs(g) - alpha * l1, 0) / (norm[j] + alpha * (1 - l1))
            if w[j] != old:
                r -= x[:, j] * (w[j] - old)
                moved = max(moved, abs(w[j] - old))
        if moved < tol:
            break
    return w


def elastic_net_cv(x: np.ndarray, y: np.ndarray, ratios=(0.1, 0.5, 0.9, 0.99), n_alphas: int = 100, k: int = 5) -> tuple[np.ndarray, float, float, float]:
    """(coefficients, intercept, alpha, l1 ratio) by k contiguous folds over a path of penalties per ratio."""
    n = len(y)
    folds = np.array_split(np.arange(n), min(k, n))
    best = (np.inf, 1.0, ratios[0])
    for l1 in ratios:
        top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / n / l1 if n else 1.0
        path = np.geomspace(max(top, 1e-12), max(top, 1e-12) * 1e-3, n_alphas)
        errors = np.zeros(n_alphas)
        for f in folds:
            keep = np.setdiff1d(np.arange(n), f)
            mx, my, w = x[keep].mean(0), y[keep].mean(), None
            for i, a in enumerate(path):
                w = elastic_net(x[keep] - mx, y[keep] - my, a, l1, sweeps=50, start=w)
                errors[i] += ((y[f] - my - (x[f] - mx) @ w) ** 2).sum()
        i = int(errors.argmin())
        best = min(best, (float(errors[i]), float(path[i]), l1))
    mx, my = x.mean(0), y.mean()
    w = elastic_net(x - mx, y - my, best[1], best[2])
    return w, float(my - mx @ w), best[1], best[2]


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression (penalty |w|^2 / 2c on the sum of losses, intercept free) by Newton steps."""
    a = np.column_stack([np.ones(len(y)), x])
    pen = np.diag([0.0] + [1 / c] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pen @ w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pen + 1e-9 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[1:], float(w[0])


def bayes_ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted ridge to a non-zero prior mean: posterior mean, covariance, and sigma^2 that counts the prior's rows."""
    xw = x * weight[:, None]
    a = xw.T @ x + np.diag(strength)
    inv = np.linalg.pinv(a)
    beta = inv @ (xw.T @ y + strength * prior)
    res = weight * (y - x @ beta) ** 2
    n_aug = len(y) + len(prior)
    sigma2 = float((res.sum() + (strength * (prior - beta) ** 2).sum()) / max(1, n_aug - len(prior)))
    return beta, sigma2 * inv, sigma2


def principal(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, explained shares) of standardised columns; the largest loading of each component is positive."""
    z, _ = standardise(x, x)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]), values[order] / values.sum()


class Boosted:
    """Least-squares boosting of small trees grown best leaf first over quantile bins."""

    def __init__(self, leaves: int = 4, rounds: int = 100, rate: float = 0.08, l2: float = 5.0, bins: int = 32, features: float = 0.8, least: int = 5, seed: int = 0) -> None:
        self.leaves, self.rounds, self.rate, self.l2, self.bins, self.features, self.least, self.seed = leaves, rounds, rate, l2, bins, features, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        self.base, self.trees = float(y.mean()), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        fit = np.full(len(y), self.base)
        for _ in range(self.rounds):
            r, pick = y - fit, np.sort(rng.permutation(x.shape[1])[: max(1, round(self.features * x.shape[1]))])
            parts, splits = [np.arange(len(y))], []
            while len(parts) < self.leaves:
                best = max((self._best(x, r, rows, pick, cuts) + (i,) for i, rows in enumerate(parts)), default=(0,))
                if best[0] <= 1e-12:
                    break
                _, j, cut, i = best
                left = x[parts[i], j] <= cut
                splits.append((i, int(j), float(cut)))
                parts[i : i + 1] = [parts[i][left], parts[i][~left]]
            values = [float(r[p].sum() / (len(p) + self.l2)) for p in parts]
            for p, v in zip(parts, values):
                fit[p] += self.rate * v
            self.trees.append((splits, values))
        return self

    def _best(self, x, r, rows, pick, cuts) -> tuple[float, int, float]:
        total, n, out = r[rows].sum(), len(rows), (0.0, 0, 0.0)
        for j in pick:
            order = np.searchsorted(cuts[j], x[rows, j])
            sums, counts = np.bincount(order, r[rows], len(cuts[j]) + 1).cumsum()[:-1], np.bincount(order, minlength=len(cuts[j]) + 1).cumsum()[:-1]
            ok = (counts >= self.least) & (n - counts >= self.least)
            gain = np.where(ok, sums**2 / (counts + self.l2) + (total - sums) ** 2 / (n - counts + self.l2) - total**2 / (n + self.l2), 0)
            if len(gain) and gain.max() > out[0]:
                out = (float(gain.max()), int(j), float(cuts[j][gain.argmax()]))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, values in self.trees:
            parts = [np.arange(len(x))]
            for i, j, cut in splits:
                left = x[parts[i], j] <= cut
                parts[i : i + 1] = [parts[i][left], parts[i][~left]]
            for p, v in zip(parts, values):
                out[p] += self.rate * v
        return out
