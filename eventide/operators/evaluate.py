"""Evaluation: metrics, tails, sign hits, percentiles of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import stats as ST


def priority_pick(df: DataFrame, by: list[str], priority: str, cols: list[str]) -> DataFrame:
    """Per group the value of the row with the highest priority, the group's maximum where that is null."""
    pick = lambda c: F.coalesce(F.max_by(F.struct(c), priority)[c], F.max(c)).alias(c)
    return df.groupBy(*by).agg(*[pick(c) for c in cols])


def regression_metrics(df: DataFrame, by: list[str], actual: str, pred: str) -> DataFrame:
    """n, rmse, mae, r2 and sign-hit rate against the group's mean, in two aggregates and no window over raw rows."""
    mu = df.groupBy(*by).agg(F.avg(actual).alias("_mu")) if by else df.agg(F.avg(actual).alias("_mu"))
    x = df.join(mu, by) if by else df.crossJoin(F.broadcast(mu))
    a, p, m = F.col(actual), F.col(pred), F.col("_mu")
    return x.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.pow(a - p, 2))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
        (1 - F.sum(F.pow(a - p, 2)) / F.nullif(F.sum(F.pow(a - m, 2)), F.lit(0.0))).alias("r2"),
        F.avg(((p > m) == (a > m)).cast("int")).alias("shr"),
    )


def classification(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    yy, pp = F.col(y), F.col(p)
    base = F.avg(yy.cast("int"))
    prec = F.avg(F.when(pp, yy.cast("int")))
    return df.groupBy(*by).agg(F.avg((yy == pp).cast("int")).alias("accuracy"), prec.alias("prec"), F.avg(F.when(yy, pp.cast("int"))).alias("recall"), (prec / F.nullif(base, F.lit(0.0))).alias("lift"))


def auc(df: DataFrame, by: str, y: str, score: str) -> DataFrame:
    """Area under the ROC by the rank sum. Rows are first counted per distinct score, so ties cost one row."""
    c = df.groupBy(by, score).agg(F.count("*").alias("n"), F.count_if(y).alias("pos"))
    below = F.sum("n").over(Window.partitionBy(by).orderBy(score)) - F.col("n")
    r = c.withColumn("rank", below + (F.col("n") + 1) / 2)
    x = r.groupBy(by).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return x.select(by, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"))


def tail_risk(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """VaR 99 %, and the means of the tails at or below the 1 % and 5 % quantiles."""
    q = df.groupBy(*by).agg(F.percentile(x, F.lit(0.01)).alias("var99"), F.percentile(x, F.lit(0.05)).alias("_v5"))
    j = df.join(q, by)
    return j.groupBy(*by).agg(F.first("var99").alias("var99"), F.avg(F.when(F.col(x) <= F.col("var99"), F.col(x))).alias("es99"), F.avg(F.when(F.col(x) <= F.col("_v5"), F.col(x))).alias("es95"))


def centroid_distances(centroids: DataFrame, label: str, vec: str) -> DataFrame:
    """Euclidean distance of every two centroids; there are as many rows as labels, a small dimension."""
    a = centroids.select(F.col(label).alias("a"), F.col(vec).alias("va"))
    b = F.broadcast(centroids.select(F.col(label).alias("b"), F.col(vec).alias("vb")))
    diff = F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(diff).alias("dist"))


def sign_hits(df: DataFrame, by: list[str], pred: str, actual: str, strict: bool = True, empty: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Hits, rate and Wilson interval; signs compare by signum, or by (> 0) where not ``strict``."""
    hit = (F.signum(pred) == F.signum(actual)) if strict else ((F.col(pred) > 0) == (F.col(actual) > 0))
    x = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    lo, hi = ST.wilson(F.col("hits"), F.col("n"), empty=empty)
    return x.withColumns({"rate": F.col("hits") / F.col("n"), "lo": lo, "hi": hi})


def event_percentiles(df: DataFrame, by: str, at: str, event: str, features: list[str]) -> DataFrame:
    """Value, share of strictly earlier values below it (percent) and HIGH / LOW / MID flag of each feature of one event."""
    u = df.unpivot([by, at], features, "feature", "value").where(F.col("value").isNotNull())
    day = F.lit(event).cast("date")
    e = u.where(F.col(at) == day).select(by, "feature", "value")
    h = u.where(F.col(at) < day).select(by, "feature", F.col("value").alias("_h"))
    x = e.join(h, [by, "feature"]).groupBy(by, "feature", "value").agg((100.0 * F.count_if(F.col("_h") < F.col("value")) / F.count("*")).alias("pct"))
    return x.withColumn("flag", F.when(F.col("pct") >= 80, "HIGH").when(F.col("pct") <= 20, "LOW").otherwise("MID"))
