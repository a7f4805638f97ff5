"""Walk-forward folds: each test row with all strictly earlier rows of its key, or with sums over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def earlier_rows(df: DataFrame, by: list[str], at: str, test: DataFrame | None = None) -> DataFrame:
    """Training rows of every fold; ``fold`` is the test row's time. Joined on the key, so keys stay apart.

    The result has a row for each pair; for sums over the earlier rows use ``earlier_stats``.
    """
    folds = (test if test is not None else df).select(*by, F.col(at).alias("fold")).distinct()
    return folds.join(df, by).where(F.col(at) < F.col("fold")) if by else folds.join(df, F.col(at) < F.col("fold"))


def earlier_stats(df: DataFrame, by: list[str], at: str, x: str) -> DataFrame:
    """(by, at, n_train, mean_train) over strictly earlier rows, for times that have any: running sums over one row for each time."""
    times = df.groupBy(*by, at).agg(F.count("*").alias("_rows"), F.count(x).alias("_n"), F.sum(x).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(before)
    return times.select(*by, at, total("_rows").alias("n_train"), (total("_sum") / total("_n")).alias("mean_train")).where("n_train > 0")
