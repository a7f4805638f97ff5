"""Windows, scans and recurrences over series cut into parts, against the whole series in pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from eventide.operators import ranges as R
from eventide.operators import windows as W
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)
PARTS = [None, 17]


def series(spark, seed=0, n=150, gaps=0.2, kind="date"):
    rng = random.Random(seed)
    rows = []
    for k in ("a", "b", None):
        t = 0
        for i in range(n if k == "a" else n // 3):
            t += rng.choice([1, 1, 2, 30])
            at = DAY + dt.timedelta(t) if kind == "date" else float(t)
            rows.append((k, at, None if rng.random() < gaps or (k == "b" and 10 < i < 35) else rng.uniform(-5, 5), i))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, f"k string, d {'date' if kind == 'date' else 'double'}, x double, i int"), pd.DataFrame(rows, columns=["k", "d", "x", "i"])


def check(got, want, column):
    found = {(r.k, r.i): r[column] for r in got.collect()}
    assert len(found) == len(want)
    for k, i, v in want:
        assert found[(k, i)] == (None if v is None or v != v else pytest.approx(v, rel=1e-9, abs=1e-9)), (k, i)


def by_key(pdf, f):
    out = []
    for k, g in pdf.assign(k=pdf.k.fillna("~")).groupby("k"):
        g = g.sort_values("d")
        out += [(None if k == "~" else k, i, v) for i, v in zip(g.i, f(g.x))]
    return out


@pytest.mark.parametrize("part_rows", PARTS)
@pytest.mark.parametrize("kind", ["date", "double"])
def test_halo_windows(spark, part_rows, kind):
    df, pdf = series(spark, 1, kind=kind)
    make = lambda w: {"lag3": F.lag("x", 3).over(w), "lead2": F.lead("x", 2).over(w), "roll": F.sum("x").over(w.rowsBetween(-4, 1))} | dict(zip(("mean", "std"), W.trailing("x", w, 5, 2)))
    out = R.bounded(df, "k", "d", 5, make, after=2, part_rows=part_rows)
    assert out.columns == [*df.columns, "lag3", "lead2", "roll", "mean", "std"]
    out = out.cache()
    check(out, by_key(pdf, lambda x: x.shift(3)), "lag3")
    check(out, by_key(pdf, lambda x: x.shift(-2)), "lead2")
    check(out, by_key(pdf, lambda x: [np.nan if x.iloc[max(0, i - 4) : i + 2].isna().all() else x.iloc[max(0, i - 4) : i + 2].sum() for i in range(len(x))]), "roll")
    check(out, by_key(pdf, lambda x: x.shift(1).rolling(5, min_periods=2).mean()), "mean")
    check(out, by_key(pdf, lambda x: x.shift(1).rolling(5, min_periods=2).std()), "std")


@pytest.mark.parametrize("part_rows", PARTS)
@pytest.mark.parametrize("current", [True, False])
def test_prefix_scans(spark, part_rows, current):
    df, pdf = series(spark, 2)
    kinds = {"n": "count", "total": "sum", "mean": "avg", "sd": "std", "on": "last"}
    out = R.running(df.withColumn("x", F.col("x") + 1000), "k", "d", {name: (kind, "x") for name, kind in kinds.items()}, current=current, part_rows=part_rows).cache()
    before = 0 if current else 1
    grow = lambda f: by_key(pdf.assign(x=pdf.x + 1000), lambda x: f(x.shift(before).expanding(min_periods=0)))
    check(out, grow(lambda e: e.count()), "n")
    check(out, [(k, i, v if n else None) for (k, i, v), (_, _, n) in zip(grow(lambda e: e.sum()), grow(lambda e: e.count()))], "total")
    check(out, grow(lambda e: e.mean()), "mean")
    check(out, [(k, i, v if n > 1 else None) for (k, i, v), (_, _, n) in zip(grow(lambda e: e.std()), grow(lambda e: e.count()))], "sd")
    check(out, by_key(pdf.assign(x=pdf.x + 1000), lambda x: x.shift(before).ffill()), "on")


@pytest.mark.parametrize("part_rows", PARTS)
@pytest.mark.parametrize("span", [1, 3, 40])
@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_exponential_means(spark, part_rows, span, gaps):
    df, pdf = series(spark, 3, n=300, gaps=gaps)
    out = R.ewma(df, "x", "k", "d", span, "y", part_rows=part_rows)
    assert out.columns == [*df.columns, "y"]
    check(out, by_key(pdf, lambda x: x.ewm(span=span, adjust=False).mean()), "y")


def test_long_series_fall_through_many_segments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    x[5000:9000] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "d": np.arange(len(x), dtype=float), "i": np.arange(len(x)), "x": x})).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    want = pd.Series(x).ewm(span=3, adjust=False).mean()
    for part_rows in (None, 3000):
        got = R.ewma(df, "x", "k", "d", 3, "y", part_rows=part_rows).orderBy("i").toPandas().y
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("part_rows", [None, 3])
def test_row_numbers_without_keys_and_of_nothing(spark, part_rows):
    df = spark.createDataFrame([(i % 11, i) for i in range(40)], "t int, i int")
    got = [r.rn for r in R.numbered(df, [], ["t", "i"], "rn", part_rows=part_rows).orderBy("t", "i").collect()]
    assert got == list(range(40))
    assert R.bounded(df.where("false"), [], "t", 1, lambda w: {"p": F.lag("i").over(w)}, part_rows=part_rows).count() == 0
    assert R.running(df.where("false"), [], "t", {"s": ("sum", "i")}, part_rows=part_rows).count() == 0
    assert R.ewma(df.where("false"), "i", [], "t", 3, "y", part_rows=part_rows).count() == 0


def test_blocks_are_in_the_windows_partitioning(spark):
    df, _ = series(spark, 4)
    out = R.bounded(df, "k", "d", 1, lambda w: {"p": F.lag("x").over(w)}, part_rows=10)
    assert "_block" in out._jdf.queryExecution().executedPlan().toString().split("Window [lag")[1].split("\n")[0]
    out = R.ewma(df, "x", "k", "d", 3, "y", part_rows=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan and "collect_list" not in plan and "Python" not in plan


def test_parts_are_even_beyond_one_level(spark):
    df = spark.range(30_000).select(F.col("id").cast("double").alias("t"))
    sizes = [r[1] for r in R.cut(df, [], "t", 3000).groupBy("_part").count().collect()]
    assert len(sizes) > 2900 and max(sizes) < 40
    order = R.cut(df, [], "t", 3000).groupBy("_part").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_part").collect()
    assert all(a.hi < b.lo for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("few", [256, 0])
@pytest.mark.parametrize("closed", [True, False])
def test_intervals(spark, monkeypatch, few, closed):
    monkeypatch.setattr(W, "FEW_INTERVALS", few)
    rng = random.Random(6)
    day = lambda n: DAY + dt.timedelta(n)
    spans = [(s, s + rng.choice([-1, 0, 1, 2, 5, 40, 400, 3000])) for s in (rng.randrange(-500, 2000) for _ in range(60))]
    rows = [rng.randrange(-600, 2500) for _ in range(200)] + [None, None]
    df = spark.createDataFrame([(i, None if t is None else day(t)) for i, t in enumerate(rows)], "i int, d date")
    intervals = spark.createDataFrame([(day(s), day(e), n) for n, (s, e) in enumerate(spans)] + [(day(0), None, 99), (None, day(9), 98)], "s date, e date, name int")
    got = sorted((r.i, -1 if r.name is None else r.name) for r in W.interval_label(df, intervals, "d", "s", "e", ["name"], closed=closed).collect())
    want = []
    for i, t in enumerate(rows):
        hits = [n for n, (s, e) in enumerate(spans) if t is not None and s <= t and (t <= e if closed else t < e)]
        want += [(i, n) for n in hits or [-1]]
    assert got == sorted(want)


def test_a_million_intervals(spark):
    df = spark.range(20_000).select((F.col("id") * 97 % 1_000_003).cast("double").alias("t"))
    intervals = spark.range(1_000_000).select(F.col("id").cast("double").alias("s"), (F.col("id") + 1 + F.col("id") % 3).cast("double").alias("e"), F.col("id").alias("name"))
    out = W.interval_label(df, intervals, "t", "s", "e", ["name"])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.groupBy("t").agg(F.count("name").alias("n")).collect()
    assert len(got) == 20_000
    for r in got[:500]:
        t = int(r.t)
        assert r.n == sum(s >= 0 and s < 1_000_000 and t < s + 1 + s % 3 for s in range(max(0, t - 3), t + 1))
