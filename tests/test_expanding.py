"""Expanding ranks and medians, cut into buckets, against plain loops over the whole history."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from eventide.operators import expanding


def rows(seed, n, keys):
    rng = random.Random(seed)
    out = []
    for key in keys:
        for i in range(n):
            x = rng.choice([None, float("nan"), 1.0, rng.random(), float(round(rng.gauss(0, 2))), i / n, -i / n]) if i % 7 else None
            out.append((key, dt.date(2000, 1, 1) + dt.timedelta(days=i), x, f"r{i}"))
    rng.shuffle(out)
    return out


def slow(data):
    """{(key, date): (pct rank, median)}"""
    out, by = {}, {}
    for key, at, x, _ in sorted(data, key=lambda r: (str(r[0]), r[1])):
        seen = by.setdefault(key, [])
        known = x is not None and x == x
        if known:
            seen.append(x)
        rank = (sum(s < x for s in seen) + (seen.count(x) + 1) / 2) / len(seen) if known else None
        out[key, at] = rank, statistics.median(seen) if seen else None
    return out


@pytest.mark.parametrize("bucket_rows", [7, 40, 50_000])
def test_matches_a_plain_loop(spark, bucket_rows):
    data = rows(3, 150, ["a", None]) + rows(4, 20, ["b"]) + [("c", dt.date(2000, 1, 1), None, "r")]
    df = spark.createDataFrame(data, "k string, at date, x double, other string")
    want = slow(data)
    ranks = expanding.expanding_rank(df, "x", "k", "at", "out", bucket_rows)
    medians = expanding.expanding_median(df, "x", ["k"], "at", "out", bucket_rows)
    for got, i in ((ranks, 0), (medians, 1)):
        assert got.columns == ["k", "at", "x", "other", "out"]
        found = {(r.k, r.at): r.out for r in got.collect()}
        assert set(found) == set(want)
        for k, w in want.items():
            assert found[k] == (None if w[i] is None else pytest.approx(w[i])), (k, w)
    empty = df.where("false")
    assert expanding.expanding_rank(empty, "x", "k", "at", "out").count() == expanding.expanding_median(empty, "x", "k", "at", "out").count() == 0


def test_no_group_grows_with_its_key(spark):
    data = rows(5, 400, ["a"])
    df = spark.createDataFrame(data, "k string, at date, x double, other string")
    cut, n = expanding._bucketed(df, "x", ["k"], "at", 20)
    assert n == 20 and max(r[1] for r in cut.groupBy("_tb").count().collect()) <= 40
    plan = expanding.expanding_median(df, "x", "k", "at", "out", 20)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_value_that_most_rows_share_is_counted_and_not_compared(spark):
    """Zeros are nine of ten rows: none is sent to a group of its value bucket, and a median's history holds few of them."""
    rng = random.Random(9)
    data = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), 0.0 if rng.random() < 0.9 else rng.gauss(0, 1), "r") for i in range(400)]
    df = spark.createDataFrame(data, "k string, at date, x double, other string")
    want = slow(data)
    for f, i in ((expanding.expanding_rank, 0), (expanding.expanding_median, 1)):
        got = {(r.k, r.at): r.out for r in f(df, "x", "k", "at", "out", 25).collect()}
        assert all(got[k] == pytest.approx(w[i]) for k, w in want.items())
    cut, _ = expanding._bucketed(df, "x", ["k"], "at", 25)
    inside = cut.where("_vb % 2 = 0").groupBy("_vb").count().collect()
    assert sum(r[1] for r in inside) < 60
    pdf = __import__("pandas").DataFrame({"_hx": [0.0, 1.0, 0.0], "_hn": [10**9, 5, 10**9]})
    known, low = expanding._ranked(pdf, 20, 2 * 10**9 + 5, 0)
    assert len(known) < 50 and set(known) == {0.0} and low == 10**9 + 2 - 20 - 1


@pytest.mark.parametrize("ties", [False, True])
def test_earlier_counts(ties):
    rng = np.random.default_rng(1)
    values, times = rng.integers(0, 50, 2000).astype(float), rng.integers(0, 9, 2000) if ties else rng.permutation(2000)
    less, equal = expanding.earlier(values, times, block=64)
    before = times[None, :] < times[:, None]
    assert (less == (before & (values[None, :] < values[:, None])).sum(1)).all() and (equal == (before & (values[None, :] == values[:, None])).sum(1)).all()
