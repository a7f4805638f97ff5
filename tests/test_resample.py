"""Resampling against plain loops over the same hashes."""

import hashlib

import numpy as np
import pytest
from eventide.operators import resample
from pyspark.sql import functions as F


def draw(seed, rep, key):
    return int(hashlib.md5(f"{seed}:{rep // 4}:{key}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16)


def weight(u):
    return sum(u >= s for s in resample.poisson_steps())


def test_weights_are_poisson():
    u = np.random.default_rng(0).integers(0, 2**32, 200_000)
    w = np.searchsorted(resample.poisson_steps(), u, side="right")
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


@pytest.mark.parametrize("reps", [1, 7, 8])
def test_bootstrap_sums_match_loops_however_rows_lie(spark, reps):
    rows = [(i, float(i % 13)) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, x double")
    want = {r: [sum(weight(draw(5, r, k)) for k, _ in rows), sum(weight(draw(5, r, k)) * x for k, x in rows)] for r in range(reps)}
    for parts in (1, 9):
        got = resample.bootstrap_sums(df.repartition(parts), "k", {"x": F.col("x")}, reps, 5).collect()
        assert {r.rep: [r.n, r.x] for r in got} == want
    plan = resample.bootstrap_sums(df, "k", {"x": F.col("x")}, reps, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("hits", [0, 1, 40, 120])
def test_masks_take_the_smallest_draws(spark, hits):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), bool(i < hits)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, y double, hit boolean").repartition(5)
    got = {r.rep: r["mean"] for r in resample.permuted_hits(df, "y", F.col("hit"), "k", 6, 3).collect()}
    assert len(got) == 6
    for rep, mean in got.items():
        order = sorted(rows, key=lambda r: (draw(3, rep, r[0]), r[0]))
        want = (sum(abs(r[1]) for r in order[:hits]) - sum(abs(r[1]) for r in order[hits:])) / len(rows)
        assert mean == pytest.approx(want)


def test_masks_of_rows_that_share_their_first_bits(spark, monkeypatch):
    """Most rows fall into one bucket of the last histogram, where rows are ranked."""
    monkeypatch.setattr(resample, "draws", lambda df, key, reps, seed: df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long")))).withColumn("_u", F.pmod(F.col(key) * 7, F.lit(50)) + F.col("rep")))
    rows = [(i, float(i + 1), i < 33) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, y double, hit boolean")
    got = {r.rep: r["mean"] for r in resample.permuted_hits(df, "y", F.col("hit"), "k", 2, 0).collect()}
    for rep in (0, 1):
        order = sorted(rows, key=lambda r: (r[0] * 7 % 50 + rep, r[0]))
        assert got[rep] == pytest.approx((sum(r[1] for r in order[:33]) - sum(r[1] for r in order[33:])) / 100)
