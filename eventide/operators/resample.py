"""Resampling in scans: Poisson bootstraps and random masks of a given size.

A draw is a hash of (seed, replicate, row key), so results depend neither on partitions nor on the order of rows, and no row is
numbered or joined. Rows meet replicates inside a task, where sums are kept by replicate; only these are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Replicates that share one hash: it has 32 hex digits, a draw takes 8.
PER_HASH = 4


def poisson_steps(limit: int = 13) -> list[int]:
    """Least 32-bit draws with a Poisson(1) weight of 1, 2, ...: the distribution function times 2^32."""
    total, steps = 0.0, []
    for k in range(limit):
        total += math.exp(-1) / math.factorial(k)
        steps.append(min(2**32, math.floor(total * 2**32)))
    return [s for s in steps if s < 2**32]


def draws(df: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """``df`` once for each replicate ``rep``, with ``_u``: 32 bits of md5('seed:rep div 4:key')."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // PER_HASH))))
    blocks = blocks.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_block").cast("string"), F.col(key).cast("string"))))
    rep = lambda i: (F.col("_block") * PER_HASH + i).cast("long")
    bits = lambda i: F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")
    each = F.explode(F.array(*[F.struct(rep(i).alias("rep"), bits(i).alias("u")) for i in range(PER_HASH)]))
    return blocks.withColumn("_draw", each).withColumns({"rep": F.col("_draw.rep"), "_u": F.col("_draw.u")}).drop("_block", "_h", "_draw").where(F.col("rep") < reps)


def bootstrap_sums(df: DataFrame, key: str, cells: dict[str, Column], reps: int, seed: int) -> DataFrame:
    """rep, n, and for each cell its sum, where every row counts Poisson(1) times: a bootstrap in one scan.

    ``n`` is the number of rows drawn, which varies about the number of rows. ``key`` tells rows apart.
    """
    rows = df.select(F.col(key).alias("_key"), *[c.cast("double").alias(name) for name, c in cells.items()])
    x = draws(rows, "_key", reps, seed)
    weight = sum((F.when(F.col("_u") >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))
    x = x.withColumn("_w", weight).where("_w > 0")
    return x.groupBy("rep").agg(F.sum("_w").alias("n"), *[F.sum(F.col("_w") * F.col(name)).alias(name) for name in cells])


def _threshold(counts: DataFrame, bucket: str, need: Column) -> DataFrame:
    """rep, bucket, left: where a replicate's ``need``-th smallest row lies, and which place it has there. At most 4096 rows a replicate."""
    upto = F.sum("_n").over(Window.partitionBy("rep").orderBy(bucket))
    x = counts.withColumn("_upto", upto).where((F.col("_upto") >= need) & (F.col("_upto") - F.col("_n") < need))
    return x.select("rep", bucket, (need - F.col("_upto") + F.col("_n")).alias("_left"))


def permuted_hits(df: DataFrame, y: str, hit: Column, key: str, reps: int, seed: int) -> DataFrame:
    """(rep, mean): mean of |y| signed by a random mask with as many hits as the model has.

    A replicate's mask is its h rows with the smallest draws (ties by key). The h-th is found by refining a histogram of draws: first
    by the highest 12 bits, then by 12 more; only rows of that last bucket, one in 16 million, are ranked.
    """
    rows = df.select(F.col(key).alias("_key"), F.abs(y).alias("_y"), hit.alias("_hit"))
    total = rows.agg(F.count_if("_hit").alias("_h"), F.count("_y").alias("_rows"), F.sum("_y").alias("_all"))  # one row
    x = draws(rows.select("_key", "_y"), "_key", reps, seed)
    x = x.withColumns({"_b1": F.shiftright("_u", 20), "_b2": F.shiftright("_u", 8).bitwiseAND(F.lit(4095).cast("long"))})
    by_reps = F.broadcast  # a replicate has one row: ``reps`` bounds the table
    first = _threshold(x.groupBy("rep", "_b1").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total.select("_h"))), "_b1", F.col("_h"))
    inside = x.join(by_reps(first.withColumnRenamed("_left", "_need")), ["rep", "_b1"])
    second = _threshold(inside.groupBy("rep", "_b1", "_b2", "_need").agg(F.count(F.lit(1)).alias("_n")), "_b2", F.col("_need"))
    edges = first.select("rep", "_b1").join(second, "rep").select("rep", F.col("_b1").alias("_e1"), F.col("_b2").alias("_e2"), "_left")
    y24, edge = F.col("_b1") * 4096 + F.col("_b2"), F.col("_e1") * 4096 + F.col("_e2")
    placed = x.join(by_reps(edges), "rep")
    sure = placed.where(y24 < edge).groupBy("rep").agg(F.sum("_y").alias("_sum"))
    last = placed.where(y24 == edge).withColumn("_place", F.row_number().over(Window.partitionBy("rep").orderBy("_u", "_key"))).where("_place <= _left").groupBy("rep").agg(F.sum("_y").alias("_sum"))
    hits = sure.unionAll(last).groupBy("rep").agg(F.sum("_sum").alias("_sum"))
    every = df.sparkSession.range(reps).withColumnRenamed("id", "rep").join(hits, "rep", "left").crossJoin(F.broadcast(total))
    return every.select("rep", ((2 * F.coalesce("_sum", F.lit(0.0)) - F.col("_all")) / F.col("_rows")).alias("mean"))
