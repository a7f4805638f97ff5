"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial aggregate and a join, written to the shared folder before the next, so the plan never
grows and no link or component reaches the driver. A step's tables are deleted after the next is written. A component of any size stays a star of small rows.
A step never has more links than the one before, so their number says how many files it is worth: few links are not spread over
as many files as there are shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import discard, materialise


#: Links that one task of a step writes at least, as long as there are so many.
ROWS_PER_FILE = 100_000


def _written(df: DataFrame, tag: str, links: int) -> DataFrame:
    return materialise(df.coalesce(max(1, -(-links // ROWS_PER_FILE))), tag)


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _written(_minimum(both).select("c", F.least("c", "m").alias("m")), "least", links)
    out = both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return _after(out, links, edges, least)


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    least = _written(_minimum(edges), "least", links)  # every edge here points from larger u to smaller v
    linked = edges.join(least, F.col("u") == F.col("c"))
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
    return _after(out, links, edges, least)


def _after(step: DataFrame, links: int, *read: DataFrame) -> DataFrame:
    out = _written(step, "edges", links)
    discard(*read)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable."""
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = materialise(pairs, "edges")
    mark = _mark(now)
    while mark[0]:
        now = _small_star(_large_star(now, mark[0]), mark[0])
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
