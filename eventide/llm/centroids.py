"""Centroid clustering: plain Lloyd rounds over integer vectors.

Vectors are turned into integers once and stored. In each round the centroids, ``k`` rows of ``dim`` integers, are sent to
the tasks; ``mapInPandas`` takes the integer squared differences of a batch of vectors to one centroid after the
other, assigns each vector to the nearest (the lowest number among equals), and adds its vectors up by centroid. A partition
returns at most ``k * dim`` counts and sums, which a ``groupBy`` merges, so neither a crowded cluster nor many equal
vectors weigh on one task, and the driver receives ``k * dim`` numbers a round whatever the table holds. New centroids are
exact floors of sum over count.

All arithmetic is integral: results do not depend on partitions or on the order of rows. After the first round nothing but the
stored integers is read, and a lost task is computed again from them.

Defined results: only vectors of exactly ``dim`` components, none of them null or non-finite, are clustered; others
have no row. Repeated rows count each, repeated identifiers are separate vectors, and a null identifier is
clustered but never starts a centroid while there are ``k`` others; of equal hashes the smaller vector starts first. With fewer
than ``k`` vectors there are as many centroids as vectors; an empty table gives an empty result. A component beyond
2**27 after scaling is an error, since squared distances would not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import discard, materialise

#: Differences of two components below this bound have squares whose sum over 2**7 components fits a long.
BOUND = 2**27


def quantise(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, q array<int>) of the vectors that are whole and finite: q = floor(scale * x)."""
    x = F.col("x")
    whole = (F.size("x") == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    fits = F.forall(x, lambda v: F.abs(v) < BOUND / scale)
    q = F.transform(x, lambda v: F.floor(v * scale).cast("int"))
    checked = F.when(fits, q).otherwise(F.raise_error(F.lit(f"a component is not below {BOUND} after scaling by {scale}")).cast("array<int>"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.coalesce(whole, F.lit(False))).select("vec_id", checked.alias("q"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose identifiers have the smallest hashes, in ascending order of the hash."""
    order: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(order.alias("hash"), "q").orderBy(F.col("hash").asc_nulls_last(), "q").limit(k).collect()  # k rows
    return np.array([r.q for r in first], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; the lowest number among equals."""
    distance = np.empty((len(x), len(centroids)), dtype=np.int64)
    for number, c in enumerate(centroids):
        difference = x - c
        distance[:, number] = np.einsum("ij,ij->i", difference, difference)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(x)), best]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(np.int64).reshape(-1, dim)


def _partial_sums(centroids):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centroids.value
        count, total = np.zeros(len(c), dtype=np.int64), np.zeros_like(c)
        for b in batches:
            if len(b):
                x = _matrix(b["q"], c.shape[1])
                best, _ = nearest(x, c)
                count += np.bincount(best, minlength=len(c))
                for number in np.unique(best):
                    total[number] += x[best == number].sum(axis=0)
        some, dim = np.flatnonzero(count), c.shape[1]
        place = np.tile(np.arange(dim, dtype=np.int32), len(some))
        yield pd.DataFrame({"cluster": np.repeat(some, dim).astype(np.int32), "place": place, "n": np.repeat(count[some], dim), "total": total[some].ravel()})

    return run


def _assign(centroids):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best, distance = nearest(_matrix(b["q"], centroids.value.shape[1]), centroids.value)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return run


def lloyd_round(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; one without vectors stays where it is."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows of dim integers
    partial = vectors.select("q").mapInPandas(_partial_sums(held), "cluster int, place int, n long, total long")
    after = centroids.copy()
    for cluster, place, n, total in partial.groupBy("cluster", "place").agg(F.sum("n"), F.sum("total")).collect():  # at most k * dim rows
        after[cluster, place] = total // n
    held.destroy()
    return after


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    vectors = materialise(quantise(df, id_col, vector_col, dim, scale), "vectors")
    centroids = starts(vectors, k, seed).reshape(-1, dim)
    if len(centroids):
        for _ in range(rounds):
            moved = lloyd_round(vectors, centroids)
            if np.array_equal(moved, centroids):
                break  # every further round would repeat this one
            centroids = moved
    final = spark.sparkContext.broadcast(centroids)
    assigned = materialise(vectors.mapInPandas(_assign(final), "vec_id long, cluster int, distance long"), "assigned")
    discard(vectors)
    of_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # at most k rows
    inertia = sum(r.d for r in of_cluster)
    rows = [(r.cluster, r.d, inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in of_cluster]
    facts = spark.createDataFrame(rows, "of_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("of_cluster")).drop("of_cluster")


def oracle(dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds in DuckDB SQL, one pair of common table expressions for each."""
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dim})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c, q AS m FROM kept ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, min(s) AS s FROM (SELECT r, {{'d': list_sum(list_transform(range(1, {dim} + 1), lambda j: (q[j] - m[j]) * (q[j] - m[j])))::BIGINT, 'c': c}} AS s FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, j, sum(v)::BIGINT AS t, count(*) AS n FROM (SELECT a.s.c AS c, unnest(range(1, {dim} + 1)) AS j, unnest(q) AS v FROM a{i} a JOIN kept USING (r)) GROUP BY c, j)""")
            parts.append(f"""m{i} AS (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY c)""")
            parts.append(f"c{i + 1} AS (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN m{i} n ON o.c = n.c)")
    return f"""WITH {", ".join(f"{p.split(' AS ')[0]} AS MATERIALIZED {p.split(' AS ', 1)[1]}" for p in parts)}
        SELECT vec_id, CAST(a.s.c AS INTEGER) AS cluster, a.s.d AS distance, CAST(sum(a.s.d) OVER (PARTITION BY a.s.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.s.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} c ON c.c = a.s.c"""
