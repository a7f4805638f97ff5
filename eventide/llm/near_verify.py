"""Links between near copies, verified on their shingle sets.

Fingerprints only say which texts may be alike. Candidate groups, the components of fingerprint links, are settled on exact Jaccard
similarities without comparing all their pairs:

1. In each of a few rounds a group's centre, the open member nearest to the bitwise majority of the open members' fingerprints, is compared
   with every member of the group. Members that are alike enough are linked to it and are open no more. Copies of one original are linked to
   it in the first round, and that round settles groups of two.
2. In groups of more that are not all linked to one centre, members are compared tile by tile: by fingerprints first, then on their sets, where no
   centre tells the two apart (Jaccard distance is a metric, so two alike texts have nearly the same distance to any third) and no
   link connects them yet. A tile returns links, at most one for each two of its members' groups.

Two members whose fingerprints are within the threshold are therefore connected, told apart by a centre, or compared on their sets; what is linked
is alike. Centres of large groups are copied to salted parts of their members, tiles have few members, and only sets of groups' members are ever computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import materialise

#: Members of a tile, and of a salted part that shares one copy of its centre. Tiles of very large groups grow with the root of their number.
TILE = 128


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _majority(c: str) -> Column:
    """The 64 bits that more than half of a group's values of ``c`` have."""
    out = F.lit(0).cast("long")
    for i in range(64):
        bit = F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")
        ones = F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1).cast("long")))
        out = out.bitwiseOR(F.when(ones * 2 > F.count(F.lit(1)), bit).otherwise(F.lit(0).cast("long")))
    return out


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def centres(open_members: DataFrame, checks: list[str]) -> DataFrame:
    """(m_component, centre, salts): of each group the open member nearest to the majority, the smallest node among equals."""
    middle = open_members.groupBy(F.col("component").alias("m_component")).agg(F.ceil(F.max("size") / TILE).alias("salts"), *[_majority(c).alias(f"m_{c}") for c in checks])
    x = open_members.join(middle, F.col("component") == F.col("m_component"))
    far = sum((_bits(c, f"m_{c}") for c in checks[1:]), _bits(checks[0], f"m_{checks[0]}"))
    return x.groupBy("m_component").agg(F.min(F.struct(far.alias("far"), "node", "salts")).alias("best")).select("m_component", F.col("best.node").alias("centre"), F.col("best.salts").alias("salts"))


def to_centres(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(node, centre, j): similarity of every other member of a group to its centre."""
    own = sets.join(found, F.col("component") == F.col("m_component")).select("node", "component", "centre", "shingles", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt")).where("node <> centre")
    at = found.select(F.col("centre").alias("c_node"), "salts")
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("c_salt")
    copies = sets.join(at, F.col("node") == F.col("c_node")).select(F.col("component").alias("c_component"), F.col("shingles").alias("c_shingles"), salt)
    pairs = own.join(copies, (F.col("component") == F.col("c_component")) & (F.col("salt") == F.col("c_salt")))
    return pairs.select("node", "centre", jaccard(F.col("shingles"), F.col("c_shingles")).alias("j"))


def _tile_links(threshold: int, similarity: float, rounds: int, block: int = 256):
    apart = 1 - similarity + 1e-9

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, label, side = (pdf[c].to_numpy() for c in ("node", "label", "side"))
        words = [pdf[c].to_numpy().view(np.uint64) for c in ("c0", "c1")]
        far = [pdf[f"d{r}"].to_numpy(dtype=float) for r in range(rounds)]
        sets = pdf["shingles"].to_list()
        _, group = np.unique(label, return_inverse=True)
        root = list(range(len(group)))
        out: list[tuple[int, int]] = []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for at in range(0, len(left), block):
            a = left[at : at + block]
            for to in range(0, len(right), block):
                b = right[to : to + block]
                ok = group[a][:, None] != group[b][None, :]
                if side[0] == 2:  # one tile with itself
                    ok &= a[:, None] < b[None, :]
                for d in far:  # nan where a centre was not compared
                    ok &= ~(np.abs(d[a][:, None] - d[b][None, :]) > apart)
                ok &= sum(np.bitwise_count(w[a][:, None] ^ w[b][None, :]).astype(np.int16) for w in words) <= threshold
                for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
                    i, j = int(a[i]), int(b[j])
                    p, q = find(int(group[i])), find(int(group[j]))
                    if p != q:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                            root[max(p, q)] = min(p, q)
                            out.append((int(node[i]), int(node[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def across(state: DataFrame, sets: DataFrame, threshold: int, similarity: float, rounds: int) -> DataFrame:
    """(u, v): links between members of one group with different labels, of which each two differ or were not compared yet."""
    wide = F.greatest(F.lit(TILE), F.sqrt(F.count(F.lit(1))))
    mixed = state.where("size > 2").groupBy(F.col("component").alias("x_component")).agg(F.ceil(F.count(F.lit(1)) / wide).alias("tiles"), (F.min("label") != F.max("label")).alias("mixed")).where("mixed")
    x = state.join(mixed, F.col("component") == F.col("x_component")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    x = materialise(x.select("component", "node", "label", "c0", "c1", *[f"d{r}" for r in range(rounds)], "tile", "tiles"), "mixed")
    full = x.join(sets.select(F.col("node").alias("s_node"), "shingles"), F.col("node") == F.col("s_node")).drop("s_node")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    full = full.select("*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), side.alias("side"))
    return full.groupBy("component", "low", "high").applyInPandas(_tile_links(threshold, similarity, rounds), "u long, v long")


def verified_links(members: DataFrame, sets: DataFrame, similarity: float, threshold: int, rounds: int = 2) -> DataFrame:
    """(u, v): links between members (node, component, c0, c1) whose ``sets`` (node, component, shingles: sorted distinct array<long>) are at least ``similarity`` alike."""
    size = members.groupBy(F.col("component").alias("s_component")).agg(F.count(F.lit(1)).alias("size"))
    state = members.join(size, F.col("component") == F.col("s_component")).select("node", "component", "c0", "c1", "size", F.col("node").alias("label"), F.lit(True).alias("open"))
    state = materialise(state, "state")
    links = None
    for r in range(rounds):
        found = materialise(centres(state.where("open" if r == 0 else "open AND size > 2"), ["c0", "c1"]), "centres")
        near = materialise(to_centres(sets, found), "centred")
        alike = F.col("j") >= similarity
        some = near.where(alike).select(F.col("node").alias("u"), F.col("centre").alias("v"))
        links = some if links is None else links.unionAll(some)
        seen = near.select(F.col("node").alias("n_node"), "centre", (1 - F.col("j")).alias(f"d{r}"), alike.alias("alike"))
        at = found.select(F.col("centre").alias("is_centre"))
        state = state.join(seen, F.col("node") == F.col("n_node"), "left").join(at, F.col("node") == F.col("is_centre"), "left")
        mine, joined = F.col("is_centre").isNotNull(), F.coalesce("alike", F.lit(False))
        label = F.when(F.col("open") & joined, F.col("centre")).otherwise(F.col("label"))
        distance = F.when(mine, F.lit(0.0)).otherwise(F.col(f"d{r}"))
        before = [f"d{k}" for k in range(r)]
        state = materialise(state.select("node", "component", "c0", "c1", "size", label.alias("label"), (F.col("open") & ~joined & ~mine).alias("open"), *before, distance.alias(f"d{r}")), "state")
    return links.unionAll(across(state, sets, threshold, similarity, rounds))
