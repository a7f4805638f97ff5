"""Token counts and centroid clusters against the library and plain loops."""

import hashlib
import math
import random

import pytest
import sentencepiece
from eventide.llm import centroids, registry, token_counts

SF = "/root/testdata/sf0.001"
PIECES = [" ", "  ", "\n", "a", "the", "ing", "▁", "é", "ß", "ﾃ", "\r\n", "\t", "<s>", "</s>", "<unk>", "\x00", "xx", "//", "==", "    ", "1", "🙂", "中", " "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


@pytest.mark.parametrize("size", [1, 2, 5, 11])
def test_parts_count_as_the_whole(library, size):
    model = token_counts.counter(token_counts.default_model())
    rng = random.Random(size)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(70)))
        parts = list(model.parts(text, size))
        assert "".join(p[i > 0 :] for i, p in enumerate(parts)) == text
        assert sum(model.count(parts)) - model.guard_tokens * max(0, len(parts) - 1) == len(library.encode(text))


@pytest.mark.parametrize("batch_bytes", [50, 1000, 256 << 10])
def test_token_counts_of_hostile_rows(spark, library, batch_bytes):
    texts = [None, "", " ", "<s>hi</s>", "mot clé " * 5000, "x" * 20_000, "\n" * 3000, "日本語" * 4000, "same", "same", "a\x00b"]
    df = spark.createDataFrame([(None if i == 9 else i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, over_limit int")
    got = sorted((tuple(r) for r in token_counts.count_tokens(df, batch_bytes=batch_bytes, limit=100).collect()), key=str)
    want = []
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        want.append((None if i == 9 else i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(df.where("false")).count() == 0


def test_token_counts_query_matches_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op11_token_counts(spark, SF).collect()}
    want = {i: (len(t.encode()), len(library.encode(t))) for i, t in docs.items()}
    assert got == {i: (b, n, n > 4096) for i, (b, n) in want.items()}


def slow_lloyd(rows, dim, k, rounds, scale, seed):
    """rows of (vec_id, components) -> rows of the operator, by plain loops over integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        of = [assign(v)[1] for _, v in kept]
        for c in range(len(means)):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            if mine:
                means[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *assign(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    inertia = [sum(d for _, d, o in out if o == c) for c in range(len(means))]
    return [(i, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in out]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_clusters_match_plain_loops(spark, rounds):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.25, 2.0]) + rng.random() / 8 for _ in range(3)]) for i in range(120)]
    rows += [rows[3]] * 40 + [(3, rows[9][1]), (None, [1.0, 1.0, 1.0]), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 2.0]), (205, [float("inf"), 0.0, 0.0]), (206, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, of_cluster string").repartition(5)
    got = centroids.cluster(df, dim=3, k=4, rounds=rounds, scale=16, seed=9).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow_lloyd(rows, 3, 4, rounds, 16, 9)))


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5]), (7, [4.0, 4.0])], schema)
    got = centroids.cluster(df, dim=2, k=8).collect()
    assert sorted((r.vec_id, r.distance) for r in got) == [(1, 0), (2, 0), (7, 0)]
    assert len({r.cluster for r in got if r.vec_id < 3}) == 1  # ties go to the smaller number; the other keeps its place, empty
    assert centroids.cluster(df.where("false"), dim=2).count() == 0
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], schema), dim=2).count()
