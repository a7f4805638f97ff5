"""Rows that share an identifier, or have none, lose nothing that is not a copy."""

import random
import re

import pytest
from eventide.llm import exact_dedup, line_dedup

from test_dedup import slow_chunks


def lines(*names):
    return "\n".join(f"line {n} with some more words" for n in names)


def slow_dedup(rows):
    """rows of (id, text) -> cleaned texts, in order: chunk owners by (id, text digest, row, position)."""
    import hashlib

    cut = [slow_chunks(t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, hashlib.sha256((rows[r][1] or "").encode()).digest(), r))
    owner = {}
    for r in order:
        for k, b in enumerate(cut[r]):
            if "\n" in b:
                owner.setdefault(b, (r, k))
    return ["\n".join(b for k, b in enumerate(cut[r]) if "\n" not in b or owner[b] == (r, k)) for r in range(len(rows))]


def test_line_dedup_keeps_unique_lines_of_clashing_identifiers(spark):
    a, b = lines(*range(12)), lines(*range(100, 112))
    rows = [(1, a), (7, a), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).collect()
    assert b in [r.text for r in got if r.doc_id == 7]
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t) for (i, _), t in zip(rows, slow_dedup(rows)))


@pytest.mark.parametrize("buckets", [1 << 25, 500])
def test_line_dedup_with_null_and_repeated_identifiers_matches_brute_force(spark, buckets):
    rng = random.Random(8)
    shared = [lines(*range(20 * k, 20 * k + 9)) for k in range(4)]
    rows = [(rng.choice([None, 1, 2, 3]), "\n".join([lines(1000 + 10 * n), rng.choice(shared), lines(1001 + 10 * n, 1002 + 10 * n), rng.choice(shared)])) for n in range(30)]
    rows += [rows[0], rows[0], (None, None), (5, ""), (5, ""), (None, shared[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(df, bucket_bytes=buckets).collect())
    assert got == sorted((i or -1, t) for (i, _), t in zip(rows, slow_dedup(rows)))


def test_line_dedup_takes_any_number_of_buckets_and_leaves_no_table(spark):
    """One bucket for each byte would be beyond what Spark takes."""
    rows = [(i, lines(*range(i % 3, i % 3 + 400))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "16")
    try:
        got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df, bucket_bytes=1).collect())
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", old)
    assert got == sorted((i, t) for (i, _), t in zip(rows, slow_dedup(rows)))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_chunks")]


def test_line_dedup_of_a_text_of_repeated_chunks_is_linear(spark):
    import time

    text = "\n".join(f"line {i % 60} of a form" for i in range(900_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    began = time.time()
    r = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.time() - began < 60 and r[1].n_chunks > 200_000
    assert r[1].removed_chunks + r[2].removed_chunks > 200_000


def test_line_dedup_shuffles_chunk_texts_once(spark):
    """Beyond any broadcast size, joins by row read the stored chunk table without another exchange of texts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, lines(*range(i, i + 30))) for i in range(60)]
        out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=500)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("budget", [48 << 20, 3000])
def test_keep_first_loses_no_text(spark, budget):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "a  b", "a\tb"] + [f"text {rng.randrange(40)}" for _ in range(80)]
    rows = [(rng.choice([None, None, 5, 5, k]), t, rng.choice("xy")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, second string")
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "", r[2])
    want = {}
    for r in rows:
        n = norm(r[1])
        want[n] = min(want.get(n, r), r, key=rank)
    kept = exact_dedup.keep_first(df, budget=budget)
    assert kept.schema == df.schema
    assert sorted(map(rank, kept.collect())) == sorted(map(rank, want.values()))
    assert exact_dedup.keep_first(df.where("false")).count() == 0


def test_texts_that_collide_in_the_digest_stay_two_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda c: F.unhex(F.lit("00" * 32)))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "abc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]
    assert sorted(r.doc_id for r in exact_dedup.keep_first(df).collect()) == [1, 2, 4]


@pytest.mark.parametrize("budget", [0, 2000, 1 << 30])
def test_trie_spills_by_subtree(budget):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(800)]
    want = {}
    for i, w in enumerate(words):
        want.setdefault(w, []).append(i)
    trie, partial = exact_dedup.PatriciaTrie(), []
    for i, w in enumerate(words):
        trie.insert(w, (i, 1, 1, b"", 0))
        if trie.size > budget:
            partial += trie.spill_heaviest(budget // 2)
    partial = sorted([*partial, *trie.terminals()])
    trie, out = exact_dedup.PatriciaTrie(), []
    for w, v in partial:
        trie.insert(w, v)
        if trie.size > budget:
            out += trie.spill_finished()
    out += trie.terminals()
    assert sorted(w for w, _ in out) == sorted(want)
    assert {w: v[:2] for w, v in out} == {w: (x[0], len(x)) for w, x in want.items()}
