import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from eventide.llm import components, exact_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, keep_id string, digest int"  # extra columns clash on purpose


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[k], t, "x", k) for k, (i, t) in enumerate(enumerate(texts))], DOCS)


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "", " ", "\t \n", "a b", "a  b", "a\tb", "a\u00a0b", "x" * 300_000, "x" * 300_000 + " "] + ["".join(rng.choice("ab \t") for _ in range(rng.randrange(4))) for _ in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), budget=2000).collect()}
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(norm):
        same = [k for k, o in enumerate(norm) if o == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    rows = exact_dedup.exact_dedup(frame(spark, ["a", "a", "b", "b"], [5, 5, None, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, -1, 2, True), (-1, -1, 2, True), (5, 5, 2, True), (5, 5, 2, True)]
    kept = exact_dedup.keep_first(frame(spark, ["a", "a", " c", "c"], [5, 5, 7, 8]))
    assert kept.columns == ["doc_id", "text", "keep_id", "digest"]
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 8]


def test_trie_splits_edges_and_keeps_smallest():
    trie = exact_dedup.PatriciaTrie()
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc"]
    for i, w in enumerate(words):
        trie.insert(w, (10 - i, 1, 1, b"", 0))
    assert [(k, *v[:2]) for k, v in trie.terminals()] == [(b"", 10, 1), (b"a", 9, 1), (b"ab", 8, 1), (b"abc", 4, 2), (b"abd", 6, 1), (b"b", 5, 1)]


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "É a b c d", "a b a b a b a b", "w " * 5000, " ".join(map(str, range(3000)))])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("sections,threshold", [(2, 3), (1, 2), (2, 1)])
def test_links_match_brute_force(spark, sections, threshold):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = {int(b) for b in base} | {0, 2**64 - 1}
    for b in base.tolist():
        for _ in range(4):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = {x: x - 2**64 if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "node long")
    for hot, refine in ((20_000, True), (3, True), (3, False)):
        links = simhash.near_links(df, ["node"], ["node"], threshold, sections, refine=refine, hot=hot)
        found = {r.node: r.component for r in components.connected_components(links, "u", "v").collect()}
        assert groups({s: found.get(s, s) for s in signed.values()}) == groups(brute(signed, threshold))


def brute(signed, threshold):
    items = list(signed.items())
    parent = {s: s for _, s in items}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (x, a) in enumerate(items):
        for y, b in items[:i]:
            if bin(x ^ y).count("1") <= threshold:
                parent[find(a)] = find(b)
    return {s: find(s) for s in parent}


def groups(named):
    by = {}
    for k, v in named.items():
        by.setdefault(v, set()).add(k)
    return sorted(map(sorted, by.values()))


def test_near_dedup_edges(spark):
    assert simhash.near_dedup(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", "one", text, text + " end", text, "other words here " * 9]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(frame(spark, texts)).collect()}
    assert [got[i][1] for i in range(7)] == [0, 0, 2, 3, 3, 3, 6]
    assert got[0][0] == "0" * 16 and all(got[i][0] == f"{slow_fingerprint(t):016x}" for i, t in enumerate(texts))
    kept = simhash.keep_one(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 6] and kept.columns == ["doc_id", "text", "keep_id", "digest"]


def slow_near(rows):
    """Kept rows of (id, text, other) by the definition: candidates by signatures, links by sets of shingles, components, smallest row of each."""
    signed = [[w & (2**64 - 1) for w in simhash.signature(t)[0]] for _, t, _ in rows]
    sets = [set(simhash.shingle_hashes(t).tolist()) for _, t, _ in rows]
    homes, reach = [], []
    for k in range(8):
        section = np.array([s[k // 2] >> 32 * (k % 2) & 0xFFFFFFFF for s in signed], dtype=np.uint64)
        row, code, home = simhash.anchors(section, 32, 1)
        homes.append({r: c for r, c, h in zip(row.tolist(), code.tolist(), home.tolist()) if h})
        reach.append(set(zip(row.tolist(), code.tolist())))
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            apart = sum((signed[i][k] ^ signed[j][k]).bit_count() for k in (4, 5))
            alike = sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike and apart <= simhash.bits_apart(0.8) and any((i, h[j]) in r or (j, h[i]) in r for h, r in zip(homes, reach)):
                group[find(i)] = find(j)
    best = {}
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest(), r[2])
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=rank)
    return sorted(best.values(), key=rank), rank


def near_rows(seed, n=25):
    rng = random.Random(seed)
    rows = [(None, None, "a"), (None, "", "b"), (5, "one", "c"), (5, "two", "c"), (5, "two", "d"), (None, "three", "e"), (None, "four", "f")]
    for k in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 400))]
        for copy in range(rng.randrange(1, 5)):
            edited = list(words)
            for _ in range(copy * len(words) // 60):
                edited[rng.randrange(len(words))] = "edited"
            rows.append((rng.choice([None, k, 5]), " ".join(edited).replace("w1", "W1"), "z"))
    return rows


@pytest.mark.parametrize("hot", [16_384, 4])
def test_keep_one_matches_brute_force_with_null_and_clashing_identifiers(spark, hot):
    rows = near_rows(11)
    df = spark.createDataFrame(rows, "doc_id long, text string, home string")
    want, rank = slow_near(rows)
    kept = simhash.keep_one(df, hot=hot)
    assert kept.schema == df.schema
    assert sorted((tuple(r) for r in kept.collect()), key=rank) == want
    assert len(want) < len(rows) and simhash.keep_one(df.where("false")).count() == 0


def test_signatures_find_near_copies_and_leave_other_texts_apart():
    rng = random.Random(4)
    near = caught = 0
    originals = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 500))]
        edited = list(words)
        for _ in range(len(words) // 50):
            edited[rng.randrange(len(words))] = "edited"
        a, b = (set(zip(*(x[i:] for i in range(5)))) for x in (words, edited))
        if len(a & b) / len(a | b) < 0.8:
            continue
        s, t = simhash.signature(" ".join(words))[0], simhash.signature(" ".join(edited).upper() + ".")[0]
        near += 1
        caught += linked(s, t)
        originals.append(s)
    assert near > 40 and caught / near >= 0.9
    assert not any(linked(s, t) for i, s in enumerate(originals) for t in originals[:i])


def linked(s, t):
    m = 2**64 - 1
    section = min(((a ^ b) >> low & 0xFFFFFFFF).bit_count() for a, b in zip([x & m for x in s[:4]], [x & m for x in t[:4]]) for low in (0, 32))
    return section <= 1 and sum(((a ^ b) & m).bit_count() for a, b in zip(s[4:], t[4:])) <= simhash.bits_apart(0.8)


def test_a_crowd_of_copies_is_linked_through_pivots():
    rng = np.random.default_rng(3)
    center, n = rng.integers(0, 2**63, 2), 5000
    bits = [np.full(n, c) for c in center]
    for i in range(n):
        bits[i % 2][i] ^= 1 << int(rng.integers(0, 62))
    bits[0][-7:] = rng.integers(0, 2**63, 7)
    stars = list(zip(*simhash._stars(np.arange(n), bits, np.ones(n, dtype=bool), 4)))
    assert {u for u, _ in stars} | {0} == set(range(n - 7)) and {v for _, v in stars} == {0}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def slow_chunks(text, window=2, divisor=3):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    bodies, at = [], 0
    for i in range(len(lines)):
        if sum(h[i - j] * 31**j for j in range(window) if i >= j) % divisor == 0 or i == len(lines) - 1:
            bodies.append("\n".join(lines[at : i + 1]))
            at = i + 1
    return bodies


def slow_lines(texts):
    cut = {doc: slow_chunks(text or "") for doc, text in texts.items()}
    first = {}
    for doc in sorted(cut):
        for k, b in enumerate(cut[doc]):
            if "\n" in b:
                first.setdefault(b, (doc, k))
    return {doc: "\n".join(b for k, b in enumerate(bodies) if "\n" not in b or first[b] == (doc, k)) for doc, bodies in cut.items()}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    shared = [f"shared line {i} with some words" for i in range(12)]
    texts = {0: None, 1: "", 2: "one line", 3: "\n\n\n\n\n\n\n\n", 4: "\n".join(shared + shared), 5: "\n".join(shared)}
    for d in range(6, 40):
        own = [f"own {rng.random()}" for _ in range(rng.randrange(1, 8))]
        texts[d] = "\n".join(own[:2] + shared * rng.randrange(2) + own[2:])
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, pos int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {d: r.text for d, r in got.items()} == slow_lines(texts)
    assert got[5].removed_chunks > 0 and got[2].removed_chunks == 0
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).count() == 2


def test_verified_links_are_alike_and_connect_what_is_alike(spark, monkeypatch):
    """Groups with several originals, copies of copies and a crowd: every link holds, and no alike pair of near fingerprints stays apart."""
    from eventide.llm import near_verify

    monkeypatch.setattr(near_verify, "TILE", 8)
    rng = random.Random(2)
    rows = []
    for group in range(4):
        for _ in range(3):
            base = [rng.randrange(10**9) for _ in range(100)] if rng.random() < 0.5 or not rows else list(rows[-1][2])
            for copy in range(rng.randrange(1, 25)):
                s = list(base)
                for _ in range(rng.randrange(0, 24)):
                    s[rng.randrange(100)] = rng.randrange(10**9)
                if copy % 7 == 6:
                    base = s
                rows.append((len(rows), group, s, rng.getrandbits(3), rng.getrandbits(3)))
    members = spark.createDataFrame([(n, g, c0, c1) for n, g, _, c0, c1 in rows], "node long, component long, c0 long, c1 long").repartition(3)
    sets = spark.createDataFrame([(n, g, sorted(set(s))) for n, g, s, _, _ in rows], "node long, component long, shingles array<long>")
    for threshold in (128, 3):
        got = {tuple(sorted((r.u, r.v))) for r in near_verify.verified_links(members, sets, 0.8, threshold).collect()}
        of = [set(s) for _, _, s, _, _ in rows]
        like = lambda a, b: len(of[a] & of[b]) / len(of[a] | of[b])
        assert all(rows[a][1] == rows[b][1] and like(a, b) >= 0.8 for a, b in got)
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in got:
            parent[find(a)] = find(b)
        near = lambda a, b: sum((rows[a][k] ^ rows[b][k]).bit_count() for k in (3, 4)) <= threshold
        pairs = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] == rows[b][1] and near(a, b) and like(a, b) >= 0.8]
        assert len(pairs) > 30 and all(find(a) == find(b) for a, b in pairs)


def test_majority_of_bits(spark):
    from eventide.llm import near_verify

    rng = random.Random(8)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(31)]
    got = spark.createDataFrame([(v,) for v in values], "c long").agg(near_verify._majority("c").alias("m")).first().m
    want = sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))
    assert got & (2**64 - 1) == want


def test_near_stage_on_real_tables_drops_only_what_is_alike_and_finds_it(spark):
    """Every dropped text has a chain of links at 0.8 or more to a kept one, and of the pairs at 0.8 or more hardly one is kept whole."""
    docs = exact_dedup.keep_first(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "text")
    rows = docs.collect()
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text).tolist()) for r in rows}
    holders, pairs = {}, set()
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        near = {}
        for x in s:
            for j in holders[x]:
                near[j] = near.get(j, 0) + 1
        pairs |= {(i, j) for j, n in near.items() if j < i and n >= 0.8 * (len(s) + len(sets[j]) - n)}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        group[find(a)] = find(b)
    found = {find(i) for i in kept}
    dropped = set(sets) - kept
    assert dropped and all(find(i) in found for i in dropped) and all(sum(find(k) == find(i) for k in sets) > 1 for i in dropped)
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.05 * len(pairs)
