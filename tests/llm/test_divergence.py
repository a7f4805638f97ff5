"""Source divergence against plain loops over whole tables."""

import random
import re
from collections import Counter

import pytest
from eventide.llm import divergence

SCALE = 1_000_000_000


def slow_audit(rows, min_docs, k):
    """rows of (text, lang, source) -> rows of the operator."""
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        of = {s: Counter({t: counts[lang, s][t] for t in kept}) for s in sources}
        whole = sum(of.values(), Counter())

        def chance(c):
            total = sum(c.values())
            return {t: 1 + SCALE * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: chance(of[s]) for s in sources}, chance(whole)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[r][t]) for t in kept), r.encode()) for r in sources if r != s))
            out += [(lang, s, "pair", r.decode(), -v, i + 1) for i, (v, r) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "é", "日本", "Mixed", "mixed", "x" * 5000]
    rows = []
    for _ in range(n):
        source = rng.choice([None, "", "a", "a", "a", "b", "c", "Ω"])
        lean = words if source != "b" else words[:20]
        text = " ".join(rng.choice(lean) + rng.choice([" ", ".", "1", "\n", "\x00"]) for _ in range(rng.randrange(80)))
        rows.append((text, rng.choice([None, "en", "en", "de"]), source))
    return rows + [(None, "fr", "only"), ("", "fr", "other"), (None, None, None), rows[0], rows[0], ("same same " * 3000, "en", "loud")]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, source string, n long, term string").repartition(4)
    return sorted((tuple(r) for r in divergence.audit(df, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"max_terms": 30, "tile_sources": 2, "salts": 3}])
def test_audit_matches_brute_force(spark, how):
    rows = corpus(4, 260)
    assert run(spark, rows, min_docs=3, k=5, **how) == slow_audit(rows, 3, 5)


def test_search_needs_more_than_one_wave(spark, monkeypatch):
    monkeypatch.setattr(divergence, "WAVES", (0, 1, 2))
    monkeypatch.setattr(divergence, "bucket", lambda n: n % 7)  # loose bounds: buckets hold unlike counts
    rows = corpus(9, 200)
    assert run(spark, rows, min_docs=2, k=4) == slow_audit(rows, 2, 4)


def test_audit_of_nothing(spark):
    rows = [("one two", "en", "a"), (None, "en", "b"), ("1 2 3", "en", "a")]
    assert run(spark, rows, min_docs=10) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert run(spark, []) == []


def test_terms_of_long_texts_are_whole():
    text = ("word " * 50 + "x" * 300 + "É1ab").encode()
    whole = [t for part in divergence.terms_of(text) for t in part]
    for size in (1, 7, 100):
        assert [t for part in divergence.terms_of(text, size) for t in part] == whole == [*[b"word"] * 50, ("x" * 300 + "É").encode(), b"ab"]


def test_probability_is_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    n, total, kept = 7 * 10**14 + 3, 9 * 10**17 + 1, 10**9
    got = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + SCALE * (n + 2) // (total + 2 * kept)
