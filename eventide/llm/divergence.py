"""Source divergence audit: which sources of a language write differently, and by which terms.

Terms are counted where texts lie and merged by (language, source, term). A language keeps the terms that enough of its documents hold.
Every group (language, source), and each language, gives each kept term an integer probability with a pseudo-count, and two
probabilities p, q diverge by floor((p - q)^2 / (p + q)).

Terms: an upper-bound search. A group's kept terms fall into buckets of like counts; the largest probability of a bucket and the smallest
probability that the language gives any of its terms bound the divergence of all of them. Buckets are evaluated best bound first, in
waves over all groups at once, and a group is done once its unseen bounds lie strictly below its k-th value (an equal bound may hide a tie).

Pairs: postings. Most terms are absent from most sources, and a source gives all its absent terms one probability. So a pair's sum over all kept
terms is what two sources without any term would have, plus, for each source, its count histogram against the other's absent
probability, plus a correction for each term that both hold. Only the last reads postings, joined by term; sources of a language are
dealt into tiles and joined tile by tile, so a term that very many sources hold is many small groups. Both directions of a pair are equal.

All arithmetic is integral, with decimals where a long might not hold a product. Tasks count terms into a bounded table, so a hot source is
merged from one row for each task and term. No group, language or vocabulary is held by one task or the driver.

Defined results: null text, lang and source are empty text; a group without kept terms has pairs but no terms; a language without kept terms
has pairs of value 0; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.base import discard, emit, materialise, slices

#: Fixed by contract: letters are A-Z and all characters beyond ASCII; only A-Z are lower-cased; probabilities are parts of 10^9.
SCALE = 1_000_000_000
_PSEUDO = 2
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_TERMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_TERMS_DDL = "lang string, source string, term string, n long, docs long"
#: Ranks of a group's buckets, best bound first, at which waves begin.
WAVES = (0, 16, 128)


def terms_of(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists for about ``size`` bytes each; no term is cut."""
    start = 0
    plain = data.translate(_LETTERS)
    while start < len(plain):
        end = plain.find(b" ", start + size)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def _count(max_terms: int):
    """Rows (lang, source, term, n, docs) of what a task has read, each time it holds ``max_terms`` of them; a null term stands for the group."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    some = terms[at : at + 20_000]
                    yield emit(_TERMS, [[lang] * len(some), [source] * len(some), some, [n[t] for t in some], [docs[t] for t in some]])
                yield emit(_TERMS, [[lang], [source], [None], [0], [0]])
            held.clear()

        for b in slices(batches):
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n) - before
                if size >= max_terms:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def count_terms(df: DataFrame, text_col: str, lang_col: str, source_col: str, max_terms: int) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group; one row with a null term for each group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count(max_terms), _TERMS_DDL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)) as a long; the product is a decimal."""
    exact = lambda c: c.cast("decimal(20,0)")
    over = F.greatest(total + _PSEUDO * kept, F.lit(1))
    return F.call_function("div", exact(F.lit(SCALE)) * exact(n + _PSEUDO), exact(over)).cast("long") + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(counts: DataFrame, postings: DataFrame, kept: DataFrame, tile_sources: int) -> DataFrame:
    """lang, source, total, kept, lang_total, p_absent, tile, tiles: one row for each group of the table."""
    present = counts.where("term IS NULL").select("lang", "source")
    of_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    sources = present.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile_sources).alias("tiles"))
    rows = present.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sources, "lang")
    rows = rows.na.fill(0, ["total", "kept", "lang_total"])
    return rows.withColumns({"p_absent": probability(F.lit(0).cast("long"), F.col("total"), F.col("kept")), "tile": F.pmod(F.xxhash64("source"), F.col("tiles"))})


def bucket(n: Column) -> Column:
    """Counts below 64 stand alone; above, sixteen buckets for each doubling. A table has at most some 700 buckets for each group."""
    return F.when(n < 64, n).otherwise((F.floor(F.log2(n) * 16)).cast("long"))


def _bounds(scored: DataFrame) -> DataFrame:
    """lang, source, bucket, bound, place: buckets that may hold a term with p > q, in order of their upper bounds."""
    cells = scored.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p_high"), F.min("q").alias("q_low")).where("p_high > q_low")
    bounded = cells.select("lang", "source", "bucket", divergence(F.col("p_high"), F.col("q_low")).alias("bound"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    return bounded.withColumn("place", F.row_number().over(order) - 1)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return rows.select("lang", "source", "term", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    """lang, source, term, value, rank of the ``k`` terms of each group that diverge most from its language, among those with p > q."""
    buckets = materialise(_bounds(scored), "bounds")
    best = None
    for wave, first in enumerate(WAVES):
        unseen = buckets.where(F.col("place") >= first)
        if best is not None:
            kth = best.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            unseen = unseen.join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth")
            if unseen.isEmpty():
                break
        now = unseen if wave + 1 == len(WAVES) else unseen.where(F.col("place") < WAVES[wave + 1])
        found = scored.where("p > q").join(now.select("lang", "source", "bucket"), ["lang", "source", "bucket"], "left_semi")
        rows = found.select("lang", "source", "term", divergence(F.col("p"), F.col("q")).alias("value"))
        before, best = best, materialise(_best(rows if best is None else rows.unionByName(best.drop("rank")), k), "best")
        if before is not None:
            discard(before)
    discard(buckets)
    return best


def _both_ways(rows: DataFrame, there: Column, back: Column) -> DataFrame:
    """lang, source, item, value for a pair and for its reverse."""
    ways = F.array(F.struct(F.col("s").alias("source"), F.col("r").alias("item"), there.alias("value")), F.struct(F.col("r").alias("source"), F.col("s").alias("item"), back.alias("value")))
    return rows.select("lang", F.explode(ways).alias("way")).select("lang", "way.*")


def _one_sided(scored: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """Sums of pairs as if no term were held by both: absent against absent, and each count histogram against the other's absent terms."""
    cells = scored.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"), F.first("p_absent").alias("p_absent"))
    none = groups.select("lang", "source", F.col("p_absent").alias("p"), F.lit(0).cast("long").alias("terms"), "p_absent", "kept")
    cells = cells.withColumn("kept", F.lit(0).cast("long")).unionByName(none)
    left = cells.select("lang", F.pmod(F.xxhash64("source", "p"), F.lit(salts)).alias("salt"), F.col("source").alias("s"), "p", "p_absent", "terms", "kept")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.col("source").alias("r"), F.col("p_absent").alias("q_absent"))
    absent = divergence(F.col("p_absent"), F.col("q_absent"))
    held = F.col("terms") * (divergence(F.col("p"), F.col("q_absent")) - absent)
    sums = left.join(right, ["lang", "salt"]).where("s <> r").groupBy("lang", "s", "r").agg(F.sum(held).alias("held"), F.sum(F.col("kept") * absent).alias("absent"))
    return _both_ways(sums, F.col("held") + F.col("absent"), F.col("held"))


def _two_sided(scored: DataFrame) -> DataFrame:
    """Corrections for terms that both sources of a pair hold: postings joined by term, tile by tile."""
    left = scored.select("lang", "term", F.col("tile").alias("a"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("b"), F.col("source").alias("s"), "p", "p_absent")
    right = scored.select("lang", "term", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))).alias("a"), F.col("tile").alias("b"), F.col("source").alias("r"), F.col("p").alias("q"), F.col("p_absent").alias("q_absent"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p_absent", "q_absent"))
    correction = divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)
    both = left.join(right, ["lang", "term", "a", "b"]).where("a < b OR s < r")
    sums = both.groupBy("lang", "s", "r").agg(F.sum(correction).alias("value"))
    return _both_ways(sums, F.col("value"), F.col("value"))


def pairs(scored: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """lang, source, item, value, rank of each group's other sources by their divergence over all kept terms."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sums = _one_sided(scored, groups, salts).unionByName(_two_sided(scored)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.withColumn("rank", F.row_number().over(order))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, k: int = 10, max_terms: int = 200_000, tile_sources: int = 256, salts: int = 32) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language (``pair``) and each group's ``k`` foremost terms (``term``)."""
    counts = materialise(count_terms(df, text_col, lang_col, source_col, max_terms), "counts")
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    postings = materialise(terms.drop("docs").join(kept, ["lang", "term"]), "postings")
    groups = materialise(_groups(counts, postings, postings.select("lang", "term", "lang_n").distinct(), tile_sources), "groups")
    discard(counts)
    facts = groups.select("lang", "source", "total", "kept", "lang_total", "p_absent", "tile", "tiles")
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    scored = materialise(postings.join(facts, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "p_absent", "tile", "tiles", bucket(F.col("n")).alias("bucket")), "scored")
    discard(postings)
    best = top_terms(scored, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs(scored, groups, salts).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best)


ORACLE = r"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    w AS MATERIALIZED (SELECT r, lang, source, unnest(ts) AS t FROM d),
    g AS (SELECT DISTINCT lang, source FROM d),
    k AS MATERIALIZED (SELECT lang, t, count(*) AS ln FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(ln) AS n FROM k GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
    gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
    p AS MATERIALIZED (SELECT gn.lang, gn.source, k.t, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.ln + 2)) // (v.n + 2 * v.v) AS q
          FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.t = k.t),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    term AS (SELECT lang, source, t AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
    UNION ALL
    SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term) WHERE rank <= 10
"""
