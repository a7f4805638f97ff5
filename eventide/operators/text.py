"""Corpus operators: TF-IDF, novelty, word tables, lexicon lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import text as T
from eventide.functions.scalar import let
from eventide.operators.ranges import bounded, numbered
from eventide.session import stored


def term_counts(df: DataFrame, doc: list[str], tokens: Column) -> DataFrame:
    """(doc, term, tf)."""
    return df.select(*doc, T.each(tokens).alias("term")).groupBy(*doc, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, doc: list[str], n_docs: DataFrame, min_df: int = 2, max_features: int = 3000, sublinear: bool = True) -> DataFrame:
    """(doc, term, w): tf (1 + ln tf) times ln((1 + n) / (1 + df)) + 1, rows of unit length.

    The vocabulary is the ``max_features`` terms with most occurrences, of those in ``min_df`` documents or more.
    """
    vocab = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    vocab = vocab.orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")
    x = counts.join(F.broadcast(vocab), "term").crossJoin(F.broadcast(n_docs.select(F.col("n").alias("_n"))))  # at most max_features rows
    tf = 1 + F.ln("tf") if sublinear else F.col("tf").cast("double")
    x = x.withColumn("w", tf * (F.ln((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*doc)))
    return x.select(*doc, "term", (F.col("w") / norm).alias("w"))


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>>: how often each token occurs in an array, from runs of the sorted array, without leaving the row."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term: string, tf: int>>"))


def vocabulary(each: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """(term, df) of the ``max_features`` commonest terms of (term, tf) rows, one for each term of a document."""
    vocab = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return vocab.orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")


def tfidf_rows(docs: DataFrame, doc: str, tokens: Column, min_df: int = 2, max_features: int = 3000) -> DataFrame:
    """``tfidf`` where each row is one document.

    Texts are tokenised once: a row's tokens become its terms and their counts inside the row, which are stored. The vocabulary is a
    map-side combined count of them by term; only terms of the chosen vocabulary (broadcast: at most ``max_features`` rows) are shuffled by document.
    """
    rows = stored(docs.select(doc, counted(F.filter(tokens, lambda w: w.isNotNull())).alias("_c")), "counts")
    each = rows.select(doc, F.explode("_c").alias("_t")).select(doc, "_t.term", "_t.tf")
    vocab = vocabulary(each, min_df, max_features)
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))
    x = each.join(F.broadcast(vocab), "term").crossJoin(n).withColumn("w", (1 + F.ln("tf")) * (F.ln((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return x.select(doc, "term", (F.col("w") / norm).alias("w"))


def novelty_previous(weights: DataFrame, docs: DataFrame, by: str, at: str, doc: str) -> DataFrame:
    """1 - cosine to the previous document of the key; null for the first; 1 where no term is shared."""
    ranked = bounded(docs.select(*{by, doc, at}), by, at, 1, lambda w: {"prev": F.lag(doc).over(w)}).select(by, doc, "prev")
    mine = ranked.join(weights, doc)
    prev = weights.select(F.col(doc).alias("prev"), "term", F.col("w").alias("pw"))
    dots = mine.join(prev, ["prev", "term"]).groupBy(doc).agg(F.sum(F.col("w") * F.col("pw")).alias("dot"))
    return ranked.join(dots, doc, "left").select(by, doc, F.when(F.col("prev").isNotNull(), 1 - F.coalesce("dot", F.lit(0.0))).alias("novelty"))


def novelty_window(weights: DataFrame, docs: DataFrame, by: str, at: str, doc: str, k: int = 4) -> DataFrame:
    """1 - cosine to the centroid of up to k prior documents."""
    rn = numbered(docs.select(*{by, doc, at}), by, [at], "rn").select(by, doc, (F.col("rn") + 1).alias("rn"))
    w = rn.join(weights, doc)
    ahead = w.select(by, "term", "w", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + k)).alias("rn"))
    centroid = ahead.groupBy(by, "rn", "term").agg(F.sum("w").alias("c"))
    norms = centroid.groupBy(by, "rn").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    dots = w.join(centroid, [by, "rn", "term"]).groupBy(by, "rn").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    x = rn.join(norms, [by, "rn"], "left").join(dots, [by, "rn"], "left")
    return x.select(by, doc, F.when(F.col("rn") > 1, 1 - F.coalesce(F.col("dot") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0))).alias("novelty"))


def novelty_jaccard(sets: DataFrame, by: str, doc: str, words: str) -> DataFrame:
    """1 - Jaccard similarity to the key's previous document, from distinct words; the first document of a key is left out.

    Only identifiers pass the window that finds the previous document; both documents' words are then counted term by term.
    """
    sizes = sets.select(by, doc, F.size(words).alias("n"))
    pairs = bounded(sizes, by, doc, 1, lambda w: {"prev": F.lag(F.struct(F.col(doc).alias("id"), "n")).over(w)}).where("prev IS NOT NULL")
    mine = pairs.select(doc, F.col("prev.id").alias("_id")).join(sets.select(doc, F.explode(words).alias("term")), doc)
    theirs = sets.select(F.col(doc).alias("_id"), F.explode(words).alias("term"))
    common = mine.join(theirs, ["_id", "term"]).groupBy(doc).agg(F.count("*").alias("both"))
    both = F.coalesce("both", F.lit(0))
    return pairs.join(common, doc, "left").select(doc, (1 - both / (F.col("n") + F.col("prev.n") - both)).alias("novelty"))


def word_target_corr(weights: DataFrame, targets: DataFrame, doc: str, y: str, least: int = 5) -> DataFrame:
    """Pearson r of each word's weight with a target over all documents, absent words as zeros, from sums alone."""
    base = F.broadcast(targets.agg(F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")))
    s = weights.join(targets, doc).groupBy("term").agg(F.count("*").alias("docs"), F.sum("w").alias("sx"), F.sum(F.col("w") * F.col("w")).alias("sxx"), F.sum(F.col("w") * F.col(y)).alias("sxy"))
    x = s.where(F.col("docs") >= least).crossJoin(base)
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return x.select("term", "docs", (num / F.nullif(den, F.lit(0.0))).alias("r"))


def word_lookup(tokens: DataFrame, vocab: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Scores of words from a decision table, defaults where a word is unknown."""
    x = tokens.join(vocab, "word", "left")
    return x.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def passage_scores(tokens: DataFrame, vocab: DataFrame, doc: str) -> DataFrame:
    """Five clipped dimensions per document from its words' warm and teal scores, with fallbacks where no word is known."""
    x = tokens.join(vocab, "word")
    a = x.groupBy(doc).agg(F.count("*").alias("known"), F.avg("warm").alias("warm"), F.avg("teal").alias("teal"), F.avg(F.when(F.col("warm") > F.col("teal"), F.col("warm"))).alias("heat"), F.avg((F.col("warm") > 0.5).cast("double")).alias("breadth"))
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    docs = tokens.select(doc).distinct()
    j = docs.join(a, doc, "left")
    return j.select(doc, F.coalesce("known", F.lit(0)).alias("known"), clip(F.coalesce(F.col("warm") - F.col("teal"), F.lit(0.0)), -1.0, 1.0).alias("stance"), clip(F.coalesce("heat", "warm", F.lit(0.3)), 0.0, 1.0).alias("urgency"), clip(F.coalesce(1 - F.abs(F.col("warm") - F.col("teal")), F.lit(0.5)), 0.0, 1.0).alias("ambiguity"), clip(F.coalesce("breadth", F.lit(0.0)), 0.0, 1.0).alias("breadth"), clip(F.coalesce("teal", F.lit(0.3)), 0.0, 1.0).alias("comfort"))


def cached_scores(docs: DataFrame, cache: DataFrame, text: str, version: str) -> DataFrame:
    """Lookup seam of an external scorer: rows with their cached score by sha256(text + version), null where none is stored."""
    key = F.sha2(F.concat(F.col(text), F.lit(version)), 256)
    return docs.withColumn("key", key).join(cache, "key", "left")


def score_through_cache(docs: DataFrame, path: str, text: str, version: str, load) -> DataFrame:
    """``docs`` with ``key``, ``score`` and ``cached``: whether the score was in the cache, a Parquet folder of (key, score), before.

    Each distinct text that the cache lacks is scored once, by the callable that ``load()`` builds once per task, and written back before
    the result is read. A run that fails may be repeated: what it wrote is found then. A null text has no score.
    """
    spark = docs.sparkSession
    schema = "key string, score double"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    known = lambda: spark.read.schema(schema).parquet(path).groupBy("key").agg(F.first("score").alias("score"))  # noqa: E731  writers at one time may add a key twice
    rows = docs.withColumn("key", F.sha2(F.concat(F.col(text), F.lit(version)), 256))
    before = stored(rows.select("key").distinct().join(known().select("key", F.lit(True).alias("cached")), "key"), "cached")
    misses = rows.where(F.col(text).isNotNull()).select("key", F.col(text).alias("_text")).dropDuplicates(["key"]).join(before, "key", "left_anti")
    model_scores(misses, "key", "_text", load).write.mode("append").parquet(path)
    return rows.join(known(), "key", "left").join(before, "key", "left").select(*docs.columns, "key", "score", F.coalesce("cached", F.lit(False)).alias("cached"))


def json_cache(df: DataFrame, payload: str) -> DataFrame:
    """(key, value) rows of JSON dictionaries, a keyed lookup table."""
    return df.select(F.explode(F.from_json(payload, "map<string, double>")).alias("key", "value"))


def model_scores(docs: DataFrame, doc: str, text: str, load) -> DataFrame:
    """(doc, score) by a model that ``load()`` builds once per task: a callable from a list of texts to a list of scores."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches):
        model = load()
        for pdf in batches:
            yield pdf[[doc]].assign(score=[float(x) for x in model(pdf[text].tolist())])

    return docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, score double")
