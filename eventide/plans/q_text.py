"""Text analytics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import sql, table, texts
from eventide.catalog import register
from eventide.functions import text as T
from eventide.functions.scalar import r6, r6_scaled
from eventide.operators import ranges as R
from eventide.operators import text as X
from eventide.operators import vectors as N
from eventide.operators import windows as W
from eventide.session import stored

# Parameters: words that occur in the driver's prose stand in for lexicons.
HAWK, DOVE, HEDGE, MODAL = ["the", "of"], ["and", "that"], ["with", "this", "from"], ["are", "was"]
STOP = ["this", "that", "with", "from"]
W_ = "regexp_extract_all(lower(text), '[a-z]+')"
NW = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


def docs(spark, d):
    return texts(spark, d, "documents").select("doc_id", "lang", "source", "text")


def inlist(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def hits(ws, tok=W_):
    return f"len(list_filter({tok}, lambda x: list_contains({inlist(ws)}, x)))"


@register("txt_word_count", f"SELECT doc_id, {NW} AS n_words FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


_RANK = "(count(*) FILTER (b.n < a.n) + (count(*) FILTER (b.n = a.n) + 1) / 2.0) / count(b.n)"


@register("txt_family_a", f"WITH x AS (SELECT lang, doc_id, {NW} AS n FROM documents), w AS (SELECT *, n - lag(n) OVER o AS change, CASE WHEN count(n) OVER p >= 2 THEN (n - avg(n) OVER p) / nullif(stddev_samp(n) OVER p, 0) END AS z FROM x WINDOW o AS (PARTITION BY lang ORDER BY doc_id), p AS (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), k AS (SELECT a.doc_id, {_RANK} AS pct FROM x a JOIN x b ON a.lang = b.lang AND b.doc_id <= a.doc_id GROUP BY a.doc_id) SELECT w.doc_id, n, CAST(change AS DOUBLE) AS change, round(z, 5) AS z, round(pct, 6) AS pct FROM w JOIN k ON w.doc_id = k.doc_id")
def _(spark, d):
    x = docs(spark, d).select("lang", "doc_id", T.word_count(F.col("text")).alias("n"))
    x = W.expanding_rank(x, "n", "lang", "doc_id", "pct")
    x = R.bounded(x, "lang", "doc_id", 4, lambda w: {"before": F.lag("n").over(w)} | dict(zip(("mean", "std"), W.trailing("n", w, 4))))
    return x.select("doc_id", "n", (F.col("n") - F.col("before")).cast("double").alias("change"), F.round((F.col("n") - F.col("mean")) / F.nullif("std", F.lit(0.0)), 5).alias("z"), r6("pct").alias("pct"))


_TF = "tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z][a-z]+') AS t FROM documents), terms AS (SELECT doc_id, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM tok, unnest(range(1, len(t))) u(i)), c AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 3000), x AS (SELECT doc_id, c.term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w0 FROM c JOIN v ON c.term = v.term), w AS (SELECT doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM x)"


def weights(spark, d):
    x = docs(spark, d)
    t = T.words(F.col("text"), 2)
    tokens = x.select("doc_id", t.alias("t")).select("doc_id", F.concat("t", T.bigrams(F.col("t"))).alias("t"))
    return X.tfidf_rows(tokens, "doc_id", F.col("t"))


@register("txt_tfidf", f"WITH {_TF} SELECT doc_id, term, round(w, 6) AS w FROM w")
def _(spark, d):
    return weights(spark, d).select("doc_id", "term", r6("w").alias("w"))


_NOV = f"WITH {_TF}, p AS (SELECT lang, doc_id, lag(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS prev, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)"
_NPREV = "n AS (SELECT p.lang, p.doc_id, CASE WHEN p.prev IS NOT NULL THEN 1 - coalesce((SELECT sum(a.w * b.w) FROM w a JOIN w b ON a.term = b.term WHERE a.doc_id = p.doc_id AND b.doc_id = p.prev), 0) END AS novelty FROM p)"


@register("txt_novelty_prev", f"{_NOV}, {_NPREV} SELECT doc_id, round(novelty, 6) AS novelty FROM n")
def _(spark, d):
    return N.novelty_previous(*N.tfidf_vectors(docs(spark, d), "doc_id", "text", 2), docs(spark, d), "lang", "doc_id", "doc_id").select("doc_id", r6("novelty").alias("novelty"))


@register("txt_novelty_window", f"{_NOV}, r AS (SELECT p.lang, p.rn, w.* FROM p JOIN w ON p.doc_id = w.doc_id), cc AS (SELECT p.doc_id, r.term, sum(r.w) AS c FROM p JOIN r ON r.lang = p.lang AND r.rn BETWEEN p.rn - 4 AND p.rn - 1 GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM cc GROUP BY 1), t AS (SELECT cc.doc_id, sum(cc.c * w.w) AS dot FROM cc JOIN w ON w.doc_id = cc.doc_id AND w.term = cc.term GROUP BY 1) SELECT p.doc_id, CASE WHEN p.rn > 1 THEN round(1 - coalesce(dot / nullif(norm, 0), 0), 6) END AS novelty FROM p LEFT JOIN n ON n.doc_id = p.doc_id LEFT JOIN t ON t.doc_id = p.doc_id")
def _(spark, d):
    return N.novelty_window(*N.tfidf_vectors(docs(spark, d), "doc_id", "text", 2), docs(spark, d), "lang", "doc_id", "doc_id").select("doc_id", r6("novelty").alias("novelty"))


@register("txt_novelty_z", f"{_NOV}, {_NPREV} SELECT doc_id, round((novelty - avg(novelty) OVER o) / nullif(stddev_samp(novelty) OVER o, 0), 4) AS z FROM n WINDOW o AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    x = stored(N.novelty_previous(*N.tfidf_vectors(docs(spark, d), "doc_id", "text", 2), docs(spark, d), "lang", "doc_id", "doc_id"), "novelty")
    x = R.running(x, "lang", "doc_id", {"mean": ("avg", "novelty"), "std": ("std", "novelty")})
    return x.select("doc_id", F.round((F.col("novelty") - F.col("mean")) / F.nullif("std", F.lit(0.0)), 4).alias("z"))


@register("txt_novelty_jaccard", f"WITH t AS (SELECT lang, doc_id, nullif(list_distinct(CASE WHEN doc_id % 9 = 0 THEN [] ELSE {W_} END), []) AS w FROM documents), p AS (SELECT *, last_value(w IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pw FROM t) SELECT doc_id, round(1 - len(list_intersect(w, pw))::DOUBLE / nullif(len(list_distinct(list_concat(w, pw))), 0), 6) AS novelty FROM p WHERE w IS NOT NULL AND pw IS NOT NULL")
def _(spark, d):
    sets = docs(spark, d).where("doc_id % 9 <> 0").select("lang", "doc_id", F.array_distinct(T.words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    return X.novelty_jaccard(sets, "lang", "doc_id", "w").select("doc_id", r6("novelty").alias("novelty"))


_PATS = ["under the", "licen[sc]e", "th[a-z]+ing"]


@register("txt_regex_density", "SELECT doc_id, round((" + " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in _PATS) + f")::DOUBLE / nullif({NW}, 0) * 100, 6) AS density FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", r6(T.regex_density(F.col("text"), _PATS)).alias("density"))


@register("txt_token_density", f"SELECT doc_id, round({hits(HAWK)}::DOUBLE / nullif(len({W_}), 0), 6) AS density FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", r6(T.token_density(F.col("text"), HAWK)).alias("density"))


_DEN = lambda ws: f"{hits(ws)}::DOUBLE / nullif(len({W_}), 0)"


@register("txt_family_c", f"WITH x AS (SELECT lang, doc_id, {_DEN(HEDGE)} AS u, {_DEN(MODAL)} AS w, {_DEN(HAWK)} AS g FROM documents) SELECT doc_id, round(u, 6) AS uncertainty, round(w, 6) AS weak_modal, round(g, 6) AS guidance, CAST(u > median(u) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS present, round(u - lag(u) OVER (PARTITION BY lang ORDER BY doc_id), 6) AS change FROM x")
def _(spark, d):
    t = F.col("text")
    x = docs(spark, d).select("lang", "doc_id", T.token_density(t, HEDGE).alias("u"), T.token_density(t, MODAL).alias("w"), T.token_density(t, HAWK).alias("g"))
    x = W.expanding_median(stored(x, "densities"), "u", "lang", "doc_id", "med")  # words are searched once, though the median reads its rows several times
    change = F.col("u") - F.lag("u").over(Window.partitionBy("lang").orderBy("doc_id"))
    return x.select("doc_id", *[r6_scaled(F.col(c)).alias(name) for c, name in (("u", "uncertainty"), ("w", "weak_modal"), ("g", "guidance"))], (F.col("u") > F.col("med")).cast("double").alias("present"), r6_scaled(change).alias("change"))


@register("txt_family_d", f"WITH x AS (SELECT item_id, {_DEN(HAWK)} AS s FROM benchmark), p AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN {_DEN(HAWK)} END AS s FROM documents) SELECT x.item_id, round(x.s + 0.5 * coalesce(p.s, 0), 6) AS score FROM x LEFT JOIN p ON p.doc_id = x.item_id")
def _(spark, d):
    s = table(spark, d, "benchmark").select("item_id", T.token_density(F.col("text"), HAWK).alias("s"))
    p = docs(spark, d).select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 3 > 0, T.token_density(F.col("text"), HAWK)).alias("p"))
    return s.join(p, "item_id", "left").select("item_id", r6(F.col("s") + 0.5 * F.coalesce("p", F.lit(0.0))).alias("score"))


@register("txt_polarity", f"SELECT doc_id, round({_DEN(HAWK)} - {_DEN(DOVE)}, 6) AS polarity FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", r6(T.token_density(F.col("text"), HAWK) - T.token_density(F.col("text"), DOVE)).alias("polarity"))


@register("txt_per_1k", f"SELECT doc_id, round({hits(HEDGE)} / (nullif(len({W_}), 0) / 1000.0), 6) AS per_1k FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", r6(T.per_thousand(F.col("text"), HEDGE)).alias("per_1k"))


@register("txt_proxy_score", f"SELECT d.doc_id, round(coalesce(CAST(q.quality AS DOUBLE), {_DEN(HEDGE)}), 6) AS score, q.quality IS NOT NULL AS precomputed FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id")
def _(spark, d):
    x = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.select("doc_id", r6(F.coalesce(F.col("quality").cast("double"), T.token_density(F.col("text"), HEDGE))).alias("score"), F.col("quality").isNotNull().alias("precomputed"))


@register("txt_blend", f"WITH a AS (SELECT item_id, {_DEN(HAWK)} AS s FROM benchmark), p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_DEN(HAWK)} END AS s FROM documents) SELECT a.item_id, round(CASE WHEN p.s IS NOT NULL AND a.s IS NOT NULL THEN 0.6 * p.s + 0.4 * a.s ELSE coalesce(p.s, a.s) END, 6) AS score FROM a LEFT JOIN p ON p.doc_id = a.item_id")
def _(spark, d):
    a = table(spark, d, "benchmark").select("item_id", T.token_density(F.col("text"), HAWK).alias("s"))
    p = docs(spark, d).select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 2 == 0, T.token_density(F.col("text"), HAWK)).alias("p"))
    return a.join(p, "item_id", "left").select("item_id", r6(T.blend(F.col("p"), F.col("s"))).alias("score"))


@register("txt_chair_turns", f"SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_chair_turns, count(*) AS n_total_turns, CAST(coalesce(sum({NW}) FILTER (role = 'assistant'), 0) AS BIGINT) AS n_tokens_chair FROM conversations GROUP BY 1")
def _(spark, d):
    chair = F.col("role") == "assistant"
    return texts(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(chair).alias("n_chair_turns"), F.count("*").alias("n_total_turns"), F.coalesce(F.sum(F.when(chair, T.word_count(F.col("text")))), F.lit(0)).alias("n_tokens_chair"))


@register("txt_strip_artifacts", "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{2,}', ' ', 'g'), '[*#%&$]{3,}', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS cleaned FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.strip_artifacts(F.col("text"), ["[0-9]{2,}", "[*#%&$]{3,}"]), 256).alias("cleaned"))


_CONTENT = f"list_filter({W_}, lambda x: length(x) > 3 AND NOT list_contains({inlist(STOP)}, x))"


@register("txt_tokenise", f"WITH t AS (SELECT item_id, {_CONTENT} AS w FROM benchmark) SELECT item_id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ') AS tokens FROM t")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.tokenise(F.col("text"), STOP, with_bigrams=True), " ").alias("tokens"))


@register("txt_chair_corpus", "SELECT source, doc_id, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, length(text) AS n, sha256(text) AS text_sha256 FROM documents")
def _(spark, d):
    # a group's corpus as rows in order, with each text's place in the whole: no task holds a whole corpus
    x = texts(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("text_sha256")).withColumn("taken", F.col("n") + 1)
    x = R.running(x, "source", "doc_id", {"before": ("sum", "taken")}, current=False)
    return x.select("source", "doc_id", "n", "text_sha256", F.coalesce("before", F.lit(0)).alias("start_char"))


_LANGW = f"w AS (SELECT lang, unnest({_CONTENT}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2)"


def lang_words(spark, d):
    return X.term_counts(docs(spark, d), ["lang"], T.tokenise(F.col("text"), STOP))


@register("txt_freq_norm", f"WITH {_LANGW} SELECT lang, word, round(n / max(n) OVER (PARTITION BY lang), 6) AS freq FROM c QUALIFY n >= 5")
def _(spark, d):
    x = lang_words(spark, d).withColumn("freq", r6(F.col("tf") / F.max("tf").over(Window.partitionBy("lang"))))
    return x.where("tf >= 5").select("lang", F.col("term").alias("word"), "freq")


_GT = f"{_LANGW}, v AS (SELECT word, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(n) DESC, word LIMIT 2000), x AS (SELECT lang, c.word, (1 + ln(n)) * (ln((1.0 + (SELECT count(DISTINCT lang) FROM documents)) / (1.0 + df)) + 1) AS w0 FROM c JOIN v ON c.word = v.word), g AS (SELECT lang, word, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY lang)) AS w FROM x)"


def group_weights(spark, d):
    n = docs(spark, d).agg(F.count_distinct("lang").alias("n"))
    return X.tfidf(lang_words(spark, d), ["lang"], n, min_df=1, max_features=2000)


@register("txt_tfidf_group", f"WITH {_GT} SELECT lang, word, round(w, 6) AS w FROM g")
def _(spark, d):
    return group_weights(spark, d).select("lang", F.col("term").alias("word"), r6("w").alias("w"))


_BUCKETS = [("risk", ["tion", "ing"]), ("growth", ["the", "and"]), ("policy", ["er"])]
_CASE = "CASE WHEN contains(word, 'tion') OR contains(word, 'ing') THEN 'risk' WHEN contains(word, 'the') OR contains(word, 'and') THEN 'growth' WHEN contains(word, 'er') THEN 'policy' ELSE 'other' END"


@register("txt_classify_word", f"WITH {_LANGW} SELECT DISTINCT word, {_CASE} AS bucket FROM c")
def _(spark, d):
    return lang_words(spark, d).select(F.col("term").alias("word")).distinct().withColumn("bucket", T.classify(F.col("word"), _BUCKETS))


@register("txt_word_table", f"WITH {_GT} SELECT lang, word, {_CASE} AS bucket, round(w, 6) AS w FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(w, 6) DESC, word) <= 25")
def _(spark, d):
    x = group_weights(spark, d).select("lang", F.col("term").alias("word"), r6("w").alias("w"))
    return W.top_k(x, ["lang"], [F.desc("w"), F.col("word")], 25).withColumn("bucket", T.classify(F.col("word"), _BUCKETS)).select("lang", "word", "bucket", "w")


@register("txt_word_vol_corr", f"WITH {_TF}, y AS (SELECT doc_id, n_chars / 1000.0 AS y FROM documents) SELECT t.term, count(w.w) AS docs, round(corr(coalesce(w.w, 0), y.y), 5) AS r FROM (SELECT DISTINCT term FROM w) t CROSS JOIN y LEFT JOIN w ON w.term = t.term AND w.doc_id = y.doc_id GROUP BY 1 HAVING count(w.w) >= 5")
def _(spark, d):
    y = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("y"))
    return X.word_target_corr(weights(spark, d), y, "doc_id", "y").select("term", "docs", F.round("r", 5).alias("r"))


@register("txt_prefilter", f"SELECT lang, count(*) AS total, count(*) FILTER (length(w) <= 3) AS short_words, count(*) FILTER (list_contains({inlist(STOP)}, w)) AS stop_words, count(*) FILTER (length(w) > 3 AND NOT list_contains({inlist(STOP)}, w)) AS kept FROM (SELECT lang, unnest({W_}) AS w FROM documents) GROUP BY 1")
def _(spark, d):
    x = docs(spark, d).select("lang", T.each(T.words(F.col("text"))).alias("w"))
    stop, short = F.col("w").isin(*STOP), F.length("w") <= 3
    return x.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(short).alias("short_words"), F.count_if(stop).alias("stop_words"), F.count_if(~short & ~stop).alias("kept"))


_DEC = "dec(word, decision) AS (VALUES ('tion', 'DROP'), ('thing', 'DROP'), ('ender', 'KEEP'))"


@register("txt_lexicon_keep", f"WITH {_DEC}, {_LANGW}, a AS (SELECT word, CAST(sum(n) AS BIGINT) AS doc_freq FROM c GROUP BY 1 HAVING sum(n) >= 3) SELECT a.word, doc_freq, coalesce(decision, 'KEEP') AS decision FROM a LEFT JOIN dec ON dec.word = a.word")
def _(spark, d):
    dec = spark.createDataFrame([("tion", "DROP"), ("thing", "DROP"), ("ender", "KEEP")], "word string, decision string")
    a = lang_words(spark, d).groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("doc_freq")).where("doc_freq >= 3")
    return a.join(dec, "word", "left").select("word", "doc_freq", F.coalesce("decision", F.lit("KEEP")).alias("decision"))


_VOC = "voc AS (SELECT DISTINCT word, (length(word) % 5) / 5.0 AS warm, (length(word) % 3) / 3.0 AS teal FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark))"


def vocabulary(spark, d):
    v = table(spark, d, "benchmark").select(T.each(T.words(F.col("text"))).alias("word")).distinct()
    return v.select("word", (F.length("word") % 5 / 5.0).alias("warm"), (F.length("word") % 3 / 3.0).alias("teal"))


@register("txt_passage_score", f"WITH {_VOC}, t AS (SELECT doc_id, unnest({W_}) AS word FROM documents), a AS (SELECT doc_id, count(*) AS known, avg(warm) AS warm, avg(teal) AS teal, avg(warm) FILTER (warm > teal) AS heat, avg(CAST(warm > 0.5 AS DOUBLE)) AS breadth FROM t JOIN voc ON t.word = voc.word GROUP BY 1) SELECT k.doc_id, coalesce(known, 0) AS known, round(least(greatest(coalesce(warm - teal, 0), -1), 1), 6) AS stance, round(least(greatest(coalesce(heat, warm, 0.3), 0), 1), 6) AS urgency, round(least(greatest(coalesce(1 - abs(warm - teal), 0.5), 0), 1), 6) AS ambiguity, round(coalesce(breadth, 0), 6) AS breadth, round(coalesce(teal, 0.3), 6) AS comfort FROM (SELECT DISTINCT doc_id FROM t) k LEFT JOIN a ON a.doc_id = k.doc_id")
def _(spark, d):
    t = docs(spark, d).select("doc_id", T.each(T.words(F.col("text"))).alias("word"))
    x = X.passage_scores(t, vocabulary(spark, d), "doc_id")
    return x.select("doc_id", "known", *[r6(c).alias(c) for c in ("stance", "urgency", "ambiguity", "breadth", "comfort")])


@register("txt_vol_direction", f"WITH {_VOC} SELECT word, CASE WHEN warm > teal + 0.1 THEN 'warm' WHEN teal > warm + 0.1 THEN 'teal' ELSE 'neutral' END AS direction FROM voc")
def _(spark, d):
    return vocabulary(spark, d).select("word", T.direction(F.col("warm"), F.col("teal")).alias("direction"))


@register("txt_similarity_validation", f"WITH x AS (SELECT {_DEN(HAWK)} AS a, {_DEN(DOVE)} AS b, CAST(n_chars AS DOUBLE) AS c FROM documents) SELECT round(corr(a, b), 6) AS r_ab, round(corr(a, c), 6) AS r_ac, abs(corr(a, b)) < 0.3 AS warn FROM x")
def _(spark, d):
    x = texts(spark, d, "documents").select(T.token_density(F.col("text"), HAWK).alias("a"), T.token_density(F.col("text"), DOVE).alias("b"), F.col("n_chars").cast("double").alias("c"))
    return x.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac")).select(r6("ab").alias("r_ab"), r6("ac").alias("r_ac"), (F.abs("ab") < 0.3).alias("warn"))


@register("txt_freq_diff", f"WITH {_LANGW}, f AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS f FROM c), d AS (SELECT coalesce(a.word, b.word) AS word, coalesce(a.f, 0) - coalesce(b.f, 0) AS diff FROM (SELECT * FROM f WHERE lang = 'en') a FULL JOIN (SELECT * FROM f WHERE lang = 'de') b ON a.word = b.word) SELECT word, round(diff, 6) AS diff FROM d WHERE abs(diff) > 0.004")
def _(spark, d):
    f = lang_words(spark, d).where("lang IN ('en', 'de')").withColumn("f", F.col("tf") / F.sum("tf").over(Window.partitionBy("lang")))
    side = lambda k, n: f.where(F.col("lang") == k).select(F.col("term").alias("word"), F.col("f").alias(n))
    x = side("en", "a").join(side("de", "b"), "word", "full").withColumn("diff", F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return x.where(F.abs("diff") > 0.004).select("word", r6("diff").alias("diff"))


_MIX = f"WITH {_LANGW}, b AS (SELECT lang, {_CASE} AS bucket, sum(n) AS n FROM c GROUP BY 1, 2), m AS (SELECT lang, bucket, n / sum(n) OVER (PARTITION BY lang) AS share FROM b)"


@register("txt_thesis_check", f"{_MIX} SELECT bucket, round(max(share) FILTER (lang = 'en'), 6) AS mine, round(avg(share) FILTER (lang <> 'en'), 6) AS others, abs(max(share) FILTER (lang = 'en') - avg(share) FILTER (lang <> 'en')) > 0.05 AS diverges FROM m GROUP BY 1")
def _(spark, d):
    b = lang_words(spark, d).withColumn("bucket", T.classify(F.col("term"), _BUCKETS)).groupBy("lang", "bucket").agg(F.sum("tf").alias("n"))
    m = b.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    en = F.col("lang") == "en"
    x = m.groupBy("bucket").agg(F.max(F.when(en, F.col("share"))).alias("a"), F.avg(F.when(~en, F.col("share"))).alias("b"))
    return x.select("bucket", r6("a").alias("mine"), r6("b").alias("others"), (F.abs(F.col("a") - F.col("b")) > 0.05).alias("diverges"))


@register("txt_direction_mix", f"WITH {_VOC}, t AS (SELECT lang, unnest({W_}) AS word FROM documents), k AS (SELECT lang, CASE WHEN coalesce(warm, 0.3) > coalesce(teal, 0.3) + 0.1 THEN 'warm' WHEN coalesce(teal, 0.3) > coalesce(warm, 0.3) + 0.1 THEN 'teal' ELSE 'neutral' END AS direction FROM t LEFT JOIN voc ON voc.word = t.word) SELECT lang, direction, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM k GROUP BY 1, 2")
def _(spark, d):
    # words are counted before the join: one row per (language, word), not per token
    t = X.term_counts(docs(spark, d), ["lang"], T.words(F.col("text"))).withColumnRenamed("term", "word")
    x = X.word_lookup(t, vocabulary(spark, d), {"warm": 0.3, "teal": 0.3})
    c = x.groupBy("lang", T.direction(F.col("warm"), F.col("teal")).alias("direction")).agg(F.sum("tf").alias("n"))
    return c.select("lang", "direction", r6(F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))


@register("txt_cloud_weights", f"WITH {_GT}, k AS (SELECT lang, word, round(w, 6) AS w FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(w, 6) DESC, word) <= 60) SELECT lang, word, round(w / max(w) OVER (), 5) AS scaled FROM k WHERE w >= 0.01")
def _(spark, d):
    x = group_weights(spark, d).select("lang", F.col("term").alias("word"), r6("w").alias("w"))
    k = W.top_k(x, ["lang"], [F.desc("w"), F.col("word")], 60)
    top = F.broadcast(k.where("w >= 0.01").agg(F.max("w").alias("top")))
    return k.where("w >= 0.01").crossJoin(top).select("lang", "word", F.round(F.col("w") / F.col("top"), 5).alias("scaled"))


@register("txt_voldir_lookup", f"WITH {_VOC}, {_LANGW}, u AS (SELECT DISTINCT word FROM c) SELECT u.word, coalesce(warm, 0.3) AS warm, coalesce(teal, 0.3) AS teal FROM u LEFT JOIN voc ON voc.word = u.word")
def _(spark, d):
    u = lang_words(spark, d).select(F.col("term").alias("word")).distinct()
    return X.word_lookup(u, vocabulary(spark, d), {"warm": 0.3, "teal": 0.3}).select("word", "warm", "teal")


@register("txt_speaker_turns", "WITH t AS (SELECT conv_id, '\n' || string_agg(CASE role WHEN 'assistant' THEN 'CHAIR SPEAKER' ELSE 'REPORTER' END || '. ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1) SELECT conv_id, len(regexp_extract_all(x, '\\n(CHAIR SPEAKER|REPORTER)\\. ')) AS n_turns, len(regexp_extract_all(x, '\\nCHAIR SPEAKER\\. ')) AS n_chair FROM t")
def _(spark, d):
    c = texts(spark, d, "conversations")
    line = F.concat(F.when(c.role == "assistant", "CHAIR SPEAKER").otherwise("REPORTER"), F.lit(". "), F.replace(c.text, F.lit("\n"), F.lit(" ")))
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("x"))
    turns = T.speaker_turns(F.col("x"))
    return t.select("conv_id", F.size(turns).alias("n_turns"), F.size(F.filter(turns, lambda s: s["speaker"] == "CHAIR SPEAKER")).alias("n_chair"))


@register("txt_llm_score", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN round(n_chars / 1000.0, 6) END AS score, doc_id % 2 = 0 AS cached FROM documents")
def _(spark, d):
    """The cache lookup; the external call itself is out of reach offline."""
    x = texts(spark, d, "documents")
    even = x.where("doc_id % 2 = 0")
    cache = even.groupBy(F.sha2(F.concat("text", F.lit("|v1"), F.col("doc_id").cast("string")), 256).alias("key")).agg(F.first(r6(F.col("n_chars") / 1000.0)).alias("score"))
    asked = x.withColumn("asked", F.concat("text", F.lit("|v1"), F.col("doc_id").cast("string")))
    return X.cached_scores(asked, cache, "asked", "").select("doc_id", "score", F.col("score").isNotNull().alias("cached"))


@register("cache_json", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_size::DOUBLE AS value FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return X.json_cache(p.select(F.to_json(F.create_map(p.p_partkey.cast("string"), p.p_size * F.lit(1.0))).alias("j")), "j")


def _count_vowels():
    return lambda texts: [sum(t.count(v) for v in "aeiou") / max(1, len(t)) for t in texts]


@register("txt_transformer", "SELECT doc_id, round((5 * length(text) - length(replace(text, 'a', '')) - length(replace(text, 'e', '')) - length(replace(text, 'i', '')) - length(replace(text, 'o', '')) - length(replace(text, 'u', ''))) / length(text)::DOUBLE, 6) AS score FROM documents")
def _(spark, d):
    """The seam for a classifier, with a stand-in model: any callable over a batch of texts fits."""
    return X.model_scores(docs(spark, d), "doc_id", "text", _count_vowels).select("doc_id", r6("score").alias("score"))
