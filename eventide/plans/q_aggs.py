"""Aggregations, set operations and reshapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import calendar, chronology, macro, panel, series, sql, table, texts
from eventide.catalog import register
from eventide.functions import stats as ST
from eventide.functions import text as T
from eventide.functions.scalar import r6
from eventide.operators import evaluate as E
from eventide.operators import windows as W

MED = lambda c: F.percentile(c, F.lit(0.5))

#: Forecast-like table: value against the mean of earlier values of the same type, by hour bars.
FC = "SELECT tenor, ts, c AS actual, avg(c) OVER w AS pred, avg(o) OVER w AS pred2, CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END AS regime FROM bars WINDOW w AS (PARTITION BY tenor ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def forecasts(spark, d):
    from eventide.adapters import bars

    w = Window.partitionBy("tenor").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    h = F.hour("ts")
    return bars(spark, d).select("tenor", "ts", F.col("c").alias("actual"), F.avg("c").over(w).alias("pred"), F.avg("o").over(w).alias("pred2"), F.when(h < 8, "night").when(h < 16, "day").otherwise("evening").alias("regime"))


@register("agg_basic", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS med FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.round(MED("o_totalprice"), 4).alias("med"))


@register("agg_pop_std", "SELECT event_type, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.stddev_pop("value")).alias("sd"))


@register("agg_describe", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY 1")
def _(spark, d):
    q = lambda p, n: r6(F.percentile("value", F.lit(p))).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.min("value").alias("low"), q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"), F.max("value").alias("high"))


@register("agg_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@register("agg_nunique", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@register("agg_bool", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 1000) AS all_big, round(avg(CAST(o_orderpriority = '1-URGENT' AS INTEGER)), 6) AS share FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_big"), r6(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int"))).alias("share"))


@register("agg_set", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@register("agg_first_pivot", sql("panel", "SELECT m, max(iv) FILTER (tenor = '1-URGENT') AS front, max(iv) FILTER (tenor = '3-MEDIUM') AS belly, max(iv) FILTER (tenor = '5-LOW') AS back FROM panel GROUP BY m"), dates="m")
def _(spark, d):
    x = panel(spark, d).groupBy("m").pivot("tenor", ["1-URGENT", "3-MEDIUM", "5-LOW"]).agg(F.first("iv"))
    return x.toDF("m", "front", "belly", "back")


@register("agg_argmax", sql("panel", "SELECT m, arg_max(tenor, gap) AS trade_tenor, max(gap) AS gap FROM panel WHERE gap IS NOT NULL GROUP BY m"), dates="m")
def _(spark, d):
    return panel(spark, d).where("gap IS NOT NULL").groupBy("m").agg(F.max_by("tenor", "gap").alias("trade_tenor"), F.max("gap").alias("gap"))


_PRI = "CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END"
_NB = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END"


@register("agg_priority_pick", f"WITH x AS (SELECT doc_id % 50 AS g, {_PRI} * 1000000 + doc_id AS pri, {_NB} AS v, doc_id FROM documents) SELECT g, coalesce((SELECT v FROM x b WHERE b.g = a.g ORDER BY pri DESC LIMIT 1), max(v)) AS v, arg_max(doc_id, pri) AS best_doc FROM x a GROUP BY g")
def _(spark, d):
    lang = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 1).otherwise(0)
    x = texts(spark, d, "documents").select((F.col("doc_id") % 50).alias("g"), (lang * 1000000 + F.col("doc_id")).alias("pri"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("v"), "doc_id")
    return E.priority_pick(x, ["g"], "pri", ["v"]).join(x.groupBy("g").agg(F.max_by("doc_id", "pri").alias("best_doc")), "g")


@register("agg_max_pick", f"SELECT doc_id % 50 AS g, max({_NB}) AS v FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("g")).agg(F.max(F.when(F.col("doc_id") % 3 != 0, F.col("n_chars"))).alias("v"))


@register("agg_two_level", sql("panel", "SELECT year(m) AS regime, coalesce(tenor, 'ALL') AS tenor, count(gap) AS n, round(avg(gap), 6) AS mean FROM panel GROUP BY GROUPING SETS ((year(m), tenor), (year(m)))"))
def _(spark, d):
    p = panel(spark, d).withColumn("regime", F.year("m"))
    return p.groupingSets([["regime", "tenor"], ["regime"]], "regime", "tenor").agg(F.count("gap").alias("n"), r6(F.avg("gap")).alias("mean")).withColumn("tenor", F.coalesce("tenor", F.lit("ALL")))


@register("agg_pooled", sql("panel", "SELECT coalesce(tenor, 'POOLED') AS tenor, count(gap) AS n, round(avg(CAST(gap > 7 AS INTEGER)), 6) AS share FROM panel GROUP BY ROLLUP (tenor)"))
def _(spark, d):
    x = panel(spark, d).rollup("tenor").agg(F.count("gap").alias("n"), r6(F.avg((F.col("gap") > 7).cast("int"))).alias("share"))
    return x.withColumn("tenor", F.coalesce("tenor", F.lit("POOLED")))


@register("agg_crosstab", sql("panel", "SELECT coalesce(CAST(year(m) AS VARCHAR), 'ALL') AS y, coalesce(tenor, 'ALL') AS tenor, count(*) AS n, count(gap) AS both_n FROM panel GROUP BY CUBE (year(m), tenor)"))
def _(spark, d):
    x = panel(spark, d).withColumn("y", F.year("m").cast("string")).cube("y", "tenor").agg(F.count("*").alias("n"), F.count("gap").alias("both_n"))
    return x.select(F.coalesce("y", F.lit("ALL")).alias("y"), F.coalesce("tenor", F.lit("ALL")).alias("tenor"), "n", "both_n")


@register("agg_quantile", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.percentile("value", F.lit(0.05))).alias("p5"), r6(F.percentile("value", F.lit(0.95))).alias("p95"))


@register("agg_corr", sql("panel", "SELECT tenor, round(corr(iv, rv), 6) AS r_iv_rv, round(corr(iv, gap), 6) AS r_iv_gap, round(corr(rv, gap), 6) AS r_rv_gap FROM panel GROUP BY 1"))
def _(spark, d):
    p = panel(spark, d)
    return p.groupBy("tenor").agg(*[r6(F.corr(a, b)).alias(f"r_{a}_{b}") for a, b in (("iv", "rv"), ("iv", "gap"), ("rv", "gap"))])


@register("agg_corr_p", sql("panel", "SELECT tenor, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM (SELECT tenor, corr(iv, gap) AS r, regr_count(gap, iv) AS n FROM panel GROUP BY 1)"))
def _(spark, d):
    x = panel(spark, d).groupBy("tenor").agg(F.corr("iv", "gap").alias("r"), F.regr_count("gap", "iv").alias("n"))
    return x.select("tenor", r6("r").alias("r"), "n", r6(ST.corr_t(F.col("r"), F.col("n"))).alias("t"))


_STUDENT = """WITH r AS (SELECT tenor, r, n - 2 AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT tenor, corr(iv, gap) AS r, regr_count(gap, iv) AS n FROM panel GROUP BY 1)),
s AS (SELECT tenor, v, t, r, atan(abs(t) / sqrt(v)) / 4000 AS h FROM r),
a AS (SELECT tenor, any_value(r) AS r, any_value(t) AS t, any_value(v) AS v, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(h * k), v - 1)) * any_value(h) / 3 AS area FROM s, range(4001) x(k) GROUP BY 1)
SELECT tenor, round(r, 6) AS r, round(t, 6) AS t, round(1 - 2 * area * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi()), 6) + 0 AS p FROM a"""


@register("agg_corr_pvalue", sql("panel", _STUDENT))
def _(spark, d):
    """The p-value itself; its SQL twin integrates the density by Simpson's rule, after t = sqrt(v) tan u."""
    x = panel(spark, d).groupBy("tenor").agg(F.corr("iv", "gap").alias("corr"), F.regr_count("gap", "iv").alias("n"))
    t = ST.corr_t(F.col("corr"), F.col("n"))  # no alias below may be named like a column that a lambda reads: it would be read instead
    return x.select("tenor", r6("corr").alias("r"), r6(t).alias("t"), r6(ST.student_t_two_sided(t, F.col("n") - 2)).alias("p"))


@register("agg_termfreq", "WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2) SELECT lang, word, n, round(n / max(n) OVER (PARTITION BY lang), 6) AS freq FROM c QUALIFY n >= 3 AND row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 40")
def _(spark, d):
    w = texts(spark, d, "documents").select("lang", T.each(T.words(F.col("text"))).alias("word"))
    c = w.groupBy("lang", "word").agg(F.count("*").alias("n"))
    c = c.withColumn("freq", r6(F.col("n") / F.max("n").over(Window.partitionBy("lang"))))
    return W.top_k(c.where("n >= 3"), ["lang"], [F.desc("n"), F.col("word")], 40)


@register("agg_es_var", "WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS v, quantile_cont(value, 0.05) AS v5 FROM events GROUP BY 1) SELECT e.event_type, round(any_value(v), 6) AS var99, round(avg(value) FILTER (value <= v), 6) AS es99, round(avg(value) FILTER (value <= v5), 6) AS es95 FROM events e JOIN q ON e.event_type = q.event_type GROUP BY 1")
def _(spark, d):
    return E.tail_risk(table(spark, d, "events"), ["event_type"], "value").select("event_type", r6("var99").alias("var99"), r6("es99").alias("es99"), r6("es95").alias("es95"))


@register("agg_lift", sql("bars", f"WITH f AS ({FC}), z AS (SELECT regime, actual > 50 AS y, pred > 50 AS p FROM f WHERE pred IS NOT NULL) SELECT regime, round(avg(CAST(y = p AS INTEGER)), 6) AS accuracy, round(avg(CAST(y AS INTEGER)) FILTER (p), 6) AS prec, round(avg(CAST(p AS INTEGER)) FILTER (y), 6) AS recall, round(avg(CAST(y AS INTEGER)) FILTER (p) / nullif(avg(CAST(y AS INTEGER)), 0), 6) AS lift FROM z GROUP BY 1"))
def _(spark, d):
    z = forecasts(spark, d).where("pred IS NOT NULL").select("regime", (F.col("actual") > 50).alias("y"), (F.col("pred") > 50).alias("p"))
    return E.classification(z, ["regime"], "y", "p").select("regime", *[r6(c).alias(c) for c in ("accuracy", "prec", "recall", "lift")])


_METRICS = "round(sqrt(avg(pow(actual - pred, 2))), 6) AS rmse, round(avg(abs(actual - pred)), 6) AS mae, round(1 - sum(pow(actual - pred, 2)) / sum(pow(actual - mu, 2)), 6) AS r2, round(avg(CAST((pred > mu) = (actual > mu) AS INTEGER)), 6) AS shr"


@register("agg_rmse_mae_r2_shr", sql("bars", f"WITH f AS ({FC}), g AS (SELECT *, avg(actual) OVER (PARTITION BY tenor) AS mu FROM f WHERE pred IS NOT NULL) SELECT tenor, count(*) AS n, {_METRICS} FROM g GROUP BY 1"))
def _(spark, d):
    x = E.regression_metrics(forecasts(spark, d).where("pred IS NOT NULL"), ["tenor"], "actual", "pred")
    return x.select("tenor", "n", *[r6(c).alias(c) for c in ("rmse", "mae", "r2", "shr")])


@register("agg_per_regime", sql("bars", f"WITH f AS ({FC}), g AS (SELECT *, avg(actual) OVER (PARTITION BY regime, tenor) AS mu FROM f WHERE pred IS NOT NULL), a AS (SELECT regime, tenor, count(*) AS n, {_METRICS} FROM g GROUP BY 1, 2) SELECT regime, tenor, n, CASE WHEN n >= 200 THEN rmse END AS rmse, CASE WHEN n >= 200 THEN shr END AS shr FROM a"))
def _(spark, d):
    x = E.regression_metrics(forecasts(spark, d).where("pred IS NOT NULL"), ["regime", "tenor"], "actual", "pred")
    return x.select("regime", "tenor", "n", F.when(F.col("n") >= 200, r6("rmse")).alias("rmse"), F.when(F.col("n") >= 200, r6("shr")).alias("shr"))


@register("agg_auc", sql("bars", f"WITH f AS ({FC}), z AS (SELECT regime, actual > 50 AS y, pred AS p FROM f WHERE pred IS NOT NULL), k AS (SELECT regime, y, rank() OVER (PARTITION BY regime ORDER BY p) + (count(*) OVER (PARTITION BY regime, p) - 1) / 2.0 AS r FROM z) SELECT regime, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM k GROUP BY 1"))
def _(spark, d):
    z = forecasts(spark, d).where("pred IS NOT NULL").select("regime", (F.col("actual") > 50).alias("y"), "pred")
    return E.auc(z, "regime", "y", "pred").select("regime", r6("auc").alias("auc"))


@register("agg_ess", "SELECT event_type, round(pow(sum(w), 2) / sum(w * w), 6) AS ess FROM (SELECT event_type, value * (event_id % 3) AS w FROM events) WHERE w > 0 GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "events").select("event_type", (F.col("value") * (F.col("event_id") % 3)).alias("w")).where("w > 0")
    return x.groupBy("event_type").agg(r6(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("ess"))


@register("agg_centroid_dist", "WITH x AS (SELECT label, i, avg(embedding[i]) AS c FROM embeddings, unnest(range(1, 9)) u(i) GROUP BY 1, 2), p AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.c - b.c, 2))) AS d FROM x a JOIN x b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2) SELECT a, b, round(d, 5) AS dist FROM p")
def _(spark, d):
    x = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)])
    c = x.groupBy("label").agg(F.array(*[F.avg(f"e{i}") for i in range(8)]).alias("c"))
    return E.centroid_distances(c, "label", "c").select("a", "b", F.round("dist", 5).alias("dist"))


@register("agg_bucket_mix", "WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), b AS (SELECT lang, CASE WHEN contains(word, 'ti') THEN 'risk' WHEN contains(word, 'th') THEN 'growth' ELSE 'other' END AS bucket, count(*) AS n FROM w GROUP BY 1, 2) SELECT lang, bucket, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM b")
def _(spark, d):
    w = texts(spark, d, "documents").select("lang", T.each(T.words(F.col("text"))).alias("word"))
    bucket = F.when(F.contains("word", F.lit("ti")), "risk").when(F.contains("word", F.lit("th")), "growth").otherwise("other")
    n = w.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.select("lang", "bucket", r6(F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))


@register("set_union_all", sql("panel macro", "SELECT tenor AS name, m AS d, iv AS value, CAST(n AS DOUBLE) AS n FROM panel UNION ALL SELECT series, d, value, NULL FROM macro"), dates="d")
def _(spark, d):
    a = panel(spark, d).select(F.col("tenor").alias("name"), F.col("m").alias("d"), F.col("iv").alias("value"), F.col("n").cast("double").alias("n"))
    return a.unionByName(macro(spark, d).select(F.col("series").alias("name"), "d", "value"), allowMissingColumns=True)


@register("set_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@register("set_index_intersect", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@register("set_jaccard", f"WITH t AS (SELECT item_id, {_TOK} AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS jac FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def _(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("w").alias("x")), t.select(F.col("item_id").alias("b"), F.col("w").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", r6(F.size(F.array_intersect("x", "y")) / F.nullif(F.size(F.array_union("x", "y")), F.lit(0))).alias("jac"))


@register("set_subset", "SELECT o_custkey, len(list_filter(['F', 'O'], lambda x: NOT list_contains(list(DISTINCT o_orderstatus), x))) = 0 AS has_both FROM orders GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return x.select("o_custkey", (F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), "s")) == 0).alias("has_both"))


@register("rsh_unpivot", sql("panel", "SELECT tenor, m, measure, value FROM (SELECT tenor, m, iv, rv FROM panel) UNPIVOT INCLUDE NULLS (value FOR measure IN (iv, rv))"), dates="m")
def _(spark, d):
    return panel(spark, d).unpivot(["tenor", "m"], ["iv", "rv"], "measure", "value")


@register("rsh_pivot", sql("panel", "SELECT year(m) AS y, round(avg(gap) FILTER (tenor = '1-URGENT'), 6) AS g1, round(avg(gap) FILTER (tenor = '2-HIGH'), 6) AS g2 FROM panel GROUP BY 1"))
def _(spark, d):
    x = panel(spark, d).groupBy(F.year("m").alias("y")).pivot("tenor", ["1-URGENT", "2-HIGH"]).agg(r6(F.avg("gap")))
    return x.toDF("y", "g1", "g2")


@register("rsh_reindex", sql("series", "SELECT t.tenor, k.d, coalesce(s.px, 0.0) AS px FROM (SELECT CAST(r AS DATE) AS d FROM range(DATE '1995-01-01', DATE '1995-03-01', INTERVAL 1 DAY) x(r)) k CROSS JOIN (SELECT DISTINCT tenor FROM series) t LEFT JOIN series s ON s.tenor = t.tenor AND s.d = k.d"), dates="d")
def _(spark, d):
    s = series(spark, d)
    days = spark.range(59).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    keys = s.select("tenor").distinct().crossJoin(F.broadcast(days))
    return keys.join(s, ["tenor", "d"], "left").select("tenor", "d", F.coalesce("px", F.lit(0.0)).alias("px"))


@register("rsh_explode", "SELECT item_id, CAST(unnest(range(1, len(w) + 1)) AS INTEGER) - 1 AS pos, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "word"))
