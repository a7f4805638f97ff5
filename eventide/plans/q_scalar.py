"""Projections, filters, predicates and scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import bars, calendar, panel, series, sql, table, texts
from eventide.catalog import register
from eventide.functions import scalar as S

r6 = S.r6


@register("src_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@register("prj_select", "SELECT c_custkey AS key, c_mktsegment AS segment, c_nationkey FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.withColumnsRenamed({"c_custkey": "key", "c_mktsegment": "segment"}).select("key", "segment", "c_nationkey")


@register("prj_arith", sql("panel", "SELECT tenor, m, round(iv - rv, 6) AS vrp, round(rv / iv, 6) AS ratio, rv > iv * 0.55 AS underpriced FROM panel"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    return p.withColumns({"vrp": r6(p.iv - p.rv), "ratio": r6(p.rv / p.iv), "underpriced": p.rv > p.iv * 0.55}).select("tenor", "m", "vrp", "ratio", "underpriced")


@register("prj_where", sql("panel", "SELECT tenor, m, CASE WHEN gap IS NULL THEN 'none' WHEN gap > 7 THEN 'rich' ELSE CASE WHEN gap > 6 THEN 'fair' ELSE 'cheap' END END AS state FROM panel"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    return p.select("tenor", "m", F.when(p.gap.isNull(), "none").when(p.gap > 7, "rich").otherwise(F.when(p.gap > 6, "fair").otherwise("cheap")).alias("state"))


@register("prj_masked_update", sql("panel", "SELECT tenor, m, CASE WHEN gap IS NULL AND n > 20 THEN 0.0 ELSE gap END AS gap FROM panel"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    return p.select("tenor", "m", S.masked(p.gap.isNull() & (p.n > 20), F.lit(0.0), p.gap).alias("gap"))


@register("prj_clip", sql("panel", "SELECT tenor, m, greatest(least(gap, 7.5), 6.0) AS clipped, CAST(sign(gap - 6.5) AS INTEGER) AS sgn, round(abs(gap - 6.5), 6) AS dist FROM panel WHERE gap IS NOT NULL"), dates="m")
def _(spark, d):
    p = panel(spark, d).where("gap IS NOT NULL")
    return p.select("tenor", "m", S.clip(p.gap, 6.0, 7.5).alias("clipped"), F.signum(p.gap - 6.5).cast("int").alias("sgn"), r6(F.abs(p.gap - 6.5)).alias("dist"))


@register("prj_safe_div", sql("panel", "SELECT tenor, m, round(iv / nullif(n % 3, 0), 6) AS q FROM panel"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    return p.select("tenor", "m", r6(S.safe_div(p.iv, p.n % 3)).alias("q"))


@register("prj_cast_lenient", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN '.' WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    raw = F.when(e.event_id % 7 == 0, ".").when(e.event_id % 11 == 0, "n/a").otherwise(e.user_id.cast("string"))
    return e.select("event_id", S.lenient_double(raw).alias("x"))


@register("prj_cast_date", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders", dates="d")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.lenient_date(F.when(o.o_orderkey % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("d"))


@register("prj_schema_probe", sql("panel", "SELECT 'm' AS date_col, 'tenor' AS label_col, CAST(count(*) FILTER (iv IS NULL) AS BIGINT) AS null_iv, CAST(count(*) FILTER (rv IS NULL) AS BIGINT) AS null_rv, CAST(count(*) FILTER (gap IS NULL) AS BIGINT) AS null_gap FROM panel"))
def _(spark, d):
    p = panel(spark, d)
    date_col = next(f.name for f in p.schema if f.dataType.typeName() in ("date", "timestamp"))
    label = next(f.name for f in p.schema if f.dataType.typeName() == "string")
    return p.agg(F.lit(date_col).alias("date_col"), F.lit(label).alias("label_col"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("iv", "rv", "gap")])


@register("prj_codes", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY event_id % 7 = 0 ORDER BY event_type) - 1 END AS code FROM events")
def _(spark, d):
    # codes come from the sorted distinct levels (a small dimension), not from a sort of all rows
    e = table(spark, d, "events").withColumn("level", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    levels = e.where("level IS NOT NULL").select("level").distinct().withColumn("code", F.row_number().over(Window.orderBy("level")) - 1)
    return e.join(F.broadcast(levels), "level", "left").select("event_id", F.coalesce("code", F.lit(-1)).alias("code"))


@register("prj_onehot", "SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS t_click, CAST(event_type = 'view' AS INTEGER) AS t_view, CAST(event_type = 'purchase' AS INTEGER) AS t_purchase FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", *S.onehot(e.event_type, ["click", "view", "purchase"], "t_"))


@register("prj_interact", sql("panel", "SELECT tenor, m, round(iv * (month(m) % 2), 6) AS iv_x_odd, round(rv * (month(m) % 2), 6) AS rv_x_odd, round(iv * n, 4) AS iv_x_n, round(rv * n, 4) AS rv_x_n FROM panel"), dates="m")
def _(spark, d):
    p = panel(spark, d).withColumn("odd", F.month("m") % 2)
    x = p.select("tenor", "m", *S.interactions(["iv", "rv"], ["odd", "n"]))
    return x.select("tenor", "m", r6(x.iv_x_odd).alias("iv_x_odd"), r6(x.rv_x_odd).alias("rv_x_odd"), F.round("iv_x_n", 4).alias("iv_x_n"), F.round("rv_x_n", 4).alias("rv_x_n"))


@register("prj_map", "SELECT o_orderkey, CAST(coalesce(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 END, 0.1) AS DOUBLE) AS weight FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    m = F.create_map(F.lit("F"), F.lit(1.0), F.lit("O"), F.lit(0.5))
    return o.select("o_orderkey", F.coalesce(F.try_element_at(m, o.o_orderstatus), F.lit(0.1)).alias("weight"))


@register("flt_predicate", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR NOT (o_orderstatus <> 'P')")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.where(((o.o_totalprice > 150000) & o.o_orderpriority.isin("1-URGENT", "2-HIGH")) | ~(o.o_orderstatus != "P")).select("o_orderkey")


@register("flt_null", sql("panel", "SELECT tenor, m, gap FROM panel WHERE gap IS NOT NULL AND rv IS NOT NULL"), dates="m")
def _(spark, d):
    return panel(spark, d).na.drop(subset=["gap", "rv"]).select("tenor", "m", "gap")


@register("flt_quality", "SELECT doc_id, n_words FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_words FROM documents) WHERE n_words >= 50")
def _(spark, d):
    x = texts(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")).alias("n_words"))
    return x.where("n_words >= 50")


@register("fil_ffill", sql("panel", "SELECT tenor, m, CASE WHEN m < DATE '2000-06-01' THEN last_value(gap IGNORE NULLS) OVER (PARTITION BY tenor ORDER BY m ROWS UNBOUNDED PRECEDING) END AS filled FROM panel"), dates="m")
def _(spark, d):
    from eventide.operators.ranges import running

    x = running(panel(spark, d), "tenor", "m", {"on": ("last", "gap")})
    return x.select("tenor", "m", F.when(F.col("m") < F.lit("2000-06-01").cast("date"), F.col("on")).alias("filled"))


@register("fil_mean", sql("panel", "SELECT p.tenor, m, round(coalesce(gap, mean), 6) AS gap FROM panel p JOIN (SELECT tenor, avg(gap) AS mean FROM panel WHERE m < DATE '1999-01-01' GROUP BY 1) t ON p.tenor = t.tenor"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    train = p.where(F.col("m") < F.lit("1999-01-01").cast("date")).groupBy("tenor").agg(F.avg("gap").alias("mean"))
    return p.join(train, "tenor").select("tenor", "m", r6(F.coalesce("gap", "mean")).alias("gap"))


@register("fil_default", sql("panel", "SELECT tenor, m, coalesce(gap, 0.0) AS gap FROM panel"), dates="m")
def _(spark, d):
    return panel(spark, d).na.fill({"gap": 0.0}).select("tenor", "m", "gap")


@register("fil_priority", sql("panel", "SELECT tenor, m, coalesce(CASE WHEN n % 4 = 0 THEN iv END, gap, rv) AS value, CASE WHEN n % 4 = 0 THEN 'quote' WHEN gap IS NOT NULL THEN 'bridge' WHEN rv IS NOT NULL THEN 'proxy' END AS source FROM panel"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    value, tag = S.priority((F.when(p.n % 4 == 0, p.iv), "quote"), (p.gap, "bridge"), (p.rv, "proxy"))
    return p.select("tenor", "m", value.alias("value"), tag.alias("source"))


@register("unit_detect", sql("panel", "WITH s AS (SELECT tenor, m, iv * CASE WHEN n % 2 = 0 THEN 100 ELSE 10 END AS iv FROM panel), k AS (SELECT CASE WHEN median(iv) > 100 THEN 0.01 WHEN median(iv) < 1 THEN 100.0 ELSE 1.0 END AS f FROM s), c AS (SELECT tenor, iv * f AS iv FROM s, k) SELECT tenor, count(*) FILTER (iv > 16) AS nulled, round(avg(CASE WHEN iv <= 16 THEN iv END), 6) AS mean_iv FROM c GROUP BY 1"))
def _(spark, d):
    from eventide.operators.vrp import detect_units

    s = panel(spark, d).select("tenor", "m", (F.col("iv") * F.when(F.col("n") % 2 == 0, 100).otherwise(10)).alias("iv"))
    c = detect_units(s, "iv", cap=16.0)
    return c.groupBy("tenor").agg(F.count_if("nulled").alias("nulled"), r6(F.avg("iv")).alias("mean_iv"))


@register("unit_ratio_guard", sql("panel", "SELECT round(median(rv) / median(iv), 6) AS ratio, median(rv) / median(iv) BETWEEN 0.2 AND 5 AS ok FROM panel"))
def _(spark, d):
    ratio = F.percentile("rv", F.lit(0.5)) / F.percentile("iv", F.lit(0.5))
    return panel(spark, d).agg(ratio.alias("x")).select(r6(F.col("x")).alias("ratio"), F.col("x").between(0.2, 5).alias("ok"))


@register("unit_tenor_guard", sql("panel", "SELECT m, count(DISTINCT CASE WHEN tenor = '5-LOW' THEN 'cash' ELSE 'etf' END) AS kinds, count(DISTINCT CASE WHEN tenor = '5-LOW' THEN 'cash' ELSE 'etf' END) = 1 AS same FROM panel GROUP BY m"), dates="m")
def _(spark, d):
    kind = F.when(F.col("tenor") == "5-LOW", "cash").otherwise("etf")
    return panel(spark, d).groupBy("m").agg(F.count_distinct(kind).alias("kinds")).withColumn("same", F.col("kinds") == 1)


@register("daily_detect", sql("series cal", "WITH g AS (SELECT tenor, date_diff('day', lag(d) OVER (PARTITION BY tenor ORDER BY d), d) AS gap FROM series) SELECT tenor, count(*) AS n, median(gap) AS med_gap, count(*) > 3 * (SELECT count(*) FROM cal) OR (median(gap) > 0 AND median(gap) <= 7) AS daily FROM g GROUP BY tenor"))
def _(spark, d):
    s = series(spark, d).withColumn("gap", F.date_diff("d", F.lag("d").over(Window.partitionBy("tenor").orderBy("d"))))
    n = F.broadcast(calendar(spark, d).agg(F.count("*").alias("meetings")))
    x = s.groupBy("tenor").agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("med_gap")).crossJoin(n)
    return x.select("tenor", "n", "med_gap", ((F.col("n") > 3 * F.col("meetings")) | ((F.col("med_gap") > 0) & (F.col("med_gap") <= 7))).alias("daily"))


@register("dt_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS mo, strftime(o_orderdate, '%Y-%m') AS ym, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS to_end FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.date_diff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate")).alias("to_end"))


@register("dt_busday", sql("cal", "WITH w AS (SELECT meeting_date AS t, b FROM cal, unnest(range(1, 15)) AS u(b)), k AS (SELECT t, t - CAST(b AS INTEGER) AS x FROM w WHERE isodow(t - CAST(b AS INTEGER)) < 6) SELECT t AS meeting_date, max(x) FILTER (nth = 2) AS two_before, max(x) FILTER (nth = 5) AS five_before FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY x DESC) AS nth FROM k) GROUP BY t"), dates="meeting_date two_before five_before")
def _(spark, d):
    m = calendar(spark, d)
    return m.select("meeting_date", S.business_days_before(m.meeting_date, 2).alias("two_before"), S.business_days_before(m.meeting_date, 5).alias("five_before"))


@register("str_basic", "SELECT item_id, lower(text) AS low, len(string_split(text, ' ')) AS parts, length(text) AS n, trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) AS flat FROM benchmark")
def _(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.lower("text").alias("low"), F.size(F.split("text", " ")).alias("parts"), F.length("text").alias("n"), F.trim(F.regexp_replace("text", "[ \\n\\t]+", " ")).alias("flat"))


@register("hash_key", "SELECT doc_id, sha256(text || '|v2') AS key FROM documents")
def _(spark, d):
    return texts(spark, d, "documents").select("doc_id", S.cache_key(F.col("text"), F.lit("|v2")).alias("key"))


@register("src_http_cache", "SELECT page_id, substr(md5(url), 1, 16) AS key FROM pages")
def _(spark, d):
    return texts(spark, d, "pages").select("page_id", S.url_key(F.col("url")).alias("key"))


@register("math_basic", "SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS s, round(exp(p_size / 10.0), 6) AS e, round(pow(p_size, 1.5), 6) AS w, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, round_even(p_size / 4.0, 0) * 4 AS grid FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", r6(F.ln("p_retailprice")).alias("l"), r6(F.sqrt("p_retailprice")).alias("s"), r6(F.exp(p.p_size / 10.0)).alias("e"), r6(F.pow(p.p_size, F.lit(1.5))).alias("w"), F.floor(p.p_retailprice / 7).alias("f"), S.snap(p.p_size, 4.0).alias("grid"))
