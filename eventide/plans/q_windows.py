"""Ordered-window and event-window analytics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import bars, calendar, macro, panel, series, sql, table
from eventide.catalog import register
from eventide.functions import volatility as V
from eventide.functions.scalar import r6
from eventide.operators import ranges as R
from eventide.operators import windows as W


def by_m():
    return Window.partitionBy("tenor").orderBy("m")


def ps(body: str) -> str:
    return sql("panel", body)


@register("win_lag", ps("SELECT tenor, m, lag(gap) OVER (PARTITION BY tenor ORDER BY m) AS gap_lag1 FROM panel"), dates="m")
def _(spark, d):
    return R.bounded(panel(spark, d), "tenor", "m", 1, lambda w: {"gap_lag1": F.lag("gap").over(w)}).select("tenor", "m", "gap_lag1")


@register("win_diff", ps("SELECT tenor, m, round(iv - lag(iv) OVER (PARTITION BY tenor ORDER BY m), 6) AS d_iv FROM panel"), dates="m")
def _(spark, d):
    return R.bounded(panel(spark, d), "tenor", "m", 1, lambda w: {"d_iv": r6(F.col("iv") - F.lag("iv").over(w))}).select("tenor", "m", "d_iv")


@register("win_pct_change12", ps("SELECT tenor, m, round(iv / lag(iv, 12) OVER (PARTITION BY tenor ORDER BY m) - 1, 6) AS yoy FROM panel"), dates="m")
def _(spark, d):
    return R.bounded(panel(spark, d), "tenor", "m", 12, lambda w: {"yoy": r6(F.col("iv") / F.lag("iv", 12).over(w) - 1)}).select("tenor", "m", "yoy")


@register("win_log_return", sql("series", "SELECT tenor, d, round(ln(px / lag(px) OVER (PARTITION BY tenor ORDER BY d)), 6) AS r FROM series"), dates="d")
def _(spark, d):
    return R.bounded(series(spark, d), "tenor", "d", 1, lambda w: {"r": r6(V.log_return(F.col("px"), F.lag("px").over(w)))}).select("tenor", "d", "r")


_TR = "WINDOW w AS (PARTITION BY tenor ORDER BY m ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"


@register("win_trailing_mean", ps(f"SELECT tenor, m, round(CASE WHEN count(gap) OVER w >= 2 THEN avg(gap) OVER w END, 6) AS mean4 FROM panel {_TR}"), dates="m")
def _(spark, d):
    return R.bounded(panel(spark, d), "tenor", "m", 4, lambda w: {"mean4": r6(W.trailing("gap", w, 4)[0])}).select("tenor", "m", "mean4")


@register("win_trailing_std", ps(f"SELECT tenor, m, round(CASE WHEN count(gap) OVER w >= 2 THEN stddev_samp(gap) OVER w END, 6) AS std4 FROM panel {_TR}"), dates="m")
def _(spark, d):
    return R.bounded(panel(spark, d), "tenor", "m", 4, lambda w: {"std4": r6(W.trailing("gap", w, 4)[1])}).select("tenor", "m", "std4")


@register("win_zscore_trailing", ps(f"SELECT tenor, m, round(CASE WHEN count(gap) OVER w >= 2 THEN (gap - avg(gap) OVER w) / nullif(stddev_samp(gap) OVER w, 0) END, 5) AS z FROM panel {_TR}"), dates="m")
def _(spark, d):
    x = R.bounded(panel(spark, d), "tenor", "m", 4, lambda w: dict(zip(("mean", "std"), W.trailing("gap", w, 4))))
    return x.select("tenor", "m", F.round((F.col("gap") - F.col("mean")) / F.nullif("std", F.lit(0.0)), 5).alias("z"))


@register("win_rolling_mean", ps("SELECT tenor, m, round(avg(iv) OVER (PARTITION BY tenor ORDER BY m ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS roll4, round(CASE WHEN count(iv) OVER p >= 4 THEN avg(iv) OVER p END, 6) AS proxy8 FROM panel WINDOW p AS (PARTITION BY tenor ORDER BY m ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"), dates="m")
def _(spark, d):
    make = lambda w: {"roll4": r6(F.avg("iv").over(w.rowsBetween(-3, 0))), "proxy8": r6(W.trailing("iv", w, 8, 4)[0])}
    return R.bounded(panel(spark, d), "tenor", "m", 8, make).select("tenor", "m", "roll4", "proxy8")


@register("win_rolling_sum", ps("SELECT tenor, m, CAST(sign(sum(iv - 26) OVER (PARTITION BY tenor ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS INTEGER) AS dir FROM panel"), dates="m")
def _(spark, d):
    return R.bounded(panel(spark, d), "tenor", "m", 2, lambda w: {"dir": F.signum(F.sum(F.col("iv") - 26).over(w.rowsBetween(-2, 0))).cast("int")}).select("tenor", "m", "dir")


@register("win_expanding_mean_std", ps("SELECT tenor, m, round(avg(gap) OVER w, 6) AS mean, round(stddev_samp(gap) OVER w, 6) AS sd FROM panel WINDOW w AS (PARTITION BY tenor ORDER BY m ROWS UNBOUNDED PRECEDING)"), dates="m")
def _(spark, d):
    x = R.running(panel(spark, d), "tenor", "m", {"mean": ("avg", "gap"), "sd": ("std", "gap")})
    return x.select("tenor", "m", r6("mean").alias("mean"), r6("sd").alias("sd"))


@register("win_expanding_median", ps("SELECT tenor, m, round(median(gap) OVER w, 6) AS med, CAST(gap > median(gap) OVER w AS DOUBLE) AS present FROM panel WINDOW w AS (PARTITION BY tenor ORDER BY m ROWS UNBOUNDED PRECEDING)"), dates="m")
def _(spark, d):
    x = W.expanding_median(panel(spark, d).select("tenor", "m", "gap"), "gap", "tenor", "m", "med")
    return x.select("tenor", "m", r6("med").alias("med"), (F.col("gap") > F.col("med")).cast("double").alias("present"))


@register("win_expanding_pctrank", ps("SELECT a.tenor, a.m, round((count(*) FILTER (b.gap < a.gap) + (count(*) FILTER (b.gap = a.gap) + 1) / 2.0) / nullif(count(b.gap), 0), 6) AS pct FROM panel a LEFT JOIN panel b ON a.tenor = b.tenor AND b.m <= a.m AND b.gap IS NOT NULL WHERE a.gap IS NOT NULL GROUP BY a.tenor, a.m UNION ALL SELECT tenor, m, NULL FROM panel WHERE gap IS NULL"), dates="m")
def _(spark, d):
    return W.expanding_rank(panel(spark, d).select("tenor", "m", "gap"), "gap", "tenor", "m", "pct").select("tenor", "m", r6("pct").alias("pct"))


@register("win_pct_below_history", ps("SELECT a.tenor, a.m, CASE WHEN count(b.m) = 0 THEN 50.0 ELSE round(100.0 * count(*) FILTER (b.iv < a.iv) / count(b.m), 6) END AS pct FROM panel a LEFT JOIN panel b ON a.tenor = b.tenor AND b.m < a.m GROUP BY a.tenor, a.m"), dates="m")
def _(spark, d):
    # share strictly below among earlier rows, from the expanding rank that averages ties
    x = W.expanding_rank(panel(spark, d).select("tenor", "m", "iv"), "iv", "tenor", "m", "pct")
    n = F.count("iv").over(W.expanding("tenor", "m"))
    eq = F.count("*").over(Window.partitionBy("tenor", "iv").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    below = F.col("pct") * n - (eq + 1) / 2
    return x.select("tenor", "m", F.when(n <= 1, 50.0).otherwise(r6(100.0 * below / (n - 1))).alias("pct"))


@register("win_percentileofscore", ps("SELECT a.tenor, a.m, round(100.0 * (count(*) FILTER (b.iv < a.iv) + (count(*) FILTER (b.iv = a.iv) + 1) / 2.0) / count(*), 6) AS pct FROM panel a JOIN panel b ON a.tenor = b.tenor GROUP BY a.tenor, a.m"), dates="m")
def _(spark, d):
    p = panel(spark, d).select("tenor", "m", "iv")
    c = p.groupBy("tenor", "iv").agg(F.count("*").alias("eq"))
    w = Window.partitionBy("tenor").orderBy("iv")
    c = c.withColumn("below", F.sum("eq").over(w) - F.col("eq")).withColumn("n", F.sum("eq").over(Window.partitionBy("tenor")))
    return p.join(c, ["tenor", "iv"]).select("tenor", "m", r6(100.0 * (F.col("below") + (F.col("eq") + 1) / 2) / F.col("n")).alias("pct"))


@register("win_ewma", ps("WITH o AS (SELECT tenor, m, gap, row_number() OVER (PARTITION BY tenor ORDER BY m) AS rn FROM panel), e AS (SELECT tenor, m, rn, gap AS mean, 1.0::DOUBLE AS wt FROM o WHERE rn = 1 UNION ALL SELECT o.tenor, o.m, o.rn, CASE WHEN e.mean IS NULL THEN o.gap WHEN o.gap IS NULL THEN e.mean ELSE (e.wt * 0.5 * e.mean + 0.5 * o.gap) / (e.wt * 0.5 + 0.5) END, CASE WHEN e.mean IS NULL OR o.gap IS NOT NULL THEN 1.0 ELSE e.wt * 0.5 END FROM e JOIN o ON o.tenor = e.tenor AND o.rn = e.rn + 1) SELECT tenor, m, round(lag(mean) OVER (PARTITION BY tenor ORDER BY m), 6) AS ewma3 FROM e"), dates="m")
def _(spark, d):
    x = R.ewma(panel(spark, d), "gap", "tenor", "m", 3, "e")
    return R.bounded(x, "tenor", "m", 1, lambda w: {"ewma3": r6(F.lag("e").over(w))}).select("tenor", "m", "ewma3")


def event_returns(spark, d, before, after):
    w = Window.partitionBy("tenor").orderBy("d")
    s = series(spark, d).withColumn("r", V.log_return(F.col("px"), F.lag("px").over(w)))
    return W.event_rows(calendar(spark, d), s, "tenor", "meeting_date", "d", before, after)


_RET = "WITH r AS (SELECT tenor, d, px, ln(px / lag(px) OVER (PARTITION BY tenor ORDER BY d)) AS r FROM series), f AS (SELECT meeting_date, tenor, d, r, px, row_number() OVER (PARTITION BY meeting_date, tenor ORDER BY d) AS pos FROM cal JOIN r ON d > meeting_date)"


@register("win_event_rv_close", sql("cal series", f"{_RET} SELECT meeting_date, tenor, count(r) AS n, CASE WHEN count(r) >= 3 THEN round(sqrt(252.0 / count(r) * sum(r * r)), 6) END AS rv_fwd FROM f WHERE pos <= 5 GROUP BY 1, 2"), dates="meeting_date")
def _(spark, d):
    x = event_returns(spark, d, 0, 5).where("pos > 0").groupBy("meeting_date", "tenor").agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    return x.select("meeting_date", "tenor", "n", F.when(F.col("n") >= 3, r6(F.sqrt(252.0 / F.col("n") * F.col("ss")))).alias("rv_fwd"))


@register("win_event_rv_mean", sql("cal series", f"{_RET} SELECT meeting_date, tenor, round(avg(r * r) * 252, 6) AS rv_var FROM f WHERE pos <= 4 GROUP BY 1, 2"), dates="meeting_date")
def _(spark, d):
    x = event_returns(spark, d, 0, 4).where("pos > 0")
    return x.groupBy("meeting_date", "tenor").agg(r6(F.avg(F.col("r") * F.col("r")) * 252).alias("rv_var"))


@register("win_event_yc", sql("cal series", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY d) AS rn FROM series), a AS (SELECT meeting_date, tenor, min(rn) AS rn FROM cal, n WHERE n.d >= meeting_date GROUP BY 1, 2), w AS (SELECT a.meeting_date, a.tenor, n.rn, n.px - lag(n.px) OVER (PARTITION BY a.meeting_date, a.tenor ORDER BY n.rn) AS dx FROM a JOIN n ON n.tenor = a.tenor AND n.rn BETWEEN a.rn - 1 AND a.rn + 1) SELECT meeting_date, tenor, round(stddev_samp(dx) * 100, 6) AS yc_bps FROM w GROUP BY 1, 2"), dates="meeting_date")
def _(spark, d):
    w = Window.partitionBy("tenor").orderBy("d")
    s = series(spark, d).withColumn("before", F.col("px") - F.lag("px").over(w)).withColumn("after", F.lead("px").over(w) - F.col("px"))
    asked = calendar(spark, d).crossJoin(F.broadcast(s.select("tenor").distinct()))
    x = W.asof(asked, s, ("meeting_date", "d"), ["before", "after"], by=["tenor"], how="ge").where("d_asof IS NOT NULL")
    return x.select("meeting_date", "tenor", r6(F.abs(F.col("before") - F.col("after")) / F.sqrt(F.lit(2.0)) * 100).alias("yc_bps"))


@register("win_event_fwd_yc", sql("cal series", "WITH n AS (SELECT *, px - lag(px) OVER (PARTITION BY tenor ORDER BY d) AS dx FROM series), f AS (SELECT meeting_date, tenor, dx, row_number() OVER (PARTITION BY meeting_date, tenor ORDER BY d) AS pos FROM cal JOIN n ON d > meeting_date) SELECT meeting_date, tenor, round(stddev_samp(dx) * 100, 5) AS fwd_bps FROM f WHERE pos BETWEEN 2 AND 6 GROUP BY 1, 2"), dates="meeting_date")
def _(spark, d):
    w = Window.partitionBy("tenor").orderBy("d")
    s = series(spark, d).withColumn("dx", F.col("px") - F.lag("px").over(w))
    x = W.event_rows(calendar(spark, d), s, "tenor", "meeting_date", "d", 0, 6).where("pos BETWEEN 2 AND 6")
    return x.groupBy("meeting_date", "tenor").agg(F.round(F.stddev_samp("dx") * 100, 5).alias("fwd_bps"))


@register("win_event_day_change", sql("cal series", "SELECT meeting_date, tenor, round(chg, 6) AS surprise FROM (SELECT tenor, d, px - lag(px) OVER (PARTITION BY tenor ORDER BY d) AS chg FROM series) JOIN cal ON d = meeting_date"), dates="meeting_date")
def _(spark, d):
    w = Window.partitionBy("tenor").orderBy("d")
    s = series(spark, d).select("tenor", F.col("d").alias("meeting_date"), r6(F.col("px") - F.lag("px").over(w)).alias("surprise"))
    return calendar(spark, d).join(s, "meeting_date").select("meeting_date", "tenor", "surprise")


@register("win_event_context", sql("cal", "WITH n AS (SELECT meeting_date, row_number() OVER (ORDER BY meeting_date) AS rn FROM cal), k AS (SELECT min(rn) AS rn FROM n WHERE meeting_date >= DATE '1998-09-29') SELECT meeting_date, n.rn - k.rn AS rel FROM n, k WHERE abs(n.rn - k.rn) <= 4"), dates="meeting_date")
def _(spark, d):
    n = calendar(spark, d).withColumn("rn", F.row_number().over(Window.orderBy("meeting_date")).cast("long"))
    k = F.broadcast(n.where("meeting_date >= DATE '1998-09-29'").agg(F.min("rn").alias("at")))
    return n.crossJoin(k).where("abs(rn - at) <= 4").select("meeting_date", (F.col("rn") - F.col("at")).alias("rel"))


@register("win_resample_interp", sql("macro", "WITH q AS (SELECT series, d, value FROM macro WHERE month(d) % 3 = 1), g AS (SELECT DISTINCT m.series, m.d FROM macro m JOIN (SELECT series, min(d) AS a, max(d) AS b FROM q GROUP BY 1) k ON m.series = k.series AND m.d BETWEEN a AND b) SELECT g.series, g.d, round(CASE WHEN p.d = n.d THEN p.value ELSE p.value + date_diff('day', p.d, g.d)::DOUBLE / date_diff('day', p.d, n.d) * (n.value - p.value) END, 6) AS value FROM g JOIN q p ON p.series = g.series AND p.d = (SELECT max(d) FROM q WHERE q.series = g.series AND q.d <= g.d) JOIN q n ON n.series = g.series AND n.d = (SELECT min(d) FROM q WHERE q.series = g.series AND q.d >= g.d)"), dates="d")
def _(spark, d):
    m = macro(spark, d)
    q = m.where("month(d) % 3 = 1").select("series", "d", "value")
    x = W.interpolate(m.select("series", "d"), q, "series", "d", "value")
    return x.where("value IS NOT NULL").select("series", "d", r6("value").alias("value"))


@register("win_interp_tenor", sql("panel", "WITH k(tenor, years) AS (VALUES ('1-URGENT', 2.0), ('2-HIGH', 5.0), ('3-MEDIUM', 7.0), ('4-NOT SPECIFIED', 10.0), ('5-LOW', 30.0)), r AS (SELECT k.tenor, years, CASE WHEN k.tenor IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN ratio END AS ratio FROM k JOIN (SELECT tenor, avg(rv) / avg(iv) AS ratio FROM panel GROUP BY 1) p ON p.tenor = k.tenor) SELECT a.tenor, round(coalesce(a.ratio, p.ratio + (a.years - p.years) / (n.years - p.years) * (n.ratio - p.ratio)), 6) AS ratio FROM r a LEFT JOIN r p ON p.years = (SELECT max(years) FROM r WHERE ratio IS NOT NULL AND years < a.years) LEFT JOIN r n ON n.years = (SELECT min(years) FROM r WHERE ratio IS NOT NULL AND years > a.years)"))
def _(spark, d):
    k = spark.createDataFrame([("1-URGENT", 2.0), ("2-HIGH", 5.0), ("3-MEDIUM", 7.0), ("4-NOT SPECIFIED", 10.0), ("5-LOW", 30.0)], "tenor string, years double")
    r = panel(spark, d).groupBy("tenor").agg((F.avg("rv") / F.avg("iv")).alias("ratio")).join(k, "tenor")
    r = r.withColumn("ratio", F.when(F.col("tenor").isin("1-URGENT", "3-MEDIUM", "5-LOW"), F.col("ratio")))
    w = Window.orderBy("years")  # tenors: a fixed dimension of a few rows
    point = F.when(F.col("ratio").isNotNull(), F.struct("years", "ratio"))
    p, n = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(point, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = r.withColumn("p", p).withColumn("n", n)
    line = F.col("p.ratio") + (F.col("years") - F.col("p.years")) / (F.col("n.years") - F.col("p.years")) * (F.col("n.ratio") - F.col("p.ratio"))
    return x.select("tenor", r6(F.coalesce("ratio", line)).alias("ratio"))


@register("win_train_test_split", ps("SELECT tenor, m, row_number() OVER (PARTITION BY tenor ORDER BY m) <= floor(0.55 * count(*) OVER (PARTITION BY tenor)) AS train FROM panel"), dates="m")
def _(spark, d):
    n = F.count("*").over(Window.partitionBy("tenor"))
    return panel(spark, d).select("tenor", "m", (F.row_number().over(by_m()) <= F.floor(0.55 * n)).alias("train"))


@register("win_leave_one_group_out", ps("SELECT k.tenor AS left_out, count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS sd FROM (SELECT DISTINCT tenor FROM panel) k JOIN panel p ON p.tenor <> k.tenor GROUP BY 1"))
def _(spark, d):
    p = panel(spark, d)
    k = F.broadcast(p.select(F.col("tenor").alias("left_out")).distinct())
    return p.join(k, F.col("tenor") != F.col("left_out")).groupBy("left_out").agg(F.count("gap").alias("n"), r6(F.avg("gap")).alias("mean"), r6(F.stddev_samp("gap")).alias("sd"))


@register("win_rank_topk", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10")
def _(spark, d):
    return W.top_k(table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@register("win_dedup_first", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("o_orderkey"))


@register("win_median_row", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn = n // 2 + 1")
def _(spark, d):
    w = Window.partitionBy("event_type")
    x = table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w.orderBy("value", "event_id")).alias("rn"), F.count("*").over(w).alias("n"))
    return x.where("rn = n div 2 + 1").select("event_type", "event_id")
