"""Equi, as-of, interval, event-window and fold joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.adapters import bars, calendar, chronology, macro, panel, series, sql, table
from eventide.catalog import register
from eventide.functions.scalar import business_days_before, r6
from eventide.operators import windows as W
from eventide.operators.folds import earlier_stats


@register("join_inner", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment", "o_totalprice")


@register("join_left", "SELECT d.doc_id, CAST(q.quality AS DOUBLE) AS quality, CAST(q.toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


@register("join_outer", sql("panel", "SELECT coalesce(a.m, b.m) AS m, a.iv AS front, b.iv AS back FROM (SELECT m, iv FROM panel WHERE tenor = '1-URGENT' AND n % 3 > 0) a FULL JOIN (SELECT m, iv FROM panel WHERE tenor = '5-LOW' AND n % 4 > 0) b ON a.m = b.m"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    a = p.where("tenor = '1-URGENT' AND n % 3 > 0").select("m", F.col("iv").alias("front"))
    b = p.where("tenor = '5-LOW' AND n % 4 > 0").select("m", F.col("iv").alias("back"))
    return a.join(b, "m", "full")


@register("join_semi", sql("cal", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT meeting_date FROM cal)"))
def _(spark, d):
    o, m = table(spark, d, "orders"), calendar(spark, d)
    return o.join(m, F.to_date(o.o_orderdate) == m.meeting_date, "left_semi").select("o_orderkey")


@register("join_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@register("join_self_pair", sql("panel", "SELECT f.m, round(f.gap - b.gap, 6) AS gap_spread FROM panel f JOIN panel b ON f.m = b.m AND f.tenor = '1-URGENT' AND b.tenor = '5-LOW'"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    f, b = p.where("tenor = '1-URGENT'").select("m", F.col("gap").alias("f")), p.where("tenor = '5-LOW'").select("m", F.col("gap").alias("b"))
    return f.join(b, "m").select("m", r6(F.col("f") - F.col("b")).alias("gap_spread"))


def _asof_sql(op: str, order: str) -> str:
    return sql("cal macro", f"SELECT k.series, meeting_date, (SELECT value FROM macro x WHERE x.series = k.series AND x.d {op} meeting_date ORDER BY x.d {order} LIMIT 1) AS value FROM cal CROSS JOIN (SELECT DISTINCT series FROM macro) k")


def _asof(spark, d, how):
    x = macro(spark, d)
    asked = calendar(spark, d).crossJoin(F.broadcast(x.select("series").distinct()))
    return W.asof(asked, x, ("meeting_date", "d"), ["value"], by=["series"], how=how).select("series", "meeting_date", "value")


@register("join_asof_lt", _asof_sql("<", "DESC"), dates="meeting_date")
def _(spark, d):
    return _asof(spark, d, "lt")


@register("join_asof_le", sql("cal series", "SELECT c.meeting_date, s.tenor, s.px FROM cal c CROSS JOIN (SELECT DISTINCT tenor FROM series) k ASOF LEFT JOIN series s ON s.tenor = k.tenor AND s.d <= c.meeting_date - INTERVAL 2 DAY"), dates="meeting_date")
def _(spark, d):
    s = series(spark, d)
    asked = calendar(spark, d).withColumn("at", F.date_sub("meeting_date", 2)).crossJoin(F.broadcast(s.select("tenor").distinct()))
    return W.asof(asked, s, ("at", "d"), ["px"], by=["tenor"], how="le").select("meeting_date", "tenor", "px")


@register("join_asof_fwd", _asof_sql(">=", "ASC"), dates="meeting_date")
def _(spark, d):
    return _asof(spark, d, "ge")


@register("join_asof_global", sql("cal", "SELECT meeting_date, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE CAST(o_orderdate AS DATE) < meeting_date) AS d FROM cal"), dates="meeting_date d")
def _(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("t"))
    return W.asof(calendar(spark, d), o, ("meeting_date", "t"), [], how="lt").select("meeting_date", F.col("t_asof").alias("d"))


@register("join_positional", sql("cal series", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY d) AS rn FROM series), a AS (SELECT meeting_date, tenor, min(rn) AS rn FROM cal, n WHERE n.d >= meeting_date GROUP BY 1, 2) SELECT a.meeting_date, a.tenor, p.px AS pre, q.px AS post FROM a LEFT JOIN n p ON p.tenor = a.tenor AND p.rn = a.rn - 1 LEFT JOIN n q ON q.tenor = a.tenor AND q.rn = a.rn + 1"), dates="meeting_date")
def _(spark, d):
    w = Window.partitionBy("tenor").orderBy("d")
    s = series(spark, d).withColumn("pre", F.lag("px").over(w)).withColumn("post", F.lead("px").over(w))
    asked = calendar(spark, d).crossJoin(F.broadcast(s.select("tenor").distinct()))
    return W.asof(asked, s, ("meeting_date", "d"), ["pre", "post"], by=["tenor"], how="ge").where("d_asof IS NOT NULL").select("meeting_date", "tenor", "pre", "post")


@register("join_asof_lag_n", sql("cal series", "WITH n AS (SELECT *, lag(px, 64) OVER (PARTITION BY tenor ORDER BY d) AS old FROM series) SELECT c.meeting_date, n.tenor, n.old, CAST(sign(n.px - n.old) AS DOUBLE) AS dir FROM cal c CROSS JOIN (SELECT DISTINCT tenor FROM series) k ASOF LEFT JOIN n ON n.tenor = k.tenor AND n.d < c.meeting_date"), dates="meeting_date")
def _(spark, d):
    s = series(spark, d).withColumn("old", F.lag("px", 64).over(Window.partitionBy("tenor").orderBy("d")))
    asked = calendar(spark, d).crossJoin(F.broadcast(s.select("tenor").distinct()))
    x = W.asof(asked, s, ("meeting_date", "d"), ["px", "old"], by=["tenor"], how="lt").where("px IS NOT NULL")
    return x.select("meeting_date", "tenor", "old", F.signum(F.col("px") - F.col("old")).alias("dir"))


@register("join_range_interval", sql("chron", "SELECT o_orderkey, coalesce(label, 'unknown') AS label, coalesce(crisis, false) AS crisis FROM orders LEFT JOIN chron ON CAST(o_orderdate AS DATE) >= start_d AND CAST(o_orderdate AS DATE) < end_d"))
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("at"))
    x = W.interval_label(o, chronology(spark), "at", "start_d", "end_d", ["label", "crisis"])
    return x.select("o_orderkey", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("crisis", F.lit(False)).alias("crisis"))


@register("join_range_closed", sql("cal chron", "SELECT meeting_date, direction AS chair FROM cal LEFT JOIN chron ON meeting_date BETWEEN start_d AND end_d"), dates="meeting_date")
def _(spark, d):
    return W.interval_label(calendar(spark, d), chronology(spark), "meeting_date", "start_d", "end_d", ["direction"], closed=True).withColumnRenamed("direction", "chair")


@register("join_event_window", sql("cal series", "SELECT meeting_date, tenor, pos, d, px FROM (SELECT meeting_date, tenor, d, px, row_number() OVER (PARTITION BY meeting_date, tenor ORDER BY d) AS pos FROM cal JOIN series ON d > meeting_date) WHERE pos <= 5"), dates="meeting_date d")
def _(spark, d):
    return W.event_rows(calendar(spark, d), series(spark, d), "tenor", "meeting_date", "d", 0, 5).where("pos > 0").select("meeting_date", "tenor", "pos", "d", "px")


@register("join_calendar_window", sql("cal series", "SELECT meeting_date, tenor, round(avg(px), 6) AS mean_px, count(*) AS n FROM cal JOIN series ON d BETWEEN meeting_date - INTERVAL 7 DAY AND meeting_date - INTERVAL 1 DAY GROUP BY 1, 2"), dates="meeting_date")
def _(spark, d):
    # a window of 7 calendar days is 7 equi-join keys per event
    asked = calendar(spark, d).withColumn("d", F.explode(F.sequence(F.date_sub("meeting_date", 7), F.date_sub("meeting_date", 1))))
    return asked.join(series(spark, d), "d").groupBy("meeting_date", "tenor").agg(r6(F.avg("px")).alias("mean_px"), F.count("*").alias("n"))


@register("join_broadcast_scalar", sql("panel", "SELECT tenor, m, round(iv / base, 6) AS ratio FROM panel, (SELECT avg(iv) AS base FROM panel WHERE tenor = '3-MEDIUM')"), dates="m")
def _(spark, d):
    p = panel(spark, d)
    base = F.broadcast(p.where("tenor = '3-MEDIUM'").agg(F.avg("iv").alias("base")))
    return p.crossJoin(base).select("tenor", "m", r6(p.iv / F.col("base")).alias("ratio"))


@register("join_nested_loop", sql("panel", "SELECT z, mult, round(sum(greatest(iv - z, 0) * mult), 4) AS pnl FROM panel, (VALUES (12.0::DOUBLE), (14.0), (16.0)) a(z), (VALUES (0.5::DOUBLE), (1.0)) b(mult) GROUP BY 1, 2"))
def _(spark, d):
    params = spark.createDataFrame([(z, k) for z in (12.0, 14.0, 16.0) for k in (0.5, 1.0)], "z double, mult double")
    x = panel(spark, d).crossJoin(F.broadcast(params))  # a configuration sweep of six rows
    return x.groupBy("z", "mult").agg(F.round(F.sum(F.greatest(F.col("iv") - F.col("z"), F.lit(0.0)) * F.col("mult")), 4).alias("pnl"))


@register("join_fold", sql("panel", "SELECT a.tenor, a.m, count(b.m) AS n_train, round(avg(b.iv), 6) AS mean_train FROM panel a JOIN panel b ON a.tenor = b.tenor AND b.m < a.m GROUP BY 1, 2"), dates="m")
def _(spark, d):
    return earlier_stats(panel(spark, d).select("tenor", "m", "iv"), ["tenor"], "m", "iv").select("tenor", "m", "n_train", r6("mean_train").alias("mean_train"))


@register("cal_build", sql("cal chron", "SELECT meeting_date, coalesce(direction, 'none') AS chair, meeting_date >= DATE '1999-01-01' OR month(meeting_date) IN (3, 6, 9, 12) AS presser_available FROM cal LEFT JOIN chron ON meeting_date BETWEEN start_d AND end_d WHERE year(meeting_date) >= 1996"), dates="meeting_date")
def _(spark, d):
    from eventide.sources.corpus import build_calendar

    chairs = chronology(spark).select("start_d", "end_d", F.col("direction").alias("chair"))
    return build_calendar(calendar(spark, d), chairs, first_year=1996, pressers_from="1999-01-01", before_months=(3, 6, 9, 12))


@register("iv_bridge_move", sql("cal series", "WITH o AS (SELECT meeting_date, CASE isodow(meeting_date) WHEN 1 THEN meeting_date - 4 WHEN 2 THEN meeting_date - 4 WHEN 7 THEN meeting_date - 3 ELSE meeting_date - 2 END AS obs FROM cal) SELECT o.meeting_date, k.tenor, o.obs, round(s.px * k.ratio * k.dur / 100, 6) AS iv FROM o CROSS JOIN (VALUES ('1-URGENT', 0.5, 1.9), ('3-MEDIUM', 1.0, 8.0), ('5-LOW', 0.9, 17.0)) k(tenor, ratio, dur) ASOF LEFT JOIN series s ON s.tenor = '2-HIGH' AND s.d <= o.obs"), dates="meeting_date obs")
def _(spark, d):
    dims = spark.createDataFrame([("1-URGENT", 0.5, 1.9), ("3-MEDIUM", 1.0, 8.0), ("5-LOW", 0.9, 17.0)], "tenor string, ratio double, dur double")
    m = calendar(spark, d)
    # last weekday on or before the date two weekdays earlier
    asked = m.withColumn("obs", business_days_before(m.meeting_date, 2))
    x = W.asof(asked, series(spark, d).where("tenor = '2-HIGH'").select("d", "px"), ("obs", "d"), ["px"], how="le")
    return x.crossJoin(F.broadcast(dims)).select("meeting_date", "tenor", "obs", r6(F.col("px") * F.col("ratio") * F.col("dur") / 100).alias("iv"))
