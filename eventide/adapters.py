"""Domain tables derived from the driver's tables, as DataFrames and as DuckDB common table expressions.

events -> hourly bars per event type (a tenor); orders -> daily price series and a monthly panel per priority;
lineitem -> monthly macro series per return flag; every 45th order date -> the event calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much to process: dealt over all cores where the scan itself has fewer parts than cores.

    A large table has many more, and is left as the scan gives it.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenor, ts, o, h, l, c, n: hourly open, high, low, close."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("tenor"), F.date_trunc("hour", "ts").alias("bar")).agg(F.min_by("value", "ts").alias("o"), F.max("value").alias("h"), F.min("value").alias("l"), F.max_by("value", "ts").alias("c"), F.count("value").alias("n")).withColumnRenamed("bar", "ts")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenor, d, px: mean order price per priority and day, in thousands."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("tenor"), F.to_date("o_orderdate").alias("d")).agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("px"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_date: every 45th distinct order date; a calendar has as many rows as there are days, not rows of data."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.withColumn("rn", F.row_number().over(Window.orderBy("d"))).where("rn % 45 = 0").select(F.col("d").alias("meeting_date"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenor, m, iv, rv, n, gap: monthly level and dispersion; gap = iv - rv, null every 7th month."""
    o = table(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_orderpriority").alias("tenor"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(
        F.round(F.avg("o_totalprice") / 10000, 6).alias("iv"), F.round(F.stddev_samp("o_totalprice") / 10000, 6).alias("rv"), F.count("o_totalprice").alias("n")
    )
    return p.withColumn("gap", F.when(F.month("m") % 7 != 0, F.round(F.col("iv") - F.col("rv"), 6)))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, d, value: monthly means per return flag."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("series"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg(F.round(F.avg("l_extendedprice") / 10000, 6).alias("value"))


#: Fixed example chronology: start, end, direction, label, crisis; each end is the day before the next start.
CHRONOLOGY = [
    ("1995-01-01", "1996-01-30", "ADD", "early_easing", False),
    ("1996-01-31", "1997-03-24", "NONE", "plateau", False),
    ("1997-03-25", "1998-09-28", "REMOVE", "tightening", False),
    ("1998-09-29", "1999-06-29", "ADD", "crisis_cuts", True),
    ("1999-06-30", "2001-01-02", "REMOVE", "late_hikes", False),
    ("2001-01-03", "2001-12-31", "ADD", "recession_cuts", True),
]


def chronology(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CHRONOLOGY, "s string, e string, direction string, label string, crisis boolean")
    return rows.select(F.to_date("s").alias("start_d"), F.to_date("e").alias("end_d"), "direction", "label", "crisis")


CTE = {
    "bars": "SELECT event_type AS tenor, date_trunc('hour', e.ts) AS ts, arg_min(value, e.ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, e.ts) AS c, count(value) AS n FROM events e GROUP BY event_type, date_trunc('hour', e.ts)",
    "series": "SELECT o_orderpriority AS tenor, CAST(o_orderdate AS DATE) AS d, round(avg(o_totalprice) / 1000, 6) AS px FROM orders GROUP BY 1, 2",
    "cal": "SELECT d AS meeting_date FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE rn % 45 = 0",
    "panel": "SELECT *, CASE WHEN month(m) % 7 <> 0 THEN round(iv - rv, 6) END AS gap FROM (SELECT o_orderpriority AS tenor, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, round(avg(o_totalprice) / 10000, 6) AS iv, round(stddev_samp(o_totalprice) / 10000, 6) AS rv, count(o_totalprice) AS n FROM orders GROUP BY 1, 2)",
    "macro": "SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, round(avg(l_extendedprice) / 10000, 6) AS value FROM lineitem GROUP BY 1, 2",
    "chron": "SELECT CAST(s AS DATE) AS start_d, CAST(e AS DATE) AS end_d, direction, label, crisis FROM (VALUES " + ", ".join(f"('{s}', '{e}', '{d}', '{n}', {str(c).lower()})" for s, e, d, n, c in CHRONOLOGY) + ") AS v(s, e, direction, label, crisis)",
}


def sql(names: str, body: str) -> str:
    """A DuckDB query over the named domain tables."""
    parts = [f"{n} AS ({CTE[n]})" for n in names.split()]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[5:]
    return "WITH RECURSIVE " + ", ".join(parts) + " " + body
