"""Ordered-window and as-of operators.

Everything is partitioned by a key; as-of joins also by a time bucket, so neither a global timeline nor a hot
key has to be sorted in one task: each bucket sees its own rows plus the last (or next) value of other buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.expanding import expanding_median as expanding_median
from eventide.operators.expanding import expanding_rank as expanding_rank
from eventide.operators.ranges import ordinal


#: Intervals that are compared with every row; more are joined by bins.
FEW_INTERVALS = 256


def asof(left: DataFrame, right: DataFrame, on: tuple[str, str], cols: list[str], by: list[str] = (), how: str = "lt", bucket: str = "year") -> DataFrame:
    """Left rows with ``cols`` of the last right row strictly before ('lt'), on or before ('le'), or the first on or after ('ge').

    One exchange of both sides by (key, bucket); the carry over buckets is an aggregate with one row per bucket.
    """
    lt, rt = on
    by = list(by)
    forward = how == "ge"
    value = F.struct(F.col(rt).alias("_at"), *[F.col(c) for c in cols])
    r = right.where(F.col(rt).isNotNull()).select(*by, F.col(rt).alias("_t"), value.alias("_v"))
    r = r.withColumn("_b", F.date_trunc(bucket, F.col("_t").cast("timestamp")))
    edge = F.min_by("_v", "_t") if forward else F.max_by("_v", "_t")
    ends = r.groupBy(*by, "_b").agg(edge.alias("_e"))
    lb = F.date_trunc(bucket, F.col(lt).cast("timestamp"))
    rows = left.select(*by, F.col(lt).alias("_t"), F.struct(*left.columns).alias("_l")).withColumn("_b", lb if lt == "_t" else F.date_trunc(bucket, F.col("_t").cast("timestamp")))
    # buckets of both sides, with the nearest value of other buckets
    known = ends.unionByName(rows.select(*by, "_b").distinct(), allowMissingColumns=True).groupBy(*by, "_b").agg(F.first("_e", ignorenulls=True).alias("_e"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    carry = F.first("_e", ignorenulls=True).over(over.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("_e", ignorenulls=True).over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    known = known.select(*by, "_b", carry.alias("_carry"))
    none_l, none_v = F.lit(None).cast(rows.schema["_l"].dataType), F.lit(None).cast(r.schema["_v"].dataType)
    right_first = how == "le"
    both = rows.select(*by, "_b", "_t", "_l", none_v.alias("_v"), F.lit(1 if right_first else 0).alias("_o")).unionByName(r.select(*by, "_b", "_t", none_l.alias("_l"), "_v", F.lit(0 if right_first else 1).alias("_o")))
    w = Window.partitionBy(*by, "_b").orderBy("_t", "_o")
    inside = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_in", inside).where(F.col("_l").isNotNull())
    keys = [*by, "_b"]
    joined = found.alias("f").join(known.alias("k"), on=[F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], how="left")
    pick = F.coalesce("_in", "_carry")
    return joined.select("_l.*", pick["_at"].alias(f"{rt}_asof"), *[pick[c].alias(c) for c in cols])


def latest_of(series: DataFrame, name: str, at: str, value: str, columns: dict[str, str]) -> DataFrame:
    """One row for each time, with the last value of each named series up to then, so that one as-of join serves all.

    A map-side combined pivot with named columns; a macro series has a row a month, and the window runs over its times.
    """
    x = series.groupBy(at).agg(*[F.max(F.when(F.col(name) == k, F.col(value))).alias(c) for k, c in columns.items()])
    w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return x.select(at, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns.values()])


def interval_label(df: DataFrame, intervals: DataFrame, at: str, start: str, end: str, cols: list[str], closed: bool = False) -> DataFrame:
    """Point in interval: start <= at < end, or <= end if ``closed``; null columns where no interval holds the row, one row for each that does.

    An interval join by bins of dyadic widths: an interval is listed under the two bins or less that it touches at the smallest width
    that is at least its length, each distinct time asks for its own bin of each width in use, and a filter refines. So a long interval is
    as cheap as a short one. Only tables of at most ``FEW_INTERVALS`` intervals, which is checked, are broadcast. An interval without an end holds nothing.
    """
    lo, hi, t = ordinal(intervals, start), ordinal(intervals, end), ordinal(df, at)
    upper = lambda at: at <= F.col("_end") if closed else at < F.col("_end")
    held = intervals.select(F.col(start).alias("_start"), F.col(end).alias("_end"), *[F.col(c).alias(f"_v_{c}") for c in cols], lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")
    values = [f"_v_{c}" for c in cols]
    if held.limit(FEW_INTERVALS + 1).count() <= FEW_INTERVALS:
        x = df.join(F.broadcast(held.select("_start", "_end", *values)), (F.col(at) >= F.col("_start")) & upper(F.col(at)), "left")
        return x.select(*df.columns, *[F.col(v).alias(c) for v, c in zip(values, cols)])
    # the width is a power of two that is at least the interval's length
    listed = held.withColumn("_level", F.ceil(F.log2(F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0)))).cast("int"))
    bin_of = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    levels = [r[0] for r in listed.select("_level").distinct().collect()]  # at most 64 widths
    listed = listed.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_lo")), bin_of(F.col("_hi")))))
    asked = df.where(F.col(at).isNotNull()).select(F.col(at).alias("_at"), t.alias("_t")).distinct().withColumn("_level", F.explode(F.lit(levels)))
    found = asked.withColumn("_bin", bin_of(F.col("_t"))).join(listed, ["_level", "_bin"]).where((F.col("_at") >= F.col("_start")) & upper(F.col("_at")))
    return df.join(found.select("_at", *values), F.col(at) == F.col("_at"), "left").select(*df.columns, *[F.col(v).alias(c) for v, c in zip(values, cols)])


def event_rows(events: DataFrame, series: DataFrame, by: str, event: str, at: str, before: int, after: int) -> DataFrame:
    """Rows of each key's series around each event by position.

    ``pos`` counts rows: 1 is the first row strictly after the event, 0 the last on or before it. Equi-join on row
    numbers instead of a theta join: events find their position once, then ask for the rows they need. No task sorts a
    whole series.
    """
    numbered = number_rows(series, at, "_rn", by=[by]).withColumn("_rn", (F.col("_rn") + 1).cast("int"))
    keys = series.select(by).distinct()
    asked = events.select(event).crossJoin(keys)  # an event calendar and the keys of a dimension: Spark sends the smaller one
    anchor = asof(asked, numbered, (event, at), ["_rn"], by=[by], how="le").drop(f"{at}_asof")
    wanted = anchor.select(event, by, F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("pos"), F.coalesce("_rn", F.lit(0)).alias("_at"))
    wanted = wanted.withColumn("_rn", F.col("_at") + F.col("pos")).drop("_at")
    return wanted.join(numbered, [by, "_rn"]).drop("_rn")


def number_rows(df: DataFrame, at: str, out: str, bucket: str = "year", by: list[str] = ()) -> DataFrame:
    """``out``: 0, 1, ... of each key in order of a date or time column, without one sort of all its rows: numbers inside a bucket, plus the rows of earlier ones."""
    by = list(by)
    x = df.withColumn("_b", F.date_trunc(bucket, F.col(at).cast("timestamp")))
    sizes = x.groupBy(*by, "_b").agg(F.count("*").alias("_n"))  # one row for each key and bucket
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = sizes.select(*[F.col(c).alias(f"_s{c}") for c in by], F.col("_b").alias("_sb"), (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = x.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(at)) - 1)
    match = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in by] + [F.col("_b").eqNullSafe(F.col("_sb"))]
    return inside.join(before, match).withColumn(out, (F.col("_before") + F.col("_place")).cast("long")).drop("_b", "_sb", "_place", "_before", *[f"_s{c}" for c in by])


def trailing(x: str, w, n: int, least: int = 2) -> tuple[Column, Column]:
    """(mean, sample std) of the n prior rows of an ordered window, null below ``least`` values."""
    w = w.rowsBetween(-n, -1)
    enough = F.count(x).over(w) >= least
    return F.when(enough, F.avg(x).over(w)), F.when(enough, F.stddev_samp(x).over(w))


def expanding(by: str, at: str, current: bool = True):
    return Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if current else -1)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def interpolate(grid: DataFrame, points: DataFrame, by: str, at: str, x: str) -> DataFrame:
    """Linear interpolation of each key's points at the grid's times; outside the points null."""
    before = asof(grid, points.withColumnRenamed(x, "_x0"), (at, at), ["_x0"], by=[by], how="le").withColumnRenamed(f"{at}_asof", "_t0")
    both = asof(before, points.withColumnRenamed(x, "_x1"), (at, at), ["_x1"], by=[by], how="ge").withColumnRenamed(f"{at}_asof", "_t1")
    span = F.date_diff("_t1", "_t0")
    share = F.date_diff(F.col(at), F.col("_t0")) / F.nullif(span, F.lit(0))
    return both.withColumn(x, F.when(span == 0, F.col("_x0")).otherwise(F.col("_x0") + share * (F.col("_x1") - F.col("_x0")))).drop("_x0", "_x1", "_t0", "_t1")
