"""Ordered series of any length, in parts: row numbers, halo windows, prefix scans, linear recurrences.

A window over a key sorts all the key's rows in one task. Here a key is cut into parts by quantiles of its order column, a date, a
time or a number. What a row needs of other parts comes in one of three ways:

* ``bounded``: rows get numbers, numbers make blocks of equal size, and each block is given the last (and first) rows of its
  neighbours as a halo, so that a bounded frame sees the rows it would see in the whole series;
* ``running``: a prefix scan. Sums, counts, moments and last values run inside a part, and are merged with those of all earlier
  parts, of which there is one row each;
* ``ewma``: an exponentially weighted mean is a recurrence whose steps are affine in the mean before. A part's steps compose into
  one, parts follow the same recurrence, and each part then adds what came in, decayed.

Keys that fit one part take an ordinary window; how many parts the longest key needs is counted, except where the table's
estimated size is small. A key has at most ``MOST_PARTS`` parts: beyond that, parts grow, and a window spills. Rows of one value of the order column
are in one part. Keys may be null, and a null order value comes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a part, the estimated size below which a table is one part for each key, and the most parts of a key.
PART_ROWS, SMALL_BYTES, MOST_PARTS = 100_000, 32 << 20, 32**3


def _list(by: str | list[str] | tuple[str, ...]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def over(by: list[str]):
    """A window over the key; without keys one over all rows, for tables of one row a part only."""
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def ordinal(df: DataFrame, c: str) -> Column:
    """An order column as a double: days, microseconds or the number itself."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def parts_needed(df: DataFrame, by: list[str], part_rows: int | None, usual: int = PART_ROWS) -> int:
    """Parts of ``part_rows`` rows that the longest key needs; by default ``usual`` rows, and 1 part without counting where the plan's estimate is small."""
    if part_rows is None and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES:
        return 1
    longest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return int(max(1, min(MOST_PARTS, -(-longest // (part_rows or usual)))))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``table``, whose rows are one for each value of ``keys``; nulls match."""
    held = table.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    match = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(held, match, how).drop(*[f"_key_{i}" for i in range(len(keys))]) if keys else df.crossJoin(F.broadcast(held))


def cut(df: DataFrame, by: list[str], at: str, n: int) -> DataFrame:
    """``df`` with ``_part``, from 0, rising with ``at``: among n quantiles of the key, found by 32 comparisons a level."""
    if n <= 1:
        return df.withColumn("_part", F.lit(0))
    t = ordinal(df, at)
    marks = df.groupBy(*by).agg(F.percentile_approx(t, [i / n for i in range(1, n)], max(10_000, 8 * n)).alias("_m1"))
    every = lambda k: F.filter("_m1", lambda m, i: (i + 1) % k == 0)
    placed = lookup(df, marks.withColumns({"_m32": every(32), "_m1024": every(1024)}), by)
    place = F.lit(0)
    for width in (1024, 32, 1):
        some = F.slice(f"_m{width}", (place / width).cast("int") + 1, F.lit(32))
        place = place + width * F.size(F.filter(some, lambda m: m < t))
    return placed.withColumn("_part", F.coalesce(place, F.lit(0))).drop("_m1", "_m32", "_m1024")


def numbered(df: DataFrame, by: str | list[str], order: list[str], out: str = "_rn", part_rows: int | None = None) -> DataFrame:
    """``out``: 0, 1, ... of each key by ``order``, whose first column cuts the key into parts."""
    by = _list(by)
    n = parts_needed(df, by, part_rows)
    if n == 1:
        return df.withColumn(out, (F.row_number().over(over(by).orderBy(*order)) - 1).cast("long"))
    x = cut(df, by, order[0], n)
    sizes = x.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(over(by).orderBy("_part")) - F.col("_size")).drop("_size")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return lookup(x.withColumn("_inside", inside), before, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def bounded(df: DataFrame, by: str | list[str], order: str | list[str], before: int, make: Callable, after: int = 0, part_rows: int | None = None) -> DataFrame:
    """``df`` with the columns that ``make`` gives for a window by ``order``, whose frames reach at most ``before`` rows back and ``after`` ahead."""
    by, order = _list(by), _list(order)
    n = parts_needed(df, by, part_rows)
    if n == 1:
        return df.withColumns(make(over(by).orderBy(*order)))
    size = max(part_rows or PART_ROWS, before, after, 1)
    x = numbered(df, by, order, "_rn", part_rows)
    block, place = F.expr(f"_rn div {size}"), F.col("_rn") % size
    seat = lambda b, own: F.struct(b.alias("block"), F.lit(own).alias("own"))
    none = F.array().cast("array<struct<block: bigint, own: boolean>>")
    ahead = F.when(place >= size - before, F.array(seat(block + 1, False))).otherwise(none)
    behind = F.when((place < after) & (block > 0), F.array(seat(block - 1, False))).otherwise(none)
    x = x.withColumn("_seat", F.explode(F.concat(F.array(seat(block, True)), ahead, behind)))
    x = x.withColumns({"_block": F.col("_seat.block"), "_own": F.col("_seat.own")}).drop("_seat")
    x = x.withColumns(make(Window.partitionBy(*by, "_block").orderBy("_rn")))
    return x.where("_own").drop("_own", "_block", "_rn")


def running(df: DataFrame, by: str | list[str], at: str, columns: dict[str, tuple[str, str]], current: bool = True, part_rows: int | None = None) -> DataFrame:
    """``df`` with running columns, named, each (count | sum | avg | std | last, of which column), of the rows so far or, unless ``current``, of those before.

    Nulls are passed over; ``std`` is that of a sample. ``last`` is the last value that is not null.
    """
    by = _list(by)
    upto = 0 if current else -1
    n = parts_needed(df, by, part_rows)
    xs = sorted({x for _, x in columns.values()})
    if n == 1:
        w = over(by).orderBy(at).rowsBetween(Window.unboundedPreceding, upto)
        plain = {"count": F.count, "sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "last": lambda x: F.last(x, ignorenulls=True)}
        return df.withColumns({out: plain[kind](x).over(w) for out, (kind, x) in columns.items()})
    rows = cut(df, by, at, n)
    kinds = {x: {kind for kind, c in columns.values() if c == x} for x in xs}

    def facts(x: str) -> dict[str, Column]:
        """Partial aggregates of a part, enough for what is asked of ``x``."""
        out = {}
        if kinds[x] - {"last"}:
            out |= {f"_n_{x}": F.count(x)}
        if kinds[x] & {"sum", "avg", "std"}:
            out |= {f"_s_{x}": F.sum(x)}
        if "std" in kinds[x]:
            out |= {f"_q_{x}": F.var_pop(x) * F.count(x)}
        if "last" in kinds[x]:
            out |= {f"_l_{x}": F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(at)))}
        return out

    parts = rows.groupBy(*by, "_part").agg(*[c.alias(k) for x in xs for k, c in facts(x).items()])
    earlier = over(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for x in xs:
        count, total = F.col(f"_n_{x}"), F.col(f"_s_{x}")
        for k in facts(x):
            if k == f"_q_{x}":  # squares about the mean of all earlier parts, by way of a fixed point
                zero = F.first(total / F.nullif(count, F.lit(0)), ignorenulls=True).over(over(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                off = F.coalesce(total / F.nullif(count, F.lit(0)), F.lit(0.0)) - zero
                parts = parts.withColumns({f"_d_{x}": count * off, f"_e_{x}": F.coalesce(k, F.lit(0.0)) + count * off * off})
                n_before, d_before = F.sum(count).over(earlier), F.sum(f"_d_{x}").over(earlier)
                carried[f"_c{k}"] = F.sum(f"_e_{x}").over(earlier) - d_before * d_before / F.nullif(n_before, F.lit(0))
            else:
                carried[f"_c{k}"] = F.last(k, ignorenulls=True).over(earlier) if k == f"_l_{x}" else F.sum(k).over(earlier)
    carry = parts.select(*by, "_part", *[c.alias(k) for k, c in carried.items()])
    w = Window.partitionBy(*by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, upto)
    x = lookup(rows, carry, [*by, "_part"])
    out = {}
    for name, (kind, c) in columns.items():
        count = F.count(c).over(w) + F.coalesce(F.col(f"_c_n_{c}"), F.lit(0)) if kind != "last" else None
        if kind in ("sum", "avg", "std"):
            mine, old = F.sum(c).over(w), F.col(f"_c_s_{c}")
            total = F.when(mine.isNull(), old).otherwise(mine + F.coalesce(old, F.lit(0).cast(rows.schema[c].dataType)))
        if kind == "count":
            out[name] = count
        elif kind == "sum":
            out[name] = total
        elif kind == "avg":
            out[name] = total / F.nullif(count, F.lit(0))
        elif kind == "last":
            out[name] = F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_c_l_{c}"))
        else:
            n_in, n_old = F.count(c).over(w), F.coalesce(F.col(f"_c_n_{c}"), F.lit(0))
            apart = F.when((n_in > 0) & (n_old > 0), F.avg(c).over(w) - F.col(f"_c_s_{c}") / n_old).otherwise(0.0)
            squares = F.coalesce(F.var_pop(c).over(w) * n_in, F.lit(0.0)) + F.coalesce(F.col(f"_c_q_{c}"), F.lit(0.0)) + apart * apart * n_in * n_old / F.nullif(n_in + n_old, F.lit(0))
            out[name] = F.when(count > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (count - 1)))
    return x.withColumns(out).drop("_part", *carried)


# ---- linear recurrences ----------------------------------------------------------------------------

#: Logarithm of the factor by which weights fall inside one segment: 500 halvings.
_FALL = 500 * math.log(2)


def recurrence(df: DataFrame, keys: list[str], at: str, a: str, c: str, out: str, log: str) -> DataFrame:
    """``out``: y of y_i = a_i y_(i - 1) + c_i, from 0, with 0 <= a <= 1, by rows of a key; ``log``: running sum of ln a.

    y_i sums c_j exp(L_i - L_j). Running sums of c_j exp(-L_j) would overflow, so they start anew at each of two sets of segments, which
    are half a segment apart; a row takes the set in which its segment began earlier. What lies before weighs less than 2^-250.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn(log, F.sum(F.ln(F.greatest(F.col(a), F.lit(1e-300)))).over(w))
    x = x.withColumns({"_sa": F.floor(-F.col(log) / _FALL), "_sb": F.floor(-F.col(log) / _FALL + 0.5)})

    def inside(segment: str) -> Column:
        e = F.exp(F.col(log) + F.col(segment) * _FALL)
        return e * F.sum(F.col(c) / e).over(Window.partitionBy(*keys, segment).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))

    late = -F.col(log) / _FALL - F.col("_sa") >= 0.5
    x = x.withColumns({"_ya": inside("_sa"), "_yb": inside("_sb")})
    return x.withColumn(out, F.when(late, F.col("_ya")).otherwise(F.col("_yb"))).drop("_sa", "_sb", "_ya", "_yb")


def ewma(df: DataFrame, x: str, by: str | list[str], at: str, span: int, out: str, part_rows: int | None = None) -> DataFrame:
    """``out``: exponentially weighted mean of each key up to and with the row, no bias adjustment; over nulls the old mean loses weight and the sum renormalises.

    Null before the first value. A value after k - 1 nulls meets an old mean of weight (1 - alpha)^k, so each mean is affine in the one
    before. A part composes to (decay, weighted sum), and parts follow the same recurrence.
    """
    by = _list(by)
    alpha = 2 / (span + 1)
    n = parts_needed(df, by, part_rows)
    rows = cut(df.withColumn("_x", F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))), by, at, n)
    keys = [*by, "_part"]
    w = Window.partitionBy(*keys).orderBy(at)
    rows = rows.withColumn("_place", F.row_number().over(w))
    known = F.when(F.col("_x").isNotNull(), F.col("_place"))
    since = F.col("_place") - F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if n > 1:  # rows since the last value before the part
        parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.max(known).alias("_last"))
        order = over(by).orderBy("_part")
        parts = parts.withColumn("_end", F.sum("_size").over(order))
        seen = F.last(F.col("_end") - F.col("_size") + F.col("_last"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = lookup(rows, parts.select(*keys, (F.col("_end") - F.col("_size") - seen).alias("_since")), keys)
        since = F.coalesce(since, F.col("_place") + F.col("_since"))
    rows = rows.withColumn("_gap", since)
    old = F.pow(F.lit(1 - alpha), F.col("_gap"))
    keep = F.when(F.col("_x").isNull(), 1.0).when(F.col("_gap").isNull(), 0.0).otherwise(old / (old + alpha))
    add = F.when(F.col("_x").isNull(), 0.0).when(F.col("_gap").isNull(), F.col("_x")).otherwise(alpha / (old + alpha) * F.col("_x"))
    rows = recurrence(rows.withColumns({"_a": keep, "_c": add}), keys, at, "_a", "_c", "_y", "_log")
    mean, none = F.col("_y"), F.col("_x").isNull() & F.col("_gap").isNull()
    if n > 1:
        ends = rows.groupBy(*keys).agg(F.exp(F.min("_log")).alias("_a"), F.max_by("_y", "_place").alias("_c"))
        ends = recurrence(ends.withColumn("_all", F.lit(0)), ["_all", *by], "_part", "_a", "_c", "_out", "_log")
        into = ends.select(*keys, F.lag("_out").over(over(by).orderBy("_part")).alias("_in"))
        rows = lookup(rows, into, keys)
        mean = mean + F.exp("_log") * F.coalesce("_in", F.lit(0.0))
    return rows.select(*df.columns, F.when(~none, mean).alias(out))
