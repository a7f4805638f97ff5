"""Ranks and medians among all values so far, for series of any length.

A frame that grows with every row would keep a whole history for each. Here a key's rows are cut into time buckets and
value buckets by quantiles. Value buckets are the quantiles themselves and the open intervals between them, so a value that
very many rows share has a bucket of its own. A table of counts, one cell for each pair of buckets, says how many earlier values lie in
whole value buckets below, and how many equal a shared value; what is left is compared inside one time bucket and inside one
interval, so no task holds more than a bucket of rows, whatever values repeat. Keys shorter than a bucket are one group each.

A key has as many buckets as its rows need, but beyond ``MANY_BUCKETS`` no more than the cube root of its rows, since cells are their
square: a billion rows of one key are 1,000 buckets of a million, a trillion 10,000 of a hundred million.

Rows are ordered by ``at``; rows of one time are in one bucket, in no particular order. Null values have no rank and are
not counted; keys may be null.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.session import stored

#: Rows that one task holds at least before a key is cut, and the number of buckets from which they grow.
BUCKET_ROWS, MANY_BUCKETS = 50_000, 1000


def _ordinal(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def _bucketed(df: DataFrame, x: str, by: list[str], at: str, bucket_rows: int) -> tuple[DataFrame, int]:
    """Rows with _key, _t, _x and, where keys are cut, time bucket _tb and value bucket _vb; and the number of buckets."""
    rows = df.withColumns({"_key": F.to_json(F.struct(*by)), "_t": _ordinal(df, at), "_x": F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))})
    longest = rows.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
    n = min(-(-longest // bucket_rows), max(MANY_BUCKETS, round(longest ** (1 / 3))))
    if n <= 1:
        return rows, 1
    inner = [i / n for i in range(1, n)]
    marks = rows.groupBy(F.col("_key").alias("_mk")).agg(F.percentile_approx("_t", inner, 100_000).alias("_tm"), F.percentile_approx("_x", inner, 100_000).alias("_vm"))
    marks = stored(marks, "marks")  # approximate quantiles depend on the order of merging: all readers must see the same ones
    placed = rows.join(marks, F.col("_key") == F.col("_mk"))
    below = lambda m, v: F.size(F.filter(m, lambda q: q < v))
    # even buckets are open intervals, odd ones a value
    value = 2 * below(F.col("_vm"), F.col("_x")) + F.array_contains("_vm", F.col("_x")).cast("int")
    return placed.withColumns({"_tb": below(F.col("_tm"), F.col("_t")), "_vb": F.when(F.col("_x").isNotNull(), value)}).drop("_mk", "_tm", "_vm"), n


def _cells(rows: DataFrame) -> DataFrame:
    """Values of each pair of buckets; a time bucket of nulls alone has a cell of none."""
    return rows.groupBy("_key", "_tb", F.coalesce("_vb", F.lit(0)).alias("_vb")).agg(F.count("_x").alias("_n"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Counts of one key by time bucket and value bucket."""
    m = np.zeros((pdf["_tb"].max() + 1, pdf["_vb"].max() + 1), dtype=np.int64)
    np.add.at(m, (pdf["_tb"].to_numpy(), pdf["_vb"].to_numpy()), pdf["_n"].to_numpy())
    return m


def earlier(values: np.ndarray, times: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """For each value, how many values of strictly smaller time are less than it, and how many equal it."""
    order = np.argsort(times, kind="stable")
    v, t = values[order], times[order]
    less, equal = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
    groups = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, dtype=np.int64)
    seen, a = np.zeros(0), 0
    while a < len(v):
        k = np.searchsorted(groups, a + block)
        z = int(groups[k]) if k < len(groups) else len(v)
        part, when = v[a:z], t[a:z]
        lo = np.searchsorted(seen, part, "left")
        less[a:z], equal[a:z] = lo, np.searchsorted(seen, part, "right") - lo
        if when[0] != when[-1]:  # several times in one block: at most a block of them, then one group
            for b in range(0, z - a, block):
                before = when[None, :] < when[b : b + block, None]
                less[a + b : a + b + block] += (before & (part[None, :] < part[b : b + block, None])).sum(1)
                equal[a + b : a + b + block] += (before & (part[None, :] == part[b : b + block, None])).sum(1)
        seen = np.sort(np.r_[seen, part], kind="stable")
        a = z
    back = np.empty(len(v), dtype=np.int64)
    back[order] = np.arange(len(v))
    return less[back], equal[back]


def _with(df: DataFrame, **kinds: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, T._parse_datatype_string(k)) for c, k in kinds.items()]])


def _add(rows: DataFrame, keys: list[str], add: dict[str, str], f) -> DataFrame:
    """``f`` gets a group's frame and returns its new columns by name."""
    schema = _with(rows, **add)
    names = [c.name for c in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**f(pdf))[names]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _inside(pdf: pd.DataFrame) -> dict:
    """Counts among rows of the group up to each row: less, equal (itself not counted), and non-null values with itself."""
    order = np.argsort(pdf["_t"].to_numpy(), kind="stable")
    place = np.empty(len(pdf), dtype=np.int64)
    place[order] = np.arange(len(pdf))
    x = pdf["_x"].to_numpy(dtype=float)
    known = np.isfinite(x) | np.isinf(x)
    less, equal, upto = (np.zeros(len(pdf), dtype=np.int64) for _ in range(3))
    less[known], equal[known] = earlier(x[known], place[known])
    upto[order] = np.cumsum(known[order])
    return {"_less": less, "_equal": equal, "_upto": upto}


def _across(pdf: pd.DataFrame) -> dict:
    """Counts among rows of the same value bucket in earlier time buckets."""
    less, equal = earlier(pdf["_x"].to_numpy(dtype=float), pdf["_tb"].to_numpy())
    return {"_less2": less, "_equal2": equal}


def _below(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each cell, how many earlier values lie in lower value buckets, how many in its own, and how many earlier values there are."""
    m = _matrix(pdf)
    before = np.vstack([np.zeros((1, m.shape[1]), dtype=np.int64), np.cumsum(m, axis=0)[:-1]])
    under = np.cumsum(before, axis=1) - before
    tb, vb = pdf["_tb"].to_numpy(), pdf["_vb"].to_numpy()
    return pd.DataFrame({"_k": pdf["_key"], "_ctb": tb, "_cvb": vb, "_under": under[tb, vb], "_own": before[tb, vb], "_seen": before.sum(1)[tb]})


def expanding_rank(df: DataFrame, x: str, by: str | list[str], at: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pct rank of each value among all values of its key so far, itself included, ties averaged; null for nulls."""
    by = [by] if isinstance(by, str) else list(by)
    rows, n = _bucketed(df, x, by, at, bucket_rows)
    counts = {"_less": "long", "_equal": "long", "_upto": "long"}
    less, equal, seen = F.col("_less"), F.col("_equal"), F.col("_upto")
    if n == 1:
        rows = _add(rows, ["_key"], counts, _inside)
    else:
        under = _cells(rows).groupBy("_key").applyInPandas(_below, "_k string, _ctb int, _cvb int, _under long, _own long, _seen long")
        rows = _add(rows, ["_key", "_tb"], counts, _inside)
        known = _add(rows.where("_vb % 2 = 0"), ["_key", "_vb"], {"_less2": "long", "_equal2": "long"}, _across)
        known = known.unionByName(rows.where("_vb % 2 = 1"), allowMissingColumns=True)
        known = known.alias("known").join(under, (F.col("_key") == F.col("_k")) & (F.col("_tb") == F.col("_ctb")) & (F.col("_vb") == F.col("_cvb")))
        rows = known.unionByName(rows.where(F.col("_x").isNull()), allowMissingColumns=True)
        of_value = F.col("_vb") % 2 == 1
        less = less + F.col("_under") + F.when(of_value, 0).otherwise(F.col("_less2"))
        equal, seen = equal + F.when(of_value, F.col("_own")).otherwise(F.col("_equal2")), seen + F.col("_seen")
    rank = F.when(F.col("_x").isNotNull(), (less + (equal + 2) / 2) / seen)
    return rows.select(*df.columns, rank.alias(out))


def _windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each time bucket: earlier values, the value buckets that may hold a median of its rows, and earlier values below those."""
    m = _matrix(pdf)
    before = np.vstack([np.zeros((1, m.shape[1]), dtype=np.int64), np.cumsum(m, axis=0)[:-1]])
    out = []
    for tb in range(len(m)):
        s, own = int(before[tb].sum()), int(m[tb].sum())
        reach = np.cumsum(before[tb])
        lo, hi = (int(np.searchsorted(reach, r, "right")) for r in (max(0, s // 2 - own - 1), min(s - 1, (s + own) // 2 + 1))) if s else (0, -1)
        out.append((pdf["_key"].iloc[0], tb, s, lo, hi, int(reach[lo] - before[tb][lo]) if s else 0))
    return pd.DataFrame(out, columns=["_k", "_wtb", "_seen", "_lo", "_hi", "_under"])


def _medians(rows: pd.DataFrame, known: list[float], seen: int, under: int) -> np.ndarray:
    """Medians after each row, in the frame's order; ``known`` holds the sorted earlier values from rank ``under`` on."""
    out = np.full(len(rows), np.nan)
    x = rows["_x"].to_numpy(dtype=float)
    for i in np.argsort(rows["_t"].to_numpy(), kind="stable").tolist():
        if x[i] == x[i]:
            bisect.insort(known, x[i])
            seen += 1
        if seen:
            out[i] = (known[(seen - 1) // 2 - under] + known[seen // 2 - under]) / 2
    return out


def _ranked(values: pd.DataFrame, own: int, seen: int, under: int) -> tuple[list[float], int]:
    """The earlier values, from (value, count), that may be a median while ``own`` more come in, sorted, and the rank of the first."""
    counts = values.groupby("_hx")["_hn"].sum()
    end = under + counts.cumsum().to_numpy()
    low, high = max(under, (seen - 1) // 2 - own - 1), (seen + own) // 2 + 1
    kept = np.minimum(end, high + 1) - np.maximum(end - counts.to_numpy(), low)
    return np.repeat(counts.index.to_numpy(dtype=float), np.maximum(kept, 0)).tolist(), low


def expanding_median(df: DataFrame, x: str, by: str | list[str], at: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Median of all values of the key so far, the row's own included; null before the first value."""
    by = [by] if isinstance(by, str) else list(by)
    rows, n = _bucketed(df, x, by, at, bucket_rows)
    if n == 1:
        rows = _add(rows, ["_key"], {"_median": "double"}, lambda pdf: {"_median": _medians(pdf, [], 0, 0)})
    else:
        windows = _cells(rows).groupBy("_key").applyInPandas(_windows, "_k string, _wtb int, _seen long, _lo int, _hi int, _under long")
        rows = rows.join(windows.select("_k", "_wtb", "_seen", "_under"), (F.col("_key") == F.col("_k")) & (F.col("_tb") == F.col("_wtb"))).drop("_k", "_wtb")
        asked = windows.where("_lo <= _hi").select(F.col("_k").alias("_ak"), F.col("_wtb").alias("_atb"), F.explode(F.sequence("_lo", "_hi")).alias("_avb"))
        values = rows.where(F.col("_x").isNotNull()).groupBy("_key", "_tb", "_vb", "_x").agg(F.count(F.lit(1)).alias("_n"))  # equal values travel as one row
        history = values.join(asked, (F.col("_key") == F.col("_ak")) & (F.col("_vb") == F.col("_avb")) & (F.col("_tb") < F.col("_atb"))).select(F.col("_key").alias("_hk"), F.col("_atb").alias("_htb"), F.col("_x").alias("_hx"), F.col("_n").alias("_hn"))
        schema = _with(rows, _median="double")
        names = [c.name for c in schema]

        def run(own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame(columns=names)
            seen, under = (int(own[c].iloc[0]) for c in ("_seen", "_under"))
            known, under = _ranked(old, len(own), seen, under)
            return own.assign(_median=_medians(own, known, seen, under))[names]

        rows = rows.groupBy("_key", "_tb").cogroup(history.groupBy("_hk", "_htb")).applyInPandas(run, schema)
    return rows.select(*df.columns, F.nanvl("_median", F.lit(None).cast("double")).alias(out))
