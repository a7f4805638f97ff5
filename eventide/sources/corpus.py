"""Calendars and corpora: events with chairs, and tagged documents of several sources under one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.windows import interval_label


def build_calendar(dates: DataFrame, chairs: DataFrame, first_year: int, pressers_from: str, before_months: tuple[int, ...]) -> DataFrame:
    """meeting_date, chair, presser_available: chair by closed interval, pressers by rule."""
    x = interval_label(dates.where(F.year("meeting_date") >= first_year), chairs, "meeting_date", "start_d", "end_d", ["chair"], closed=True)
    rule = (F.col("meeting_date") >= F.lit(pressers_from).cast("date")) | F.month("meeting_date").isin(*before_months)
    return x.select("meeting_date", F.coalesce("chair", F.lit("none")).alias("chair"), rule.alias("presser_available"))


def union_corpus(**sources: DataFrame) -> DataFrame:
    """All sources by name with a doc_type tag; columns a source lacks are null."""
    tagged = [df.withColumn("doc_type", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
