"""Streaming twins of batch operators: watermarked windows, sessions, deduplication, stateful EWMA.

Each function maps a streaming DataFrame to a streaming DataFrame. ``run_available`` drives one over what is
there now and returns the result as a table in the shared folder, so that no result passes the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventide.session import shared_dir

DELAY = "1 hour"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; its schema is taken from the files once. The glob lets ``path`` be a file or a folder."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, delay: str = DELAY) -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, delay: str = DELAY) -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.max("value").alias("high")).select(F.col("w.start").alias("start"), "event_type", "n", "high")


def sessions(events: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def dedup(events: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def ewma(events: DataFrame, span: int) -> DataFrame:
    """event_type, event_id, mean: state holds one mean per key; a micro-batch's rows of a key are taken in order of time.

    Null values leave the mean as it is; it is null before the first value. ``maxFilesPerTrigger`` bounds a micro-batch, of
    which a key's ids, times and values are held.
    """
    alpha = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows = pd.concat([b[["event_id", "ts", "value"]] for b in batches]).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"].to_numpy(dtype=float).tolist():
            if v == v:
                mean = v if mean is None else (1 - alpha) * mean + alpha * v
            out.append(mean)
        if mean is not None:
            state.update((float(mean),))
        yield pd.DataFrame({"event_type": key[0], "event_id": rows["event_id"].to_numpy(), "mean": pd.array(out, dtype="Float64")})

    narrow = events.select("event_type", "event_id", "ts", "value")
    return narrow.groupBy("event_type").applyInPandasWithState(step, "event_type string, event_id long, mean double", "mean double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Process all input there is. Complete results replace the table after each batch; appended ones are a folder for each batch, so that a replayed batch replaces its own rows."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    target = (lambda _: path) if mode == "complete" else (lambda batch: f"{path}/batch={batch}")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(target(batch))).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
