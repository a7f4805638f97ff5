"""Shared plumbing: tables in the shared folder, one row for each owner, Arrow batches.

Nothing here knows about an operator. ``materialise`` is the only way lineage is cut in this
subpackage: it writes Parquet into the folder named by ``spark.checkpoint.dir`` (shared by the driver
and all executors), so a lost executor never loses an intermediate result. A table is deleted by ``discard``
after its last reader, or when the application ends, since results are lazy and may read it until then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.session import shared_dir


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    files, at = _hadoop_path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back under the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["materialised_at"] = path
    return out


def discard(*tables: DataFrame) -> int:
    """Delete materialised tables that nothing reads any more; returns how many there were."""
    done = 0
    for t in tables:
        path = t.__dict__.pop("materialised_at", None)
        if path:
            files, at = _hadoop_path(t.sparkSession, path)
            done += bool(files.delete(at, True))
    return done


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return isinstance(kind, T.AtomicType) and type(kind).__name__ != "VariantType"


def keep_owners(df: DataFrame, keys: list[Column], owners: DataFrame) -> DataFrame:
    """Rows of ``df``, columns as they came, whose ``keys`` equal an owner's: exactly one row for each owner.

    ``owners`` has one column for each key, in order, and ``rows``, the number of rows of ``df`` that match. Texts are
    shuffled once for owners of one row; only where several rows match (repeated identifiers) are they grouped, and
    the smallest by all columns stays.
    """
    names = [f"__owner_key_{i}" for i in range(len(keys))]
    marked = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    held = [f"__held_{i}" for i in range(len(keys))]
    owners = owners.toDF(*held, "rows")
    match = [marked[n].eqNullSafe(owners[h]) for n, h in zip(names, held)]
    sole = marked.join(owners.where("rows = 1"), match, "left_semi").drop(*names)
    shared = owners.where("rows > 1")
    if shared.isEmpty():
        return sole
    whole = F.struct(*[df[c] for c in df.columns])
    order = F.struct(*[F.col(f.name) if _orderable(f.dataType) else F.to_json(F.struct(f.name)) for f in df.schema])
    tied = marked.join(shared, match, "left_semi").select(*names, whole.alias("__row"), order.alias("__order"))
    return sole.unionAll(tied.groupBy(*names).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Views of at most ``rows`` rows, so that only so many texts exist as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def emit(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    """A record batch of ``schema`` from one Python list per field."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def buffered(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Group row tuples into record batches of at most ``size`` rows and about ``max_bytes`` of payload."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= size or weight >= max_bytes:
            yield emit(schema, list(map(list, zip(*held))))
            held, weight = [], 0
    if held:
        yield emit(schema, list(map(list, zip(*held))))
