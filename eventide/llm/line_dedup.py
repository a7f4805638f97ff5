"""Line deduplication over content-defined chunks, in DataFrame functions only.

Each line is hashed, a rolling hash over the last ``window`` line hashes decides where a chunk ends, so an
inserted line moves boundaries only near itself. Chunks of two or more lines that occur more than once
anywhere are compared byte by byte; of equal chunks the first stays, all others are removed. First is the smallest
by (identifier, SHA-256 of the whole text, row, position in the text).

Rows are cut into chunks once and stored under a row number, in a table bucketed by it: chunk texts are
shuffled by row once, and every later join of chunk texts by row finds them in place. Repeated chunks are found by
their digests alone; only the texts of chunks with a repeated digest are grouped by digest and text, which is the
byte comparison. Removals are keyed by row, never by identifier.

Defined results: null text is empty text; a document's own repeats are removed like any other; of rows that repeat
a whole document one stays and the others lose their chunks of two or more lines, also where rows share an identifier or have none (a null
identifier sorts first); a chunk found in one row is never removed from another row that lacks it; different chunks
with one digest all stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import fresh_path, materialise

#: Line hashes are 32 bits; the rolling hash is sum(h[i - j] * BASE^j) over the window, taken modulo the divisor.
BASE = 31


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _chunked(df: DataFrame, id_col: str, text_col: str, window: int, divisor: int) -> DataFrame:
    """row, doc_id, whole (SHA-256 of the text), bodies (chunk texts), digests (SHA-256 of chunks of two or more lines, else null)."""
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lined = base.withColumn("lines", F.split("text", "\n", -1))
    lined = lined.withColumn("hashes", F.transform("lines", _line_hash))

    def rolling(i: Column) -> Column:
        total = F.element_at("hashes", i)
        for j in range(1, window):
            total = total + F.when(i > j, F.element_at("hashes", F.greatest(i - j, F.lit(1)))).otherwise(F.lit(0)) * BASE**j
        return total

    ends = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (rolling(i) % divisor == 0) | (i == F.size("lines")))
    cut = lined.withColumn("ends", ends).withColumn("begins", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))))
    body = F.transform(F.arrays_zip("begins", "ends"), lambda z: F.array_join(F.slice("lines", z["begins"] + 1, z["ends"] - z["begins"]), "\n"))
    cut = cut.select("row", "doc_id", _sha("text").alias("whole"), body.alias("bodies"))
    return cut.withColumn("digests", F.transform("bodies", lambda b: F.when(F.contains(b, F.lit("\n")), F.unhex(F.sha2(b, 256)))))


def _sha(c: str) -> Column:
    return F.unhex(F.sha2(F.col(c), 256))


def _stored(chunked: DataFrame, buckets: int) -> DataFrame:
    """The chunk table, written once, bucketed by row: joins by row read it without a shuffle.

    Beyond the most buckets that a table may have, buckets grow; they are streamed, and only the positions asked for
    are held. The catalog knows the table just until its files are resolved.
    """
    spark = chunked.sparkSession
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"line_chunks_{uuid.uuid4().hex}"
    writer = chunked.repartition(buckets, "row").write.mode("overwrite").option("compression", "zstd").option("path", fresh_path(spark, "chunks"))
    writer.bucketBy(buckets, "row").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    return table


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 3, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, text (cleaned), n_chunks, removed_chunks, removed_chars."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunks = _stored(_chunked(df, id_col, text_col, window, divisor), max(1, -(-total // bucket_bytes)))

    places = chunks.select("row", "doc_id", "whole", F.posexplode("digests").alias("pos", "digest")).where(F.col("digest").isNotNull())
    repeated = materialise(places.groupBy(F.col("digest").alias("r_digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r_digest"), "repeated")
    suspects = materialise(places.join(repeated, F.col("digest") == F.col("r_digest")).select("row", "doc_id", "whole", "pos", "digest"), "suspects")

    # byte comparison: only chunks with a repeated digest, grouped by digest and whole text
    asked = suspects.groupBy(F.col("row").alias("a_row")).agg(F.collect_set("pos").alias("at"))
    found = chunks.join(asked.hint("shuffle_hash"), F.col("row") == F.col("a_row"))
    found = found.select("row", "doc_id", "whole", F.explode(F.transform("at", lambda p: F.struct(p.alias("pos"), F.get("digests", p).alias("digest"), F.get("bodies", p).alias("body")))).alias("c")).select("row", "doc_id", "whole", "c.*")
    first = F.min(F.struct("doc_id", "whole", "row", "pos"))
    equal = found.groupBy("digest", "body").agg(first.alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = equal.groupBy(F.col("digest").alias("e_digest")).agg(F.count(F.lit(1)).alias("texts"), F.min("owner").alias("owner"), F.min("n").alias("n")).where("texts = 1 AND n > 1")
    owners = materialise(owners.select("e_digest", "owner.row", "owner.pos").toDF("e_digest", "o_row", "o_pos"), "owners")

    copies = suspects.join(owners, (F.col("digest") == F.col("e_digest")) & ((F.col("row") != F.col("o_row")) | (F.col("pos") != F.col("o_pos"))))
    gone = materialise(copies.groupBy(F.col("row").alias("g_row")).agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone")
    cleaned = chunks.select("row", "doc_id", "bodies").join(gone.hint("shuffle_hash"), F.col("row") == F.col("g_row"), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    none = F.array(F.lit(-1))
    gaps = F.arrays_zip(F.concat(none, "gone").alias("a"), F.concat("gone", F.array(F.size("bodies"))).alias("z"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("bodies", g["a"] + 2, g["z"] - g["a"] - 1)))  # what lies between positions that go
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, b: n + F.length(b))
    out = cleaned.select("doc_id", "bodies", "gone", kept.alias("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("text"), F.size("bodies").cast("long").alias("n_chunks"), F.size("gone").cast("long").alias("removed_chunks"), (chars(F.col("bodies")) - chars(F.col("kept"))).alias("removed_chars"))


def _oracle(window: int = 2, divisor: int = 3) -> str:
    terms = " + ".join(f"(CASE WHEN i > {j} THEN h[i - {j}] ELSE 0 END) * {BASE**j}" for j in range(window))
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, sha256(coalesce(text, '')) AS whole, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    h AS (SELECT doc_id, r, whole, l, list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM d),
    e AS (SELECT doc_id, r, whole, l, list_filter(range(1, len(l) + 1), lambda i: ({terms}) % {divisor} = 0 OR i = len(l)) AS ends FROM h),
    c AS (SELECT doc_id, r, whole, len(ends) AS n_chunks, unnest(range(1, len(ends) + 1)) AS k, l, ends FROM e),
    b AS (SELECT doc_id, r, whole, n_chunks, k, ends[k] - (CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END) AS n_lines,
                 array_to_string(l[(CASE WHEN k > 1 THEN ends[k - 1] ELSE 0 END) + 1 : ends[k]], chr(10)) AS body FROM c),
    q AS (SELECT *, row_number() OVER (PARTITION BY n_lines > 1, body ORDER BY doc_id NULLS FIRST, whole, r, k) AS nth FROM b),
    g AS (SELECT doc_id, r, n_chunks, k, body, n_lines > 1 AND nth > 1 AS gone FROM q)
    SELECT any_value(doc_id) AS doc_id, sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256, any_value(n_chunks) AS n_chunks,
           count(*) FILTER (gone) AS removed_chunks, CAST(coalesce(sum(length(body)) FILTER (gone), 0) AS BIGINT) AS removed_chars
    FROM g GROUP BY r"""


ORACLE = _oracle()
