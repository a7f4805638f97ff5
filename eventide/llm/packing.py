"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised once; ids beyond whole sequences form a last, shorter piece. The histogram of
piece lengths has at most ``max_len`` entries whatever the corpus holds, so the packing itself runs on the
driver over counts only: lengths are placed longest first, each into the open packing pattern with the
most room, and the pattern counts are updated. The patterns become intervals of ranks per length, and
pieces find their sequence and offset by joining (length, rank) to those intervals.

Ranks are dealt without a global sort: pieces are stored under a row number and numbered inside (length, bucket), buckets are
a hash of the row number, and bucket counts give each bucket its first rank, so a length that a third of
all pieces share is still numbered by many tasks, whatever their identifiers. Full pieces are sequences of their own.

Defined results: null text is empty text (its single id is the end id); repeated rows, and rows without identifier, are
separate documents told apart by their own pieces; which of several pieces of one length lies in which sequence follows
the order of rows as they were read; an empty table packs into no sequence; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.base import buffered, materialise
from eventide.llm.bpe import default_vocabulary, encode_texts

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SLOTS_DDL = "s_length long, first_rank long, slots long, repeat long, first_sequence long, first_offset long"


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, copies), ...] with their counts; every length of the histogram is placed.

    ``room[r]`` holds the open patterns with r ids to spare. A length takes the pattern with the most room,
    and opens a new one, filled with as many copies as fit, only where none has room for it.
    """
    room: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(max_len + 1)]
    for length in sorted(histogram, reverse=True):
        left, top = histogram[length], max_len
        while left:
            while top >= length and not room[top]:
                top -= 1
            if top < length:
                each = max_len // length
                whole, rest = divmod(left, each)
                for copies, count in ((each, whole), (rest, 1)):
                    if copies and count:
                        room[max_len - copies * length].append((((length, copies),), count))
                left = 0
                continue
            pattern, count = room[top].pop()
            taken = min(count, left)
            if count > taken:
                room[top].append((pattern, count - taken))
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            room[top - length].append((grown, taken))
            left -= taken
    return [(list(p), c) for open_patterns in room for p, c in open_patterns]


def _slot_rows(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple]:
    """Intervals of ranks: within one, rank r sits in sequence first + r % repeat, copy r // repeat."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, copies in pattern:
            first = next_rank.get(length, 0)
            rows.append((length, first, copies * count, count, sequence, offset))
            next_rank[length] = first + copies * count
            offset += copies * length
        sequence += count
    return rows


def tokenise(max_len: int, path: str, end_id: int):
    def run(batches):
        def rows():
            for b in batches:
                idents = b.column("doc_id").to_pylist()
                texts = b.column("text")
                for at in range(0, len(idents), 64):
                    part = texts.slice(at, 64).to_pylist()
                    for ident, ids in zip(idents[at : at + 64], encode_texts(part, path)):
                        raw = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                        n = len(raw) // 4
                        for start in range(0, n, max_len):
                            stop = min(n, start + max_len)
                            yield ident, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), n

        yield from buffered(rows(), _PIECES)

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, end_id: int = 1, vocabulary: str | None = None, buckets: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or default_vocabulary()
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = materialise(source.mapInArrow(tokenise(max_len, path, end_id), _PIECES_DDL).withColumn("row", F.monotonically_increasing_id()), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))

    histogram = {length: n for length, n in pieces.groupBy("length").count().collect()}  # at most max_len rows
    slots = _slot_rows(shortest_pack_first(histogram, max_len))
    slot = F.broadcast(df.sparkSession.createDataFrame(slots, _SLOTS_DDL))  # bounded: patterns over at most max_len lengths

    # first rank of each bucket: offsets of runs of buckets, then offsets inside a run, so no task sums a whole length
    run = math.isqrt(buckets)
    sizes = pieces.groupBy("length", "bucket").count().withColumn("run", F.floor(F.col("bucket") / run))
    runs = sizes.groupBy(F.col("length").alias("r_length"), F.col("run").alias("r_run")).agg(F.sum("count").alias("c"))
    runs = runs.withColumn("r_first", F.sum("c").over(Window.partitionBy("r_length").orderBy("r_run")) - F.col("c"))
    inside = sizes.withColumn("i_first", F.sum("count").over(Window.partitionBy("length", "run").orderBy("bucket")) - F.col("count"))
    both = inside.join(runs, (F.col("length") == F.col("r_length")) & (F.col("run") == F.col("r_run")))
    firsts = both.select(F.col("length").alias("f_length"), F.col("bucket").alias("f_bucket"), (F.col("r_first") + F.col("i_first")).alias("f_first"))
    inner = Window.partitionBy("length", "bucket").orderBy("row")
    numbered = pieces.withColumn("within", (F.row_number().over(inner) - 1).cast("long"))
    ranked = numbered.join(firsts, (F.col("length") == F.col("f_length")) & (F.col("bucket") == F.col("f_bucket"))).withColumn("rank", F.col("f_first") + F.col("within"))
    placed = ranked.join(slot, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("slots")))
    turn = F.col("rank") - F.col("first_rank")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + turn % F.col("repeat")).alias("sequence_id"), (F.col("first_offset") + F.floor(turn / F.col("repeat")) * F.col("length")).cast("long").alias("offset"))
