"""Exact deduplication with compressed radix tries (Patricia tries) as owners of texts.

Texts are equal when their normalised bytes are equal. Documents are dealt by (byte length, content
hash); each partition inserts whole byte strings into a compressed radix trie, so texts with a common beginning
share its path, and terminal nodes hold the smallest identifier and the numbers of rows. Copies are collapsed by
the same trie inside each map task first, so a text that fills a third of the corpus reaches its owner as at most
a few rows per task.

Bounded memory: once a trie holds ``budget`` bytes, subtrees spill and are freed. A map task's trie spills its
heaviest branches as partial counts, which the owner merges. An owner reads its texts in byte order, so every
subtree left of the last text's path is finished: its terminals go to the output and only the path stays.

A text's owner is joined back to its rows by length, SHA-256 and a second hash (XXH64), so two texts that
collided in SHA-256 would still be two groups.

Defined results: null text counts as empty; all empty texts are one group; a null identifier never wins over
another, and a group without any identifier has a null owner; all rows with the owner's identifier are marked as
kept by ``exact_dedup``, and exactly one of them, the smallest by all columns, is left by ``keep_first``, so no text is
lost; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import buffered, keep_owners, materialise, slices

#: Only what changes is matched: a run that is not already one single space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

_PARTIAL = pa.schema([("text", pa.binary()), ("digest", pa.binary()), ("second", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("owner_rows", pa.int64())])
_PARTIAL_DDL = "text binary, digest binary, second long, keep_id long, group_size long, owner_rows long"
_OWNERS = pa.schema([("n_bytes", pa.int64()), *[f for f in _PARTIAL if f.name != "text"]])
_OWNERS_DDL = "n_bytes long, digest binary, second long, keep_id long, group_size long, owner_rows long"


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving: whole slices are compared, never single bytes in a loop."""
    lo, hi = 0, min(len(a), len(b))
    a, b = memoryview(a), memoryview(b)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings. A node is [label, children by first byte, terminal].

    A terminal is (smallest id, rows, rows with that id, digest, second hash).
    """

    __slots__ = ("root", "size", "last")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0
        self.last = b""

    def insert(self, key: bytes, value: tuple) -> None:
        self.last = key
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = _merged(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.size += len(key) - at + 400
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            common = _common(label, key[at : at + len(label)])
            upper = [label[:common], {label[common]: child}, None]
            child[0] = label[common:]
            node[1][key[at]] = upper
            self.size += 300
            node, at = upper, at + common

    def terminals(self) -> Iterator[tuple[bytes, tuple]]:
        """(whole key, value) of every terminal, in key order."""
        yield from _below(self.root, b"")

    def spill_heaviest(self, keep: int) -> Iterator[tuple[bytes, tuple]]:
        """Terminals of the root's heaviest branches, which are freed, until at most ``keep`` bytes are held."""
        weights = sorted(((_weight(child), first) for first, child in self.root[1].items()), reverse=True)
        for weight, first in weights:
            if self.size <= keep:
                return
            yield from _below(self.root[1].pop(first), b"")
            self.size -= weight

    def spill_finished(self) -> Iterator[tuple[bytes, tuple]]:
        """Terminals of all subtrees left of the last key's path, which are freed. Keys must come in order."""
        node, at, key = self.root, 0, self.last
        while at < len(key):
            ahead = key[at]
            for first in sorted(c for c in node[1] if c < ahead):
                child = node[1].pop(first)
                self.size -= _weight(child)
                yield from _below(child, key[:at])
            node = node[1][ahead]
            at += len(node[0])


def _below(top: list, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
    stack = [(top, prefix)]
    while stack:
        node, prefix = stack.pop()
        prefix += node[0]
        if node[2] is not None:
            yield prefix, node[2]
        stack.extend((node[1][c], prefix) for c in sorted(node[1], reverse=True))


def _weight(top: list) -> int:
    total, stack = 0, [top]
    while stack:
        node = stack.pop()
        total += len(node[0]) + (400 if node[2] is not None else 300)
        stack.extend(node[1].values())
    return total


def _merged(old: tuple | None, new: tuple) -> tuple:
    if old is None:
        return new
    a, b = old[0], new[0]
    if a == b:
        return a, old[1] + new[1], old[2] + new[2], *new[3:]
    first = old if b is None or (a is not None and a < b) else new
    return first[0], old[1] + new[1], first[2], *new[3:]


def normalised(text: Column) -> Column:
    """Each run of space, tab, newline, vertical tab, form feed or carriage return as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).cast("binary").alias("text"))
    return base.select("doc_id", "text", _digest(F.col("text")).alias("digest"), F.xxhash64("text").alias("second"))


def collapse_task(budget: int):
    """Map side: one row per distinct text, or a few where the task's distinct texts exceed ``budget`` bytes."""

    def run(batches):
        def rows():
            trie = PatriciaTrie()
            for b in slices(batches):
                for ident, text, digest, second in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "digest", "second"))):
                    trie.insert(text, (ident, 1, 1, digest, second))
                    if trie.size > budget:
                        yield from map(_partial, trie.spill_heaviest(budget // 2))
            yield from map(_partial, trie.terminals())

        yield from buffered(rows(), _PARTIAL)

    return run


def _partial(found: tuple[bytes, tuple]) -> tuple:
    text, (ident, rows, owner_rows, digest, second) = found
    return text, digest, second, ident, rows, owner_rows


def own_partition(budget: int):
    """Owner side: a trie over texts in byte order; finished subtrees are spilled to the output."""

    def run(batches):
        def rows():
            trie = PatriciaTrie()
            for b in slices(batches):
                for text, digest, second, ident, count, owner_rows in zip(*(b.column(c).to_pylist() for c in _PARTIAL.names)):
                    trie.insert(text, (ident, count, owner_rows, digest, second))
                    if trie.size > budget:
                        yield from map(_owner, trie.spill_finished())
            yield from map(_owner, trie.terminals())

        yield from buffered(rows(), _OWNERS)

    return run


def _owner(found: tuple[bytes, tuple]) -> tuple:
    text, (ident, rows, owner_rows, digest, second) = found
    return len(text), digest, second, ident, rows, owner_rows


def text_owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per distinct normalised text: n_bytes, digest (SHA-256), second (XXH64), keep_id, group_size, owner_rows."""
    partial = _keyed(df, id_col, text_col).mapInArrow(collapse_task(budget), _PARTIAL_DDL)
    dealt = partial.withColumn("n_bytes", F.octet_length("text")).repartition("n_bytes", "digest").drop("n_bytes").sortWithinPartitions("text")
    return dealt.mapInArrow(own_partition(budget), _OWNERS_DDL)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The join back carries identifiers and digests only; both sides are plain scans, so adaptive execution
    can split the partition of a hot digest.
    """
    owners = materialise(text_owners(df, id_col, text_col, budget).toDF("o_bytes", "o_digest", "o_second", "keep_id", "group_size", "owner_rows"), "owners")
    rows = _keyed(df, id_col, text_col).select("doc_id", "digest", "second", F.octet_length("text").cast("long").alias("n_bytes"))
    joined = rows.join(owners, (F.col("digest") == F.col("o_digest")) & (F.col("n_bytes") == F.col("o_bytes")) & (F.col("second") == F.col("o_second")))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """Of each group of equal texts one row, columns as they came: that with the smallest identifier, then the smallest by all columns."""
    owners = materialise(text_owners(df, id_col, text_col, budget).select("keep_id", "digest", "second", "owner_rows"), "owners")
    text = normalised(df[text_col]).cast("binary")
    return keep_owners(df, [df[id_col].cast("long"), _digest(text), F.xxhash64(text)], owners)
