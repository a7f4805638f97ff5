"""BPE encoding and decoding through a distinct-word table.

Documents are dealt into blocks of about ``block_bytes`` of text by a hash of their row number. Each block
lists its distinct words (the vocabulary's own pre-tokenisation); the lists are dealt again by a hash of
the word, where every distinct word of the corpus is encoded exactly once; the ids travel back to the blocks
that asked and are joined to each document's words by position.

Decoding joins every document's own id stream with the vocabulary's table of ids and pieces, by id, a batch of documents
at a time, and cuts the joined pieces by document. The vocabulary alone is held by every task, and its size is fixed.

Texts travel once, compressed. Word lists travel packed, one row for each (block, word bucket), so a word
that every document holds costs one entry per block. A task holds one block and its words, or the distinct words
of a few buckets; the numbers of blocks and buckets grow with the corpus, and blocks are even whatever the identifiers are.

Defined results: null text is empty text with no ids; repeated rows are separate rows; special token
strings in a text become their id, as the library does; an id that the vocabulary lacks is an error, a null id or list
is none; bytes that are no UTF-8 decode to U+FFFD, as in the library; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import buffered, emit, slices
from eventide.llm.bpe import _UNUSUAL, default_vocabulary, fast_encoding, id_to_piece, library_tokenizer, special_tokens

#: Fixed value: the split pattern of the byte-level vocabularies.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_DEALT = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary()), ("block", pa.int64())])
_WORDS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary())])
_IDS = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def _splitter(path: str):
    import public_tokenizers

    special = sorted(special_tokens(path), key=len, reverse=True)
    return ordinary_words(public_tokenizers.PATTERN), regex.compile("|".join(map(regex.escape, special))) if special else None


def ordinary_words(pattern: str):
    """The split pattern for texts of ordinary characters only, where its classes are short lists the ``re`` module scans fast."""
    letter, number, space = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r "
    if pattern != _KNOWN:
        return regex.compile(pattern)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def split_words(text: str, path: str) -> list[str]:
    """The vocabulary's words of a text, special tokens included; joined they give the text."""
    words, special = _splitter(path)
    if special is None or not special.search(text):
        return _plain(text, path, words)
    out, at = [], 0
    for m in special.finditer(text):
        out += _plain(text[at : m.start()], path, words)
        out.append(m[0])
        at = m.end()
    return out + _plain(text[at:], path, words)


def _plain(text: str, path: str, words) -> list[str]:
    if _UNUSUAL.search(text):
        return [text[a:b] for _, (a, b) in library_tokenizer(path).pre_tokenizer.pre_tokenize_str(text)] if text else []
    return words.findall(text)


def encode_words(words: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each word."""
    fast = fast_encoding(path)
    tok = library_tokenizer(path)
    special = special_tokens(path)
    out = []
    for w in words:
        if w in special:
            ids = [special[w]]
        elif _UNUSUAL.search(w):
            ids = tok.encode(w, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(w)
        out.append(np.array(ids, dtype="<u4").tobytes())
    return out


def _pack(parts: list[bytes]) -> bytes:
    import zstandard

    sizes = np.array([len(p) for p in parts], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(parts).to_bytes(4, "little") + sizes + b"".join(parts))


def _unpack(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4)).tolist()
    at, base, out = 0, 4 + 4 * n, []
    for end in ends:
        out.append(raw[base + at : base + end])
        at = end
    return out


def _deal(batches):
    import zstandard

    def rows():
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            for ident, text, block in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("block").to_pylist()):
                yield ident, squeeze.compress((text or "").encode("utf-8", "surrogatepass")), block

    yield from buffered(rows(), _DEALT)


def _text(packed: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def _list_words(path: str, buckets: int):
    """Block side: distinct words of each block, one packed row for each bucket."""

    def run(batches):
        def rows() -> Iterator[tuple]:
            seen: dict[int, set[str]] = {}
            for b in batches:
                for packed, block in zip(b.column("packed"), b.column("block").to_pylist()):
                    seen.setdefault(block, set()).update(split_words(_text(packed.as_py()), path))
            for block, words in seen.items():
                by: dict[int, list[bytes]] = {}
                for w in words:
                    raw = w.encode("utf-8", "surrogatepass")
                    by.setdefault(zlib.crc32(raw) % buckets, []).append(raw)
                words.clear()
                for bucket, raws in by.items():
                    raws.sort()
                    yield bucket, block, _pack(raws)

        yield from buffered(rows(), _WORDS)

    return run


def _encode_buckets(path: str):
    """Word side: the distinct-word table; each word is encoded when first seen, and never again."""

    def run(batches):
        def rows():
            table: dict[bytes, bytes] = {}
            for b in batches:
                for block, packed in zip(b.column("block").to_pylist(), b.column("words")):
                    data = packed.as_py()
                    words = _unpack(data)
                    fresh = [w for w in words if w not in table]
                    table.update(zip(fresh, encode_words([w.decode("utf-8", "surrogatepass") for w in fresh], path)))
                    yield block, data, _pack([table[w] for w in words])

        yield from buffered(rows(), _IDS, size=256)

    return run


def _join_by_position(path: str):
    """One block: each document's words become the ids of those words, in place."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.RecordBatch:
        idents = docs.column("doc_id").to_pylist()
        if not idents:
            return emit(_ENCODED, [[], []])
        place: dict[str, int] = {}
        parts: list[bytes] = []
        for words, ids in zip(lists.column("words"), lists.column("ids")):
            for raw in _unpack(words.as_py()):
                place[raw.decode("utf-8", "surrogatepass")] = len(place)
            parts += _unpack(ids.as_py())
        flat = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32)
        count = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        begin = np.cumsum(count) - count
        out, ends = [], [0]
        for packed in docs.column("packed"):
            words = split_words(_text(packed.as_py()), path)
            at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
            times = count[at]
            total = int(times.sum())
            out.append(flat[np.repeat(begin[at] - np.cumsum(times) + times, times) + np.arange(total)])
            ends.append(ends[-1] + total)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(idents, pa.int64()), ids], schema=_ENCODED)

    return run


def _encoded_blocks(df: DataFrame, id_col: str, text_col: str, path: str, block_bytes: int, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    """Blocks of (doc_id, ids), each passed through ``finish`` where it is made."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), block.alias("block"))
    # both readers of ``dealt`` share one exchange: texts are shuffled once
    dealt = source.mapInArrow(_deal, "doc_id long, packed binary, block long").repartition(blocks, "block")
    words = dealt.mapInArrow(_list_words(path, blocks), "bucket long, block long, words binary").repartition(blocks, "bucket")
    ids = words.mapInArrow(_encode_buckets(path), "block long, words binary, ids binary").repartition(blocks, "block")
    join = _join_by_position(path)

    def block_rows(docs: pa.Table, lists: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(finish(iter([join(docs, lists)]))), schema=schema)

    return dealt.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(block_rows, ddl)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, ids."""
    return _encoded_blocks(df, id_col, text_col, vocabulary or default_vocabulary(), block_bytes, lambda blocks: blocks, _ENCODED, "doc_id long, ids array<int>")


def round_trip_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """Encode, then decode the ids: one row per input row, doc_id, n_tokens, ids_sha256, decoded_sha256. Ids never leave their block."""
    path = vocabulary or default_vocabulary()
    return _encoded_blocks(df, id_col, text_col, path, block_bytes, _digest_batches(path), _DIGEST, DIGEST_DDL)


# ---- decoding --------------------------------------------------------------------------------------


class PieceTable:
    """The vocabulary's ids and pieces, to be joined with streams of ids; ``listing`` writes ids as text the same way."""

    def __init__(self, path: str) -> None:
        rows = id_to_piece(path)
        self.ids = pa.array([i for i, _ in rows], pa.int32())
        self.pieces = pa.array([p for _, p in rows], pa.large_binary())
        self.numbers = pa.array([f",{i}".encode() for i, _ in rows], pa.large_binary())

    def rows_of(self, stream: pa.Array) -> pa.Array:
        """The table's row for each id of a stream: the join by id."""
        at = pc.index_in(stream, value_set=self.ids)
        if at.null_count:
            raise ValueError("an id that the vocabulary lacks")
        return at


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def _joined(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of binary values one after the other."""
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, dtype=np.int64)[: len(values) + 1], memoryview(data) if data is not None else memoryview(b"")


def _streams(batches, ids_col: str = "ids") -> Iterator[tuple[list, pa.Array, np.ndarray]]:
    """(doc_ids, ids of all rows one after the other without nulls, first id of each row and the end)."""
    for b in slices(batches):
        lists = pc.fill_null(b.column(ids_col), [])
        flat = lists.flatten()
        ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        if flat.null_count:
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(known)][ends]
            flat = flat.drop_null()
        yield b.column("doc_id").to_pylist(), flat, ends


def _valid(data: memoryview) -> bytes | memoryview:
    try:
        str(data, "utf-8")
    except UnicodeDecodeError:
        return bytes(data).decode("utf-8", "replace").encode()
    return data


def _decode_batches(path: str):
    def run(batches):
        table = piece_table(path)

        def rows():
            for idents, stream, ends in _streams(batches):
                offsets, data = _joined(table.pieces.take(table.rows_of(stream)))
                for ident, a, z in zip(idents, offsets[ends[:-1]].tolist(), offsets[ends[1:]].tolist()):
                    yield ident, bytes(data[a:z]).decode("utf-8", "replace")

        yield from buffered(rows(), _DECODED, size=256)

    return run


def _digest_batches(path: str):
    def run(batches):
        table = piece_table(path)

        def rows():
            for idents, stream, ends in _streams(batches):
                at = table.rows_of(stream)
                offsets, data = _joined(table.pieces.take(at))
                number_offsets, numbers = _joined(table.numbers.take(at))
                for k, ident in enumerate(idents):
                    a, z = ends[k], ends[k + 1]
                    listed = numbers[number_offsets[a] : number_offsets[z]][1:]
                    decoded = _valid(data[offsets[a] : offsets[z]])
                    yield ident, int(z - a), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

        yield from buffered(rows(), _DIGEST, size=2048)

    return run


def _id_rows(ids: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))


def decode_documents(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, decoded."""
    return _id_rows(ids, id_col, ids_col).mapInArrow(_decode_batches(vocabulary or default_vocabulary()), "doc_id long, decoded string")


def round_trip_digests(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, of the id stream and of what it decodes to."""
    return _id_rows(ids, id_col, ids_col).mapInArrow(_digest_batches(vocabulary or default_vocabulary()), DIGEST_DDL)
