"""Token counts of whole texts: Arrow batches go through a public tokenizer, only lengths come back.

Inside a task, texts are dealt into batches of about ``batch_bytes`` bytes, however many rows of whatever size Arrow
delivers, and each batch is one call of the tokenizer. A text longer than a batch is cut at safe boundaries: between two characters
that stand side by side in no piece of the vocabulary, so that no merge can reach over the cut. Each part but
the first is encoded behind a guard, a character that no piece holds, and the guard's own tokens are subtracted;
the library's leading space mark therefore falls on the guard. The counts of a text's parts add up to the count
of the whole text. Where a long stretch has no safe boundary, it stays in one part.

No text is shuffled, and a task holds one Arrow batch and the ids of one tokenizer batch.

Defined results: null text is empty text, with 0 bytes and 0 tokens; strings that look like special tokens are
ordinary text, as in the library; repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import emit, slices

#: How sentencepiece writes a space inside pieces.
SPACE_MARK = "▁"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Counter:
    """A sentencepiece model with what cutting needs: adjacent characters of its pieces, and a guard."""

    processor: object
    adjacent: frozenset[str]
    guard: str
    guard_tokens: int

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text in parts of about ``size`` characters, cut where no piece reaches over; all but the first behind the guard."""
        start = 0
        while len(text) - start > size:
            cut = self._boundary(text, start + size)
            yield text[start:cut] if start == 0 else self.guard + text[start:cut]
            start = cut
        if start < len(text):
            yield text[start:] if start == 0 else self.guard + text[start:]

    def _boundary(self, text: str, at: int) -> int:
        while at < len(text) and text[at - 1 : at + 1].replace(" ", SPACE_MARK) in self.adjacent:
            at += 1
        return at

    def count(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(parts, num_threads=1)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    used = set("".join(pieces))
    guard = next(c for c in map(chr, [10, *range(0xE000, 0xF8FF)]) if c not in used)
    return Counter(processor, frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1)), guard, len(processor.encode(guard)))


def _count_batches(path: str, limit: int, batch_bytes: int):
    def run(batches):
        model = counter(path)

        def rows(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, sizes = b.column("text").to_pylist(), b.column("n_bytes").to_pylist()
            totals = [0] * len(texts)
            parts: list[str] = []
            owners: list[int] = []
            held = 0

            def flush():
                for k, n in zip(owners, model.count(parts)):
                    totals[k] += n
                parts.clear()
                owners.clear()

            for k, (text, size) in enumerate(zip(texts, sizes)):
                # a part has at most ``batch_bytes`` bytes, also where each character takes several
                step = batch_bytes * len(text) // size if size > batch_bytes else len(text)
                for i, part in enumerate(model.parts(text, max(1, step))):
                    weight = size * len(part) // len(text)
                    if parts and held + weight > batch_bytes:
                        flush()
                        held = 0
                    parts.append(part)
                    owners.append(k)
                    held += weight
                    totals[k] -= model.guard_tokens if i else 0
            if parts:
                flush()
            return emit(_COUNTS, [b.column("doc_id").to_pylist(), sizes, totals, [n > limit for n in totals]])

        for b in slices(batches, 512):
            yield rows(b)

    return run


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096, batch_bytes: int = 256 << 10) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return source.mapInArrow(_count_batches(model or default_model(), limit, batch_bytes), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
