"""Chat formatting by event-sourced reconstruction.

A conversation log is a stream of events. Logs are partitioned by conversation and message, sorted by sequence,
and folded message by message: streamed deltas append, edits replace, a regeneration discards what was
streamed so far, a deletion removes the message. The final messages are rendered with turn marks, and the
rendered text carries a loss mask over assistant texts.

Event kinds: ``message`` (a whole message), ``open`` (starts one), ``delta`` (appends), ``edit`` (replaces),
``regenerate`` (empties), ``delete``. No event of one message changes another, so the messages of a conversation that
holds a third of all rows are folded and rendered by many tasks. Folding is streaming: a task holds one message at a
time. Only the digests of ``read_back`` run over a whole conversation, and are sequential: for them one
task reads it from start to end, without keeping it.

Control strings inside texts are escaped with backslashes after their first character, one more than were
there, so that escaping is reversible and no control string of this or other common templates survives raw.

Defined results: null text and null role are empty; events of one message with equal sequence go by kind,
role and text; rows that repeat a whole ``message`` are separate turns, in order of ``ordinal``; a null conversation is one
conversation; a null message number comes first; an empty log gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import buffered

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Control strings of common chat templates, all escaped inside texts.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_EVENTS_DDL = "conv_id long, message long, seq long, kind string, role string, text string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("ordinal", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
TURNS_DDL = "conv_id long, message long, ordinal long, formatted string, loss_start long, loss_end long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _guard(extra: str) -> re.Pattern:
    by_first: dict[str, list[str]] = {}
    for c in CONTROL:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return re.compile("|".join(f"(?<={re.escape(a)}){extra}(\\\\*)(?={'|'.join(rest)})" for a, rest in by_first.items()))


_ESCAPE, _UNESCAPE = _guard(""), _guard(r"\\")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][1:], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text in code points)."""
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    head, body = f"{OPEN}{name}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) read back from one formatted turn."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    role = re.sub(r"\\(.)", lambda e: "\n" if e[1] == "n" else e[1], unescape(m[1]))
    return role, unescape(m[2])


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, message, role, text) of final messages from events sorted by (conv, message, seq)."""
    key, role, parts, alive = None, "", [], False
    for conv, message, _, kind, who, text in events:
        here = (conv, message)
        if kind == "message" or here != key:
            if alive:
                yield *key, role, "".join(parts)
            key, role, parts, alive = here, who or "", [], True
        if who:
            role = who
        if kind in ("message", "delta"):
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind in ("open", "regenerate"):
            parts = [text or ""]
        elif kind == "delete":
            alive = False
        else:
            raise ValueError(f"unknown event kind {kind!r}")
    if alive:
        yield *key, role, "".join(parts)


def _fold_batches(loss_roles: tuple[str, ...]):
    def run(batches):
        def events():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def rows():
            last, ordinal = None, 0
            for conv, message, role, text in fold(events()):
                ordinal = ordinal + 1 if (conv, message) == last else 0
                last = conv, message
                formatted, start, end = render_turn(role, text)
                learn = role in loss_roles
                yield conv, message, ordinal, formatted, start if learn else None, end if learn else None

        yield from buffered(rows(), _TURNS)

    return run


def message_events(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Event log of a table of whole messages."""
    return df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("message"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows of formatted turns: conv_id, message, ordinal, formatted, loss_start, loss_end (code points within the turn).

    A conversation's text is its turns' ``formatted`` joined in order of (message, ordinal).
    """
    order = ["conv_id", "message", "seq", "kind", "role", "text"]
    dealt = events.select(*order).repartition("conv_id", "message").sortWithinPartitions(*order)
    return dealt.mapInArrow(_fold_batches(loss_roles), TURNS_DDL)


def _digest_batches(batches):
    def rows():
        state = None
        for b in batches:
            for conv, _, _, formatted, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield _closed(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    learned = unescape(formatted[start:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
        if state is not None:
            yield _closed(state)

    yield from buffered(rows(), _DIGESTS)


def _closed(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]


def read_back(turns: DataFrame) -> DataFrame:
    """Digests per conversation, parsed out of the formatted text and its loss mask alone."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "message", "ordinal").mapInArrow(_digest_batches, DIGESTS_DDL)
