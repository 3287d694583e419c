"""Chat formatting with a grammar round trip.

A turn is rendered as ``open text close``; a conversation is its turns in order, nothing between.

    user       ``[INST] text [/INST]``        assistant  ``<s> text </s>``
    system     ``<<SYS>> text <</SYS>>``      any other  ``<|role: name |> text <|/role|>``

The grammar is deterministic: a control string with no backslash before it is a mark, a control
string after backslashes belongs to the text and stands for itself with one backslash less. A turn
is first rendered as it is, parsed, and compared with its source; only where they differ is the
conflicting content escaped, and the result is parsed and compared again until it is identical.

Turns are rendered and verified row by row. Only the digest of a conversation needs its turns in
order: the formatted pieces are placed by conversation and sorted, and read as a stream with
constant memory, so a conversation that holds a third of all rows is never gathered.

Null text counts as empty, a null role as the empty role, null turns come first; rows that tie in
(conversation, turn) are ordered by role and text; repeated rows are turns of their own; a null
conversation id is one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template.
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
    "system": ("<<SYS>> ", " <</SYS>>"),
}
OTHER_OPEN, OTHER_NAME_END, OTHER_CLOSE = "<|role: ", " |> ", " <|/role|>"

_CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role:", "|>", "<|/role|>")
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, sorted(_CONTROLS, key=len, reverse=True))) + ")")
_OPEN = {start.strip(): (role, start, end) for role, (start, end) in MARKS.items()}


class GrammarError(ValueError):
    """The text is no sequence of turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][:-1] + m[2] if m[1] else m[0], text)


def _marks(text: str, start: int) -> Iterator[re.Match]:
    return (m for m in _CONTROL.finditer(text, start) if not m[1])


def _next_mark(text: str, start: int) -> re.Match:
    mark = next(_marks(text, start), None)
    if mark is None:
        raise GrammarError("a turn does not end")
    return mark


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first, end) of every turn; text is unescaped, the span is that of the escaped text."""
    turns, at = [], 0
    while at < len(text):
        mark = _next_mark(text, at)
        if mark.start() != at:
            raise GrammarError("text between turns")
        if mark[2] == OTHER_OPEN.strip():
            name_at = at + len(OTHER_OPEN)
            name_end = _next_mark(text, name_at).start() - 1
            role = unescape(text[name_at:name_end])
            first, close = name_end + len(OTHER_NAME_END), OTHER_CLOSE
            opened = text.startswith(OTHER_OPEN, at) and name_end >= name_at and text.startswith(OTHER_NAME_END, name_end)
        elif mark[2] in _OPEN:
            role, start, close = _OPEN[mark[2]]
            first = at + len(start)
            opened = text.startswith(start, at)
        else:
            raise GrammarError("a turn does not begin with an opening mark")
        end_mark = _next_mark(text, first)
        end = end_mark.start() - 1
        if not opened or end < first or not text.startswith(close, end):
            raise GrammarError("marks of different turns")
        turns.append((role, unescape(text[first:end]), first, end))
        at = end + len(close)
    return turns


def _render(role: str, shown_role: str, shown_text: str) -> str:
    if role in MARKS:
        start, end = MARKS[role]
        return f"{start}{shown_text}{end}"
    return f"{OTHER_OPEN}{shown_role}{OTHER_NAME_END}{shown_text}{OTHER_CLOSE}"


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except GrammarError:
        return False


def render_turn(role: str | None, text: str | None) -> str:
    """Rendered turn that parses to exactly this role and text."""
    role, text = role or "", text or ""
    for shown_role, shown_text in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        rendered = _render(role, shown_role, shown_text)
        if _reads_back(rendered, role, text):
            return rendered
    raise GrammarError(f"no escape makes the turn readable: {rendered[:200]!r}")


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        pieces = [render_turn(r, t) for r, t in zip(roles, texts)]
        spans = [parse(p)[0][2:] for p in pieces]
        assistant = [r == "assistant" for r in roles]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                batch.column("role"),
                pa.array(pieces, pa.string()),
                pa.array([s for s, _ in spans], pa.int64()),
                pa.array([e for _, e in spans], pa.int64()),
                pa.array(assistant, pa.bool_()),
            ],
            names=["conv_id", "turn", "role", "formatted", "text_start", "text_end", "loss"],
        )


def format_turns(rows: DataFrame) -> DataFrame:
    """Every turn rendered: formatted text, span of the escaped text in it, and the loss mask.

    The conversation is the concatenation of ``formatted`` by (turn, role, formatted); the loss
    falls on the span ``text_start:text_end`` of assistant turns.
    """
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.col("text").cast("string"),
    )
    return rows.mapInArrow(
        _format_batches,
        "conv_id long, turn long, role string, formatted string, text_start long, text_end long, loss boolean",
    )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation and turn; what is kept is two hash states and counters."""
    current: object = ()
    out: list[tuple] = []
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = chars = loss_chars = 0

    def close() -> None:
        if current != ():
            out.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def emitted() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out)) if out else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    for batch in batches:
        for conv, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()):
            if current == () or conv != current:
                close()
                current, n, chars, loss_chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            ((role, text, _, _),) = parse(formatted)
            n += 1
            chars += len(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                loss.update(text.encode())
                loss_chars += len(text)
        if out:
            yield emitted()
            out = []
    close()
    yield emitted()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations recovers, as counts and digests."""
    return (
        formatted.select("conv_id", "turn", "role", "formatted")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "formatted")
        .select("conv_id", "formatted")
        .mapInArrow(
            _digest_batches,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
            " formatted_chars long",
        )
    )
