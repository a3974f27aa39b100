"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation are rendered
and each output is compared with the one before: the new part is the span of the new turn. An output that does
not begin with the one before means that the template rewrites history; it is reported, or refused.

Conversations stream through sorted partitions, one in memory at a time. The prefix of every turn is rendered whole and
compared with the one before, so n turns cost the sum of n prefixes; the template here remembers the turns that it
rendered last, which makes that a matter of joining strings. A caller who answers for a template that renders each turn by
itself can say so (attribute ``turn_local``): then turns are rendered alone, and the joined result is compared with the
whole prefix at 1, 2, 4, .. turns and at the last one only; where they differ, every prefix is rendered. No template here
says so.

Defined results: null text and null role are empty; a null conversation id is a conversation of its own; turns
with equal numbers follow by role, then text; null turn numbers come first; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import prepare, tidied

Turn = tuple[str, str]

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double backslashes, and part every control string after its first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=256)
def _rendered(turn: Turn) -> str:
    role, text = turn
    body = escape(text)
    if role == "system":
        return f"[SYS] {body} [/SYS]"
    if role == "user":
        return f"<s>[INST] {body} [/INST]"
    if role == "assistant":
        return f" {body} </s>"
    return f"[ROLE] {escape(role)} [/ROLE] {body} </s>"


def instruct_template(turns: Iterable[Turn]) -> str:
    """``[SYS] .. [/SYS]``, ``<s>[INST] .. [/INST]``, `` .. </s>``, and ``[ROLE] name [/ROLE] .. </s>`` for other roles."""
    return "".join(map(_rendered, turns))


#: How a rendered turn reads back; role None: the first group names it.
READERS = (
    ("system", re.compile(r"\[SYS\] (.*) \[/SYS\]", re.S)),
    ("user", re.compile(r"<s>\[INST\] (.*) \[/INST\]", re.S)),
    (None, re.compile(r"\[ROLE\] (.*?) \[/ROLE\] (.*) </s>", re.S)),
    ("assistant", re.compile(r" (.*) </s>", re.S)),
)


@dataclass
class Span:
    """A turn's place in the formatted text and, read back from there, its role and text."""

    start: int
    end: int
    role: str
    text: str
    loss_start: int
    loss_end: int


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """Role, text, and where the text lies in a rendered turn."""
    for role, pattern in READERS:
        if m := pattern.fullmatch(piece):
            body = m.lastindex
            return role if role is not None else unescape(m[1]), unescape(m[body]), *m.span(body)
    raise ValueError(f"no turn can be read from {piece[:80]!r}")


def _agree_until(a: str, b: str) -> int:
    """Length of the common beginning."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def incremental(turns: list[Turn], template: Callable[[list[Turn]], str] = instruct_template) -> tuple[str, list[tuple[int, str, int]]]:
    """The formatted text; and of every turn: where its output begins, its output, and rewrites of history so far.

    After a rewrite a turn's output begins where the two renderings part.
    """
    if getattr(template, "turn_local", False):
        pieces = [template([t]) for t in turns]
        points = {1 << k for k in range(len(turns).bit_length())} | {len(turns)}
        if all("".join(pieces[:n]) == template(turns[:n]) for n in sorted(points)):
            starts = [0, *accumulate(map(len, pieces))]
            return "".join(pieces), [(a, x, 0) for a, x in zip(starts, pieces, strict=False)]
    before, rewrites, out = "", 0, []
    for n in range(1, len(turns) + 1):
        after = template(turns[:n])
        start = len(before)
        if not after.startswith(before):
            rewrites, start = rewrites + 1, _agree_until(before, after)
        out.append((start, after[start:], rewrites))
        before = after
    return before, out


def format_conversation(turns: Iterable[Turn], template: Callable[[list[Turn]], str] = instruct_template, reader: Callable | None = read_turn) -> tuple[str, list[Span], int]:
    """The formatted text, the spans of its turns, and how often the template rewrote history.

    ``reader`` reads a rendered turn of this template back; without one, spans have the turn as given and no loss part.
    Turns from the first rewrite on have no span.
    """
    turns, spans = list(turns), []
    text, added = incremental(turns, template)
    for turn, (start, piece, rewrites) in zip(turns, added, strict=True):
        if rewrites:
            break
        end = start + len(piece)
        role, own, a, b = reader(text[start:end]) if reader and text[start:end] == piece else (*turn, 0, 0)
        spans.append(Span(start, end, role, own, start + a if role == "assistant" else start, start + b if role == "assistant" else start))
    return text, spans, added[-1][2] if added else 0


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, each conversation in one partition and in order."""
    prepare(conversations.sparkSession)
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streams(batches) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """(conv_id, turns) of sorted batches, one turn at a time."""
    from itertools import groupby

    rows = ((c, r, t) for b in batches for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
    for conv, group in groupby(rows, key=lambda x: x[0]):
        yield conv, ((r, t) for _, r, t in group)


def formatted(conversations: DataFrame, template: Callable[[Iterable[Turn]], str] = instruct_template) -> DataFrame:
    """One row per turn: conv_id, position, role, start, end, piece (formatted text), loss_start, loss_end, rewrites so far.

    Pieces of a conversation in order are its formatted text. After a rewrite, spans are null.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrites", pa.int64())])

    def run(batches):
        rows, size = [], 0
        for conv, turns in _streams(batches):
            given = list(turns)
            _, added = incremental(given, template)
            for k, (start, piece, rewrites) in enumerate(added):
                spans = (None, None, None, None)
                if not rewrites:
                    role, _, a, b = read_turn(piece)
                    spans = (start, start + len(piece), *((start + a, start + b) if role == "assistant" else (None, None)))
                rows.append({"conv_id": conv, "position": k, "role": given[k][0], "start": spans[0], "end": spans[1], "piece": piece, "loss_start": spans[2], "loss_end": spans[3], "rewrites": rewrites})
                size += len(piece)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ordered_turns(conversations).mapInArrow(tidied(run), "conv_id long, position long, role string, start long, end long, piece string, loss_start long, loss_end long, rewrites long")


def digests(conversations: DataFrame) -> DataFrame:
    """Read the formatted conversations back and digest turns and text under the loss mask.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A template that rewrites history is refused.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        rows = []
        for conv, turns in _streams(batches):
            text, spans, rewrites = format_conversation(turns)
            if rewrites:
                raise ValueError("the template rewrites history")
            all_turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for x in spans:
                role, own, _, _ = read_turn(text[x.start : x.end])
                all_turns.update(f"{role}\n{own}\n".encode())
                if role == "assistant":
                    under_mask = unescape(text[x.loss_start : x.loss_end])
                    chars += len(under_mask)
                    loss.update(under_mask.encode())
            rows.append({"conv_id": conv, "n_turns": len(spans), "turns_sha256": all_turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(text)})
            if len(rows) == 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ordered_turns(conversations).mapInArrow(tidied(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
