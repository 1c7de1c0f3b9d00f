"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. The rendered text is read back by a deterministic parser; where
what it recovers differs from the source, the conflicting parts are escaped by one backslash inside ``<|`` and the turn is
rendered again, until both are identical. The parser takes one backslash out of every ``<\\|``, ``<\\\\|`` and so on, so
escaping can be undone whatever the text holds. A role is one line: the parser reads ``\\n`` in it as a line end and ``\\\\`` as one
backslash. Assistant texts are under the loss mask.

Turns are rendered one by one wherever they are. Only digests need a conversation in order: rows are sorted by conversation
and turn and read as a stream with a constant state, so a conversation of any length fits in memory.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own; turns without a number come
first, and turns with equal numbers are ordered by role, then by text as it was before escaping; repeated rows are turns of
their own; texts of any length are written whole; an empty table gives an empty result; other columns, whatever their names,
are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPES = re.compile(r"\\([n\\])")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPES.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the text as written starts and ends. Raises ValueError if the
    text isn't a sequence of whole turns."""
    turns, at = [], 0
    while at < len(formatted):
        line, end = formatted.find("\n", at), formatted.find(END, at)
        if not formatted.startswith(START, at) or line < 0 or end < line or formatted[end + len(END) : end + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        begin = at + len(START)
        if START in formatted[begin:end]:
            raise ValueError(f"a turn starts inside the turn at {at}")
        turns.append((unescape_role(formatted[begin:line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """One turn as text that parses back to it."""
    written = [role, text]
    for _ in range(3):
        out = f"{START}{written[0]}\n{written[1]}{END}\n"
        try:
            back = parse(out)
        except ValueError:
            back = []
        if len(back) == 1 and back[0][:2] == (role, text):
            return out
        if "\n" in written[0] or START in written[0] or END in written[0] or unescape_role(written[0]) != role:
            written[0] = escape_role(written[0])
        if START in written[1] or END in written[1] or unescape(written[1]) != text:
            written[1] = escape(written[1])
    raise ValueError("a turn can't be rendered")


def _render_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(formatted=[render(r, t) for r, t in zip(b["role"], b["text"], strict=True)]).drop(columns="text")


def render_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, formatted``: each turn as rendered; a conversation's text is these in order."""
    c = conversations
    plain = c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"),
    )
    return plain.mapInPandas(_render_batches, "conv_id long, turn long, role string, formatted string")


class _Digest:
    """Reads one conversation's rendered turns in order."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def read(self, formatted: str) -> None:
        for role, text, _, _ in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state = None, None

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    for b in batches:
        ended = []
        ids = b["conv_id"].astype("Int64")
        for conv, formatted in zip(ids, b["formatted"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if state is None or conv != now:
                if state is not None:
                    ended.append(state.row(now))
                now, state = conv, _Digest()
            state.read(formatted)
        yield frame(ended)
    if state is not None:
        yield frame([state.row(now)])


def _source_text(formatted: Column) -> Column:
    """The turn's text as it was before escaping, by which turns of one number and role are ordered."""
    begin = F.instr(formatted, "\n") + 1
    written = F.substring(formatted, begin, F.char_length(formatted) - (begin - 1) - (len(END) + 1))
    return F.regexp_replace(written, r"<\\(\\*)\|", "<$1|")


def digests(rendered: DataFrame) -> DataFrame:
    """What reads back from the rendered turns, one row a conversation."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", _source_text(F.col("formatted")))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted").mapInPandas(_digest_batches, schema)


def conversation_texts(rendered: DataFrame) -> DataFrame:
    """``conv_id, text, loss_spans``: whole conversations for training, and where the loss mask lies in them. For
    conversations of a size that fits in a row; use ``render_turns`` itself for longer ones."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", _source_text(F.col("formatted")).alias("source"), "formatted")))
    built = rendered.groupBy("conv_id").agg(turns.alias("t"))
    lengths = F.transform("t", lambda x: F.char_length(x["formatted"]))
    start = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)
    tail = F.lit(len(END) + 1)
    spans = F.transform(
        "t",
        lambda x, i: F.when(
            x["role"] == "assistant",
            F.struct((start(i) + F.instr(x["formatted"], "\n")).alias("start"), (start(i + 1) - tail).alias("end")),
        ),
    )
    return built.select("conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("text"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))
