"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, turn, message, seq, kind, role, text): ``start``
opens a message, ``delta`` adds streamed text, ``edit`` replaces the text so
far, ``regenerate`` throws it away and the deltas begin anew. Partitioned by
conversation and message and sorted by sequence, each task folds its events
into final messages as a stream, holding one message; a conversation with a
third of all rows spreads over tasks by its messages.

A message renders as ``<turn>role``, a line break, the text, ``</turn>`` and a
line break. ``\\``, ``<`` and, in a role, line breaks are escaped (``\\\\``,
``\\l``, ``\\n``), so no text can hold a control string, and reading the output
gives back every text. The loss mask covers the assistant's escaped texts.

Reading back and digesting a conversation is a stream in (turn, message) order
too: memory is one message, though one conversation's digest is one task's work.

Defined results: a null text or role is empty; a null conv_id is one
conversation, a null turn comes first; rows that share conversation and turn
are ordered by role and text; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = ("conv_id", "turn", "message", "seq", "kind", "role", "text")
MESSAGE = "conv_id long, turn long, message long, role string, text string"
ASSISTANT = "assistant"


def _fold(batches):
    """Final messages from events sorted by (conv_id, turn, message, seq)."""
    now, role, parts = None, "", []
    out: list[tuple] = []
    size = 0

    def flush():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "message", "role", "text"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for conv, turn, message, _, kind, who, text in zip(*(batch.slice(at, 1024)[c].to_numpy(zero_copy_only=False).tolist() if batch.schema.field(c).type == pa.string() else batch.slice(at, 1024)[c].to_pylist() for c in EVENT)):
                if (conv, turn, message) != now:
                    if now is not None:
                        out.append((*now, role, "".join(parts)))
                        size += sum(map(len, parts))
                        if len(out) >= 4096 or size > 4 << 20:
                            yield flush()
                            out, size = [], 0
                    now, role, parts = (conv, turn, message), "", []
                if kind == "start":
                    role = who or ""
                elif kind == "delta":
                    parts.append(text or "")
                elif kind == "edit":
                    parts = [text or ""]
                elif kind == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown kind of event {kind!r}")
    if now is not None:
        out.append((*now, role, "".join(parts)))
    if out:
        yield flush()


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, message, role, text of each message of a log."""
    keys = ["conv_id", "turn", "message"]
    log = events.select(*EVENT).repartition(*keys).sortWithinPartitions(*keys, "seq", "kind", "text")
    return log.mapInArrow(_fold, MESSAGE)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\l", "<").replace("\\n", "\n") for p in parts)


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with formatted, and the loss mask's span within it
    (mask_start, mask_length, in characters; length 0 for other roles)."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit("<turn>"), role, F.lit("\n"))
    body = escape(F.col("text"))
    mask = F.when(F.col("role") == ASSISTANT, F.char_length(body)).otherwise(0)
    return messages.select("conv_id", "turn", "message", F.concat(head, body, F.lit("</turn>\n")).alias("formatted"), F.char_length(head).alias("mask_start"), mask.alias("mask_length"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index("</turn>\n", line)
        if not formatted.startswith("<turn>", at):
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(formatted[at + 6 : line]), unescape(formatted[line + 1 : end])))
        at = end + 8
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    now, state, out = (), None, []

    def close():
        return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[f.split()[0] for f in DIGEST.split(", ")])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for conv, text, start, length in zip(part["conv_id"].to_pylist(), part["formatted"].to_pylist(), part["mask_start"].to_pylist(), part["mask_length"].to_pylist()):
                if (conv,) != now:
                    if state:
                        out.append(close())
                        if len(out) >= 4096:
                            yield flush()
                            out = []
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                loss = unescape(text[start : start + length])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
    if state:
        out.append(close())
    if out:
        yield flush()


def digests(rendered: DataFrame) -> DataFrame:
    """What reading the formatted conversations gives back, one row each."""
    whole = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message")
    return whole.select("conv_id", "formatted", "mask_start", "mask_length").mapInArrow(_digest, DIGEST)


def as_events(rows: DataFrame) -> DataFrame:
    """The log of finished conversations(conv_id, turn, role, text): every text
    streamed in two deltas; every third turn's after a draft that an edit or,
    for the assistant, a regeneration replaces."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = Window.partitionBy("conv_id", "turn").orderBy(role, text)
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    named = named.withColumn("message", F.row_number().over(order).cast("long"))
    half = (F.char_length("text") / 2).cast("int")
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    a, b = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text"))
    none = F.lit(None).cast("string")
    plain = [event(0, "start", none), event(3, "delta", a), event(4, "delta", b)]
    again = [event(0, "start", none), event(1, "delta", b), event(2, "regenerate", none), event(3, "delta", a), event(4, "delta", b)]
    edited = [event(0, "start", none), event(1, "delta", b), event(2, "edit", a), event(4, "delta", b)]
    third = F.coalesce(F.col("turn") % 3 == 1, F.lit(False))
    log = F.when(~third, F.array(*plain)).when(F.col("role") == ASSISTANT, F.array(*again)).otherwise(F.array(*edited))
    return named.select("conv_id", "turn", "message", "role", F.explode(log).alias("e")).select("conv_id", "turn", "message", "e.seq", "e.kind", "role", "e.text")
