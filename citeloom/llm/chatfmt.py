"""Chat formatting with a grammar round trip.

Turns are rendered with control strings. A deterministic parser reads the rendering back;
where the recovered turn differs from the source, because its text holds control strings,
the text is escaped, and rendering and parsing repeat until they agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, by role; other roles are named in their tag.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<sys>", "</sys>")}
LOSS_ROLE = "assistant"
#: A control string; escaping puts one more backslash after its first character.
CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|/?sys>|role:|/role>)"
_CONTROL = re.compile(CONTROL)
_BARE = re.compile(r"[\[<](?:/?INST\]|/?s>|/?sys>|role:|/role>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>|/?sys>|role:|/role>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> str:
    if role in MARKS:
        opening, closing = MARKS[role]
        return f"{opening}{text}{closing}"
    return f"<role:{role.replace('%', '%25').replace('>', '%3E')}>{text}</role>"


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendering; None if it isn't one. Opening and closing strings must pair, and nothing stands between turns."""
    turns, at = [], 0
    openings = {o: r for r, (o, _) in MARKS.items()}
    while at < len(rendered):
        role = next((r for o, r in openings.items() if rendered.startswith(o, at)), None)
        if role is not None:
            begin, closing = at + len(MARKS[role][0]), MARKS[role][1]
        elif rendered.startswith("<role:", at) and (stop := rendered.find(">", at)) > 0:
            role, begin, closing = rendered[at + 6 : stop].replace("%3E", ">").replace("%25", "%"), stop + 1, "</role>"
        else:
            return None
        bare = _BARE.search(rendered, begin)
        end = bare.start() - len(closing) + len(closing.lstrip()) if bare else -1
        if end < begin or not rendered.startswith(closing, end):
            return None
        turns.append((role, unescape(rendered[begin:end])))
        at = end + len(closing)
    return turns


def round_trip(role: str, text: str) -> str:
    """The rendering of a turn that reads back as the turn, escaped as often as that takes."""
    body = text
    while parse(out := render(role, body)) != [(role, text)]:
        if (more := escape(text)) == body:
            raise ValueError(f"turn of role {role!r} can't be rendered")
        body = more
    return out


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, role, text, formatted, loss), one per turn, sorted inside partitions that hold whole conversations.

    Turns go by turn, nulls first; ties by role, then text; repeated rows stay. Null roles
    and texts count as empty; a null conv_id is a conversation of its own. A conversation's
    rendering is its turns' in order, nothing between. Turns stream through, so that a
    conversation of any length takes the memory of a batch.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("loss", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            formatted = [round_trip(r, t) for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(formatted, pa.string()), pa.array([r == LOSS_ROLE for r in roles], pa.bool_())], schema=schema)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    dealt = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, role string, text string, formatted string, loss boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from `formatted` of format_turns() alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == LOSS_ROLE:
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return formatted.select("conv_id", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
