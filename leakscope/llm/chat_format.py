r"""Chat formatting held to a grammar round trip.

Grammar of a formatted conversation:

    conversation = turn*
    turn         = "[INST] " body " [/INST]"                      user
                 | "[SYS] " body " [/SYS]"                        system
                 | " " body " </s>"                               assistant
                 | "[ROLE] " name " [TEXT] " body " [/ROLE]"      any other role

A body or name holds no control string. Each turn is rendered raw and parsed again; where the
parsed turn differs from its source, its control strings are escaped by a backslash behind their
first character (`[INST]` becomes `[\INST]`, `[\INST]` becomes `[\\INST]`) and the turn is parsed
again; the parser takes one backslash off. A turn ends with its own closing string, so turns that
survive the round trip one by one survive it in any order, and no conversation is held whole.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from leakscope.llm.common import mapped

_STRINGS = r"/?s>|/?(?:INST|SYS|ROLE)\]|TEXT\]"
CONTROL = re.compile(r"<(?:/?s)>|\[(?:/?(?:INST|SYS|ROLE)|TEXT)\]")
_ESCAPABLE = re.compile(rf"([<\[]\\*)({_STRINGS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*(?:{_STRINGS}))")

PLAIN = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("", "</s>")}
OPENED = {opening: (role, closing) for role, (opening, closing) in PLAIN.items()}

# Code points of a segment; a longer turn is a segment of its own.
SEGMENT = 1 << 20


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its body begins."""
    if role in PLAIN:
        opening, closing = PLAIN[role]
        return f"{opening} {text} {closing}", len(opening) + 1
    return f"[ROLE] {role} [TEXT] {text} [/ROLE]", len(role) + 15


def _body(content: str) -> str:
    if len(content) < 2 or content[0] != " " or content[-1] != " ":
        raise ValueError("a body stands between two blanks")
    return unescape(content[1:-1])


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns; ValueError where the grammar does not hold."""
    turns, at, tokens = [], 0, CONTROL.finditer(formatted)
    for token in tokens:
        opening = token.group() if token.start() == at else ""
        parts, end = [], token
        if opening:
            parts, end = [token.end()], next(tokens, None)
        else:
            parts = [at]
        if opening == "[ROLE]" and end and end.group() == "[TEXT]":
            name = _body(formatted[parts[0] : end.start()])
            start, end = end.end(), next(tokens, None)
            closing, role = "[/ROLE]", name
        else:
            start, (role, closing) = parts[0], OPENED.get(opening, (None, None))
        if role is None or end is None or end.group() != closing:
            raise ValueError("no turn")
        turns.append((role, _body(formatted[start : end.start()])))
        at = end.end()
    if at != len(formatted):
        raise ValueError("text behind the last turn")
    return turns


def _reads_as(formatted: str, turn: tuple[str, str]) -> bool:
    try:
        return parse(formatted) == [turn]
    except ValueError:
        return False


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses to its source, and start and length of its body."""
    body = text
    formatted, start = render(role, body)
    if not _reads_as(formatted, (role, text)):
        body = escape(text)
        formatted, start = render(escape(role), body)
        if not _reads_as(formatted, (role, text)):
            raise ValueError("the escaped turn reads otherwise")
    return formatted, start, len(body)


def _rows(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _flushed(rows, schema: pa.Schema, chars: int = 1 << 22):
    """Record batches of bounded text."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row.get("formatted") or "") + 256
        if held > chars:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def format_turns(rows: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) formatted: conv_id, turn, role, formatted, start, length.

    `start` and `length` are the code points of `formatted` under the loss mask: the body of an
    assistant turn, else null. Null texts and roles are empty; other columns are ignored; repeated
    rows stay; a text of any length is one turn. An empty table gives none. Rows are formatted
    where they are read, without a shuffle.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, turn long, role string, formatted string, start long, length long"
    arrow = _arrow(schema)

    def run(batches):
        def done():
            for r in _rows(batches):
                role = r["role"] or ""
                formatted, start, length = round_trip(role, r["text"] or "")
                if role != "assistant":
                    start = length = None
                yield {"conv_id": r["conv_id"], "turn": r["turn"], "role": role,
                       "formatted": formatted, "start": start, "length": length}

        yield from _flushed(done(), arrow)

    turns = rows.selectExpr("conv_id", "cast(turn as long) as turn", "role", "text")
    return mapped(turns, run, schema)


def segments(turns: DataFrame, chars: int = SEGMENT) -> DataFrame:
    """The formatted turns of each conversation in order, joined to segments: conv_id, segment
    (from 0), formatted, loss (start and length of each stretch under the mask).

    Turns come by `turn`, nulls first, ties by role and formatted text. A conversation is the
    concatenation of its segments; a segment holds whole turns and at most `chars` code points, or
    one longer turn. Tasks stream sorted rows, so a conversation of any length needs the memory of
    one segment. Null conv_ids are one conversation.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {conv}, segment long, formatted string, "
              "loss array<struct<start: long, length: long>>")
    arrow = _arrow(schema)

    def run(batches):
        def done():
            conv_id, segment, held, size, loss = None, 0, [], 0, []
            for r in _rows(batches):
                text = r["formatted"]
                other = r["conv_id"] != conv_id
                if held and (other or size + len(text) > chars):
                    yield {"conv_id": conv_id, "segment": segment, "formatted": "".join(held),
                           "loss": loss}
                    segment, held, size, loss = segment + 1, [], 0, []
                if other:
                    conv_id, segment = r["conv_id"], 0
                if r["start"] is not None:
                    loss.append({"start": size + r["start"], "length": r["length"]})
                held.append(text)
                size += len(text)
            if held:
                yield {"conv_id": conv_id, "segment": segment, "formatted": "".join(held),
                       "loss": loss}

        yield from _flushed(done(), arrow)

    order = ["conv_id", "turn", "role", "formatted"]
    return mapped(turns.repartition("conv_id").sortWithinPartitions(*order), run, schema)


def read_back(found: DataFrame) -> DataFrame:
    """A row for each conversation, read from its segments by the parser and the loss mask.

    `found` holds each conversation's segments in order within one partition, as `segments` gives
    them. Returns conv_id, n_turns, turns_sha256 (role and text, each with a newline), loss_chars,
    loss_sha256 (the unescaped text under the mask) and formatted_chars. Digests are sequential,
    so segments stream through them one at a time.
    """
    conv = found.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long")
    arrow = _arrow(schema)

    def run(batches):
        import hashlib

        def done():
            out = turns = loss = None

            def finished():
                return out | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

            for r in _rows(batches, 64):
                if out is None or r["segment"] == 0:
                    if out:
                        yield finished()
                    out = {"conv_id": r["conv_id"], "n_turns": 0, "loss_chars": 0,
                           "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                formatted = r["formatted"]
                for role, text in parse(formatted):
                    out["n_turns"] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    text = unescape(formatted[span["start"] : span["start"] + span["length"]])
                    out["loss_chars"] += len(text)
                    loss.update(text.encode())
                out["formatted_chars"] += len(formatted)
            if out:
                yield finished()

        yield from _flushed(done(), arrow)

    return mapped(found, run, schema)
