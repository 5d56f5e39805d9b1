"""Cheapest repair of conversation structure by divide and conquer over four-state cost vectors.

A repaired conversation has the role initials ``(s?(ua)+)?``. Reading it row by row leaves one of
four states: nothing yet, after the system turn, after a user turn, after an assistant turn. From
each state every edit letter leads to one state only:

- K keeps the row (0) where its initial fits,
- R makes it a user or assistant turn, whichever fits (3),
- D deletes it (4; blank and repeated rows must go),
- I inserts an empty user or assistant turn, whichever fits (3).

An undeleted truncated row costs 3 more. So the letters (the audit) fix the repair, and of all
cheapest repairs the one with the ASCII-least letters is taken.

A conversation is cut into pieces of consecutive rows. Each piece has a 4 x 4 table: cost and rank
of its least audit from each state to each state. These are chained over the pieces of a
conversation, which gives the states in which its least cheapest repair crosses from piece to
piece. Inside a piece forward vectors (cost and rank of the audit so far) and backward vectors
(cost to the end) meet in the middle, the audit-least optimal crossing is fixed and both halves
recurse (Hirschberg), so only one pair of vectors is held beside the codes of the rows. Two audits
that consume the same rows are never prefixes of each other, hence ranks decide any tie.
"""

from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import mapped, written

START, SYSTEM, USER, ASSISTANT = range(4)
# State after the next user or assistant turn, and after a kept turn of each initial.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
INITIALS = "sua"
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# What ends a conversation from each state.
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

# Rows of a piece (one byte of code and a key each).
PIECE = 4096

BLANKS = " \t\n\x0b\x0c\r"


def code_of(initial: int, truncated: bool, gone: bool) -> int:
    """Code of a row: 0 must be deleted; else its initial (3: none of s, u, a) and truncation."""
    return 0 if gone else 1 + 2 * initial + truncated


@lru_cache(None)
def edits(code: int) -> dict:
    """{(from, to): (cost, letters)}: least inserts and edit that consume a row of this code."""
    best = {}
    extra = TRUNCATED if code and (code - 1) % 2 else 0
    initial = "sua "[(code - 1) // 2] if code else ""
    for start in range(4):
        at, spent, letters = start, 0, ""
        for _ in range(3):
            options = [(at, DELETE, "D")]
            if code:
                options.append((NEXT[at], REROLE + extra, "R"))
                if initial in KEPT[at]:
                    options.append((KEPT[at][initial], extra, "K"))
            for to, cost, letter in options:
                found = (spent + cost, letters + letter)
                if found < best.get((start, to), (1 << 60, "")):
                    best[start, to] = found
            at, spent, letters = NEXT[at], spent + INSERT, letters + "I"
    return best


def _ranked(found: list) -> tuple:
    """(least cost, vector): costs above the least and ranks of the audits, per state."""
    reached = [f for f in found if f]
    least = min(f[0] for f in reached)
    order = {audit: i for i, audit in enumerate(sorted(f[1:] for f in reached))}
    return least, tuple(f and (f[0] - least, order[f[1:]]) for f in found)


@lru_cache(1 << 16)
def forward(vector: tuple, code: int) -> tuple:
    """The vector of (cost, rank) by state after one more row, and what its least cost grew by."""
    found = [None] * 4
    for (start, to), (cost, letters) in edits(code).items():
        if vector[start]:
            f = (vector[start][0] + cost, vector[start][1], letters)
            if found[to] is None or f < found[to]:
                found[to] = f
    return _ranked(found)


@lru_cache(1 << 16)
def backward(vector: tuple, code: int) -> tuple:
    """The vector of costs to the end by state before one more row."""
    found = [None] * 4
    for (start, to), (cost, _) in edits(code).items():
        if vector[to] is not None and (found[start] is None or cost + vector[to] < found[start]):
            found[start] = cost + vector[to]
    least = min(f for f in found if f is not None)
    return tuple(None if f is None else f - least for f in found)


def only(state: int, value) -> tuple:
    return tuple(value if s == state else None for s in range(4))


def through(codes: bytes, start: int) -> list:
    """(cost, rank) of the least audit from a state through all rows to each state."""
    vector, spent = only(start, (0, 0)), 0
    for code in codes:
        more, vector = forward(vector, code)
        spent += more
    return [v and (v[0] + spent, v[1]) for v in vector]


def audit(codes: bytes, start: int, end: int) -> list[str]:
    """Letters for each row of the least cheapest edits from a state to a state."""
    out = [""] * len(codes)
    open_parts = [(0, len(codes), start, end)]
    while open_parts:
        low, high, p, q = open_parts.pop()
        if high - low == 1:
            out[low] = edits(codes[low])[p, q][1]
            continue
        middle = (low + high) // 2
        ahead, behind = only(p, (0, 0)), only(q, 0)
        for code in codes[low:middle]:
            ahead = forward(ahead, code)[1]
        for code in codes[middle:high][::-1]:
            behind = backward(behind, code)
        _, _, crossing = min(
            (a[0] + b, a[1], s) for s, (a, b) in enumerate(zip(ahead, behind))
            if a and b is not None)
        open_parts += [(low, middle, p, crossing), (middle, high, crossing, q)]
    return out


def crossings(tables: list) -> tuple[int, list]:
    """Cost, and (entry, exit) of each piece, for the `through` tables of a conversation's pieces.

    A table holds for each entry state what `through` gives.
    """
    vector, back = list(only(START, (0, 0))), []
    for piece in tables:
        found, came = [None] * 4, [None] * 4
        for p in range(4):
            for q in range(4):
                if vector[p] and piece[p][q]:
                    f = (vector[p][0] + piece[p][q][0], vector[p][1], piece[p][q][1])
                    if found[q] is None or f < found[q]:
                        found[q], came[q] = f, p
        least, vector = _ranked(found)
        vector = [v and (v[0] + least, v[1]) for v in vector]
        back.append(came)
    cost, _, at = min((v[0] + ENDING[s][0], v[1], s) for s, v in enumerate(vector) if v)
    states = []
    for came in reversed(back):
        states.append((came[at], at))
        at = came[at]
    return cost, states[::-1]


def lines(codes: bytes, letters: list[str], start: int) -> list[str]:
    """For each row the lines it becomes: k kept, U or A under a new role, u or a an empty one."""
    out, at = [], start
    for code, word in zip(codes, letters):
        made = ""
        for x in word:
            if x == "K":
                at = KEPT[at]["sua"[(code - 1) // 2]]
                made += "k"
            elif x != "D":
                at = NEXT[at]
                made += ("ua" if x == "I" else "UA")[at == ASSISTANT]
        out.append(made)
    return out


_NARROW = "copies long, initial int, blank boolean, first boolean, truncated boolean"
_FAULTS = "blank long, duplicate long, truncated long, illegal long"
_SPAN = ("low long, high long, turns long, first_turn long, last_turn long, first_initial int, "
         "last_initial int")


def _rows(batches, size: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _flushed(rows, schema: pa.Schema, size: int = 512):
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _cut(rows, piece: int):
    """Pieces of consecutive rows of one conversation, in order, from sorted narrow rows."""
    held: list[dict] = []
    for row in rows:
        if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= piece):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _piece(rows: list[dict]) -> dict:
    codes = bytes(code_of(r["initial"], r["truncated"], r["blank"] or not r["first"])
                  for r in rows)
    blank = sum(r["copies"] for r in rows if r["blank"])
    duplicate = sum(r["copies"] - r["first"] for r in rows if not r["blank"])
    truncated = sum(r["truncated"] for r in rows if not r["blank"] and r["first"])
    # copies of a row next to each other are illegal pairs, as no legal pair repeats an initial
    illegal = sum(r["copies"] - 1 for r in rows) + sum(
        (a["initial"], b["initial"]) not in LEGAL_PAIRS for a, b in zip(rows, rows[1:]))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    tables = [through(codes, s) for s in range(4)]
    return {
        "conv_id": rows[0]["conv_id"], "codes": codes, "keys": [r["key"] for r in rows],
        "copies": [r["copies"] for r in rows],
        "costs": [c[0] if c else -1 for t in tables for c in t],
        "ranks": [c[1] if c else -1 for t in tables for c in t],
        "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
        "low": min(turns, default=None), "high": max(turns, default=None),
        "turns": len(set(turns)), "first_turn": rows[0]["turn"], "last_turn": rows[-1]["turn"],
        "first_initial": rows[0]["initial"], "last_initial": rows[-1]["initial"],
    }


def _pieces(conv: str, piece: int):
    schema = (f"uid long, conv_id {conv}, codes binary, keys array<binary>, copies array<long>, "
              f"costs array<long>, ranks array<int>, {_FAULTS}, {_SPAN}")

    arrow = _arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        yield from _flushed(
            ({"uid": base + i} | _piece(p) for i, p in enumerate(_cut(_rows(batches), piece))),
            arrow, 64)

    return run, schema


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


_STATES = "uid long, entry int, exit int, ending string, cost long, seam_illegal long, seam_turn long"


def _chain():
    arrow = _arrow(_STATES)

    def run(batches):
        yield from _flushed(_chained(batches), arrow)

    return run


def _chained(batches):
    """Entry and exit of each piece, from the pieces' tables sorted by conversation and place."""

    for rows in _cut(_rows(batches), 1 << 62):
        tables = []
        for r in rows:
            cells = [None if c < 0 else (c, k) for c, k in zip(r["costs"], r["ranks"])]
            tables.append([cells[4 * p : 4 * p + 4] for p in range(4)])
        cost, states = crossings(tables)
        before = None
        for r, (entry, leave) in zip(rows, states):
            last = r is rows[-1]
            yield {
                "uid": r["uid"], "entry": entry, "exit": leave,
                "ending": ENDING[leave][1] if last else "", "cost": cost if last else 0,
                "seam_illegal": int(before is not None and (
                    before["last_initial"], r["first_initial"]) not in LEGAL_PAIRS),
                "seam_turn": int(before is not None and r["first_turn"] is not None
                                 and before["last_turn"] == r["first_turn"]),
            }
            before = r


def _solve(conv: str):
    schema = (f"conv_id {conv}, uid long, audit string, cost long, keys array<binary>, "
              f"made array<string>, places array<long>, lines long, {_FAULTS}, low long, high long, turns long")

    arrow = _arrow(schema)

    def run(batches):
        def solved():
            for r in _rows(batches, 64):
                letters = audit(r["codes"], r["entry"], r["exit"])
                made = lines(r["codes"], letters, r["entry"])
                again = [n - 1 for n in r["copies"]]
                if r["ending"]:
                    at = r["exit"]
                    for _ in r["ending"]:
                        at = NEXT[at]
                        made[-1] += "ua"[at == ASSISTANT]
                places = list(accumulate(map(len, made), initial=0))
                yield {
                    "conv_id": r["conv_id"], "uid": r["uid"],
                    "audit": "".join(w + "D" * n for w, n in zip(letters, again)) + r["ending"],
                    "cost": r["cost"] + DELETE * sum(again), "keys": r["keys"], "made": made,
                    "places": places[:-1], "lines": places[-1], "blank": r["blank"],
                    "duplicate": r["duplicate"], "truncated": r["truncated"],
                    "illegal": r["illegal"] + r["seam_illegal"], "low": r["low"],
                    "high": r["high"], "turns": r["turns"] - r["seam_turn"],
                }

        yield from _flushed(solved(), arrow, 64)

    return run, schema


def _content(rows: DataFrame) -> DataFrame:
    """Rows with null role or text as one blank, a digest of both and a key of the whole row."""
    filled = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))
    return filled.withColumn("digest", digest).withColumn("key", F.unhex(F.md5(F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("c"),
        F.col("conv_id").isNull(), F.coalesce("turn", F.lit(0)), F.col("turn").isNull(),
        F.hex("digest")))))


def _initial(role: Column) -> Column:
    """Place of the first character of a role in `INITIALS`, or 3."""
    place = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    return F.when((place > 0) & (role != ""), place - 1).otherwise(3)


def _narrow(rows: DataFrame) -> DataFrame:
    """One narrow row for each set of equal rows, with what its first copy's fault is."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    groups = _content(rows).select(
        "conv_id", "turn", "role", "digest", "key", _initial(F.col("role")).alias("initial"),
        (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?"))
        .alias("truncated"),
    ).groupBy("conv_id", "turn", "role", "digest", "key", "initial", "blank", "truncated").agg(
        F.count("*").alias("copies"))
    firsts = groups.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
        F.min(F.struct("turn")).getField("turn").alias("t"))
    return groups.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    ).select("conv_id", "turn", "role", "digest", "key", "copies", "initial", "blank",
             F.col("turn").eqNullSafe(F.col("t")).alias("first"), "truncated")


def solved_pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The least cheapest edits of all conversations, in pieces of consecutive rows.

    `rows` needs conv_id, turn, role and text; other columns are ignored. Rows come by turn, nulls
    first; rows of one turn by role and a digest of the text, copies next to each other. A null
    role or text counts as one blank; a role without an initial fits nowhere and is never kept.
    Null conv_ids are one conversation. Returns conv_id, uid (ascending within a conversation),
    audit, cost, the keys of the rows with the lines each becomes, and counts of the piece's
    faults. An empty table gives none. Memory of a task: the codes and keys of `piece` rows, and
    a small table for each piece of one conversation; a conversation of any length is spread over
    tasks by ranges of its rows.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest"]
    run, schema = _pieces(conv, piece)
    pieces = written(mapped(
        _narrow(rows).repartitionByRange(*order).sortWithinPartitions(*order)
        .drop("role", "digest"), run, schema), "repair-pieces")
    states = mapped(
        pieces.select("conv_id", "uid", "costs", "ranks", "first_turn", "last_turn",
                      "first_initial", "last_initial")
        .repartition("conv_id").sortWithinPartitions("conv_id", "uid"), _chain(), _STATES)
    run, schema = _solve(conv)
    return written(mapped(pieces.drop("costs", "ranks").join(states, "uid"), run, schema),
                   "repair-solved")


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), role, text; inserted texts are empty.

    Each text is shuffled once, by the key of its row, so that no conversation is one task.
    """
    before = solved.select(F.col("uid").alias("piece"), (F.sum("lines").over(
        Window.partitionBy("conv_id").orderBy("uid")) - F.col("lines")).alias("before"))
    made = (
        solved.join(before, F.col("uid") == F.col("piece"))
        .select("before", F.explode(F.arrays_zip("keys", "made", "places")).alias("row"))
        .select(F.col("row.keys").alias("key"), F.col("row.made").alias("made"),
                (F.col("before") + F.col("row.places")).alias("after"))
        .where("made != ''")
    )
    texts = _content(rows).select("key", "conv_id", "role", "text").dropDuplicates(["key"])
    line = F.explode(F.expr(
        "transform(sequence(1, length(made)), i -> struct(i, substring(made, i, 1) as mark))"))
    return texts.join(made, "key").select(
        "conv_id", "role", "text", "after", line.alias("line")
    ).select(
        "conv_id", (F.col("after") + F.col("line.i")).alias("place"),
        F.when(F.lower("line.mark") == "u", "user").when(F.lower("line.mark") == "a", "assistant")
        .otherwise(F.col("role")).alias("role"),
        F.when(F.col("line.mark").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def _hashed(conv: str):
    schema = f"conv_id {conv}, repaired_sha256 string"

    arrow = _arrow(schema)

    def run(batches):
        import hashlib

        def digests():
            conv_id = digest = None
            for r in _rows(batches, 1024):
                if digest is None or r["conv_id"] != conv_id:
                    if digest:
                        yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}
                    conv_id, digest = r["conv_id"], hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{r['role']}:{r['text']}".encode())
            if digest:
                yield {"conv_id": conv_id, "repaired_sha256": digest.hexdigest()}

        yield from _flushed(digests(), arrow)

    return run, schema


def line_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines joined by newlines.

    A digest is sequential, so a conversation's lines stream through one task in their order; no
    conversation is held in memory.
    """
    run, schema = _hashed(turns.schema["conv_id"].dataType.simpleString())
    return mapped(
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
        .select("conv_id", "role", "text"), run, schema)


def repair_report(rows: DataFrame, ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each conversation of `ids`: faults, cost, audit and digest of the repaired rows.

    A conversation without rows has zeros, an empty audit and the digest of an empty text.
    """
    solved = solved_pieces(rows, piece)
    total = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    found = solved.groupBy("conv_id").agg(
        (F.max("high") - F.min("low") + 1 - F.sum("turns")).alias("gaps"), *total,
        F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.struct("uid", "audit"))), lambda x: x["audit"])
        ).alias("audit"))
    digests = line_digests(repaired(rows, solved))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = ids.select("conv_id").unionByName(found, True).unionByName(digests, True)
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
