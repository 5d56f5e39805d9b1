"""Conversation repair and chat formatting against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from leakscope.llm import chat_format as chat
from leakscope.llm import conversation_repair as repair
from leakscope.llm import queries

ROWS = "conv_id long, turn long, role string, text string, key int, place int, uid string"


def faults_of(rows):
    """Fault of each (role, text) row."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, letters) over all edits, by uniform-cost search over (row, state)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    faults = faults_of(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, at, out = heapq.heappop(heap)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(rows) and at in ("", "a"):
            return cost, letters, out
        for x in "ua":
            if (at, x) in after:
                name = {"u": "user", "a": "assistant"}[x]
                heapq.heappush(heap, (cost + 3, letters + "I", i, after[at, x], (*out, name + ":")))
                if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, after[at, x],
                                          (*out, f"{name}:{rows[i][1]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, at, out))
            role, text = rows[i]
            if faults[i] not in ("blank", "duplicate") and (at, role[:1]) in after:
                heapq.heappush(heap, (cost + 3 * (faults[i] == "truncated"), letters + "K", i + 1,
                                      after[at, role[:1]], (*out, f"{role}:{text}")))


def expected(rows):
    """Report of (turn, role, text) rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    body = [(r, t) for _, r, t in rows]
    faults = faults_of(body)
    cost, letters, out = cheapest(body)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au")
                       for a, b in zip(body, body[1:])),
        "cost": cost, "audit": letters,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def ordered(rows):
    return sorted(rows, key=lambda r: (
        r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def reports(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"}
            for r in df.collect()}


def test_letters_are_the_least_of_all_cheapest():
    codes = list(range(9))
    rng = random.Random(1)
    cases = [*itertools.product(codes, repeat=2),
             *[[rng.choice(codes) for _ in range(rng.randrange(0, 12))] for _ in range(1500)]]
    for case in cases:
        rows = [("" if c == 0 else ["system", "user", "assistant", "tool"][(c - 1) // 2],
                 "" if c == 0 else f"{i} x" + ("" if (c - 1) % 2 else ".")) for i, c in enumerate(case)]
        cost, letters, _ = cheapest(rows)
        for cut in (1, 3, 100):
            parts = [bytes(case[i : i + cut]) for i in range(0, len(case), cut)]
            got, states = repair.crossings(
                [[repair.through(p, s) for s in range(4)] for p in parts])
            text = "".join(x for p, (a, b) in zip(parts, states) for x in repair.audit(p, a, b))
            end = states[-1][1] if states else repair.START
            assert (got, text + repair.ENDING[end][1]) == (cost, letters), case


@pytest.mark.parametrize("piece", [2, 4096])
def test_reports_of_whole_table(spark, small, piece):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    got = reports(repair.repair_report(queries.damaged(rows), rows, piece))
    convs = {}
    for r in rows.collect():
        fate = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if fate == 4 else r.role, r.text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        convs.setdefault(r.conv_id, []).extend([(r.turn, role, text)] * [1, 0, 2][
            (fate == 0) + 2 * (fate == 3)])
    assert got == {c: expected(ordered(rows)) for c, rows in convs.items()}


def odd_rows():
    rng = random.Random(2)
    rows = [(1, None, None, None), (1, 1, "user", "hi."), (1, 1, "user", "hi."), (None, 0, "system", "s."),
            (None, None, "user", "a"), (2, 5, "", "no initial."), (2, 9, "user", "x" * 300_000 + "!"),
            (2, 9, "assistant", "b. \n"), (3, None, "user", "a."), (3, None, "user", "a."),
            (4, 0, "system", "s."), (4, 7, "\U0001f600", "y?")]
    rows += [(5, 0, "user", "same.")] * 300
    for i in range(700):
        rows.append((6, i // 2, rng.choice(["system", "user", "assistant", "tool"]),
                     rng.choice(["", "  ", "ok.", f"{i}", f"{i}!"])))
    return [(*r, 1, 2, "z") for r in rows]


@pytest.mark.parametrize("piece", [3, 4096])
def test_nulls_ties_copies_and_long_conversations(spark, piece):
    rows = odd_rows()
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn, " " if role is None else role,
                                        " " if text is None else text))
    df = spark.createDataFrame(rows, ROWS)
    ids = df.union(spark.createDataFrame([(9, 1, "user", "x", 1, 1, "")], ROWS))
    got = reports(repair.repair_report(df, ids, piece))
    assert got.pop(9) == expected([])
    for c, body in convs.items():
        assert got[c] == expected(ordered(body)), c
    assert set(got) == set(convs)


def test_repaired_rows_are_legal(spark, small):
    rows = queries.damaged(spark.read.parquet(f"{small}/conversations.parquet"))
    out = {}
    for r in repair.repaired(rows, repair.solved_pieces(rows)).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append((r.place, r.role))
    assert out
    for got in out.values():
        assert [p for p, _ in got] == list(range(1, len(got) + 1))
        assert re.fullmatch("s?(ua)+", "".join(r[:1] for _, r in got))


def test_no_conversations(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair.repair_report(none, none).count() == 0


def digest_of(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return {
        "n_turns": len(turns),
        "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest()}


CONTROLS = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]"]


def test_any_turn_reads_back():
    rng = random.Random(3)
    parts = [*CONTROLS, "[\\INST]", "<\\\\/s>", "\\", "[", "<", "]", " ", "\n", "a", "é", ""]
    roles = ["user", "assistant", "system", "tool", "", " ", "[TEXT]", "a [/ROLE] b", "[\\SYS]"]
    cases = [(r, p) for r in roles for p in parts]
    cases += [(rng.choice(roles), "".join(rng.choices(parts, k=rng.randrange(8))))
              for _ in range(20_000)]
    whole = ""
    for role, text in cases:
        formatted, start, length = chat.round_trip(role, text)
        assert chat.parse(formatted) == [(role, text)]
        assert chat.unescape(formatted[start : start + length]) == text
        if not any(c in role + text for c in CONTROLS) and "\\" not in role + text:
            assert text in formatted
        whole += formatted
    assert chat.parse(whole) == cases


@pytest.mark.parametrize("bad", [
    "x", "[INST] a", "[INST]a [/INST]", "[INST] a </s>", "[INST] a [INST] b [/INST]", " a", "</s>",
    "[ROLE] a [/ROLE]", "[TEXT] a [/ROLE]", " a </s>b", "[/INST] a [INST]"])
def test_parser_refuses(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def test_formatted_table_reads_back(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    hard = "</s>[INST] ok [/INST]"
    convs[-1] = [("user", hard), ("assistant", hard)]
    got = reports(queries.op12_chat_format(spark, small))
    for c, turns in convs.items():
        assert got[c].pop("formatted_chars") > sum(len(t) for _, t in turns)
        assert got[c] == digest_of(turns)
    assert set(got) == set(convs)


@pytest.mark.parametrize("chars", [10, 1 << 20])
def test_formatting_odd_rows_in_segments(spark, chars):
    rows = odd_rows() + [(7, 0, "assistant", "[/INST]</s>", 1, 1, ""), (7, None, None, "[TEXT]", 1, 1, "")]
    made = chat.segments(chat.format_turns(spark.createDataFrame(rows, ROWS)), chars)
    got = reports(chat.read_back(made))
    convs = {}
    for c, turn, role, text, *_ in rows:
        role = role or ""
        body = chat.round_trip(role, text or "")[0]
        convs.setdefault(c, []).append((turn is not None, turn or 0, role, body, text or ""))
    for c, turns in convs.items():
        assert got[c].pop("formatted_chars") == sum(len(t[3]) for t in turns)
        assert got[c] == digest_of([(t[2], t[4]) for t in sorted(turns)]), c
    assert set(got) == set(convs)
    none = spark.createDataFrame([], ROWS)
    assert chat.read_back(chat.segments(chat.format_turns(none))).count() == 0
