import hashlib
import itertools
import random
import re
import zlib

import pytest

from brindle.llm import conversations, queries
from brindle.llm.conversations import Repair

SCHEMA = "conv_id long, turn long, role string, text string, kind string, same string, copies string"
GOOD = re.compile(r"(s?(ua)+)?")


def every_repair(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The cheapest edits by trying all of them, with up to two insertions between rows; ties to the least letters."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    edits = [["D"] if must_go else ["D", "K", "Ru", "Ra"] for _, must_go, _ in rows]
    for choice in itertools.product(*edits):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, letters, roles = 0, "", ""
            for gap, edit, row in itertools.zip_longest(gaps, choice, rows):
                cost, letters, roles = cost + 2 * len(gap), letters + "I" * len(gap), roles + gap
                if edit is not None:
                    letters += edit[0]
                    cost += 3 if edit == "D" else (2 if edit[0] == "R" else 0) + row[2]
                    roles += "" if edit == "D" else row[0] if edit == "K" else edit[1]
            if GOOD.fullmatch(roles) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def by_tuples(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The same by a program over (cost, letters) pairs."""
    paths = {"": (0, "")}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def less(a, b):
        return b is None or a < b

    def inserted(paths):
        for _ in range(2):
            for state, (cost, letters) in list(paths.items()):
                for role in "ua":
                    to = step[state].get(role)
                    if to and less((cost + 2, letters + "I"), paths.get(to)):
                        paths[to] = cost + 2, letters + "I"
        return paths

    for initial, must_go, cut in rows:
        after = {}

        def put(state, cost, letters):
            if less((cost, letters), after.get(state)):  # noqa: B023
                after[state] = cost, letters  # noqa: B023

        for state, (cost, letters) in inserted(paths).items():
            put(state, cost + 3, letters + "D")
            if not must_go:
                for role in "ua":
                    if role in step[state]:
                        put(step[state][role], cost + 2 + cut, letters + "R")
                if initial in step[state]:
                    put(step[state][initial], cost + cut, letters + "K")
        paths = after
    return min(v for s, v in inserted(paths).items() if s in ("", "a"))


def solved(rows):
    repair = Repair()
    for row in rows:
        repair.add(*row)
    return repair.result()


def test_the_least_integer_is_the_cheapest_repair_with_the_first_letters():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.4) for _ in range(rng.randrange(4))]
        assert solved(rows) == every_repair(rows) == by_tuples(rows), rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_blocks_of_any_size_give_the_same_letters(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(80):
        rows = [(rng.choice("ssuuaax"), rng.random() < 0.3, rng.random() < 0.4) for _ in range(rng.randrange(60))]
        assert solved(rows) == by_tuples(rows), rows


def plainly(rows: list[tuple]) -> dict:
    """The whole contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r[:4] for r in rows if r[0] == conv]:
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        order = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        kept.sort(key=order)
        seen, counts, facts = set(), [0, 0, 0], []
        for _, role, text in kept:
            end = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            facts.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = by_tuples(facts)
        state, left, lines = "", list(kept), []
        for letter in audit:
            want = "a" if state == "u" else "u"
            full = {"u": "user", "a": "assistant"}[want]
            if letter == "I":
                lines.append(f"{full}:")
                state = want
            else:
                _, role, text = left.pop(0)
                if letter == "R":
                    lines.append(f"{full}:{text}")
                    state = want
                elif letter == "K":
                    lines.append(f"{role}:{text}")
                    state = role[:1]
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_up() -> list[tuple]:
    rng, out = random.Random(11), []
    texts = ["Hello there.", "What is it?", "no end", "  \t", "", "Yes!\n", "Ünï. ", None, "x" * 50_000 + "."]
    for conv in range(60):
        out += [(conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""]), rng.choice(texts)) for turn in range(rng.randrange(9))]
    out += [(100, turn, ["user", "assistant"][turn % 2], f"text {turn % 700}.") for turn in range(1500)]
    out += [(100, 3, "user", "text 3."), (100, 3, "user", "text 3.")]
    out += [(None, None, "user", "hi."), (None, 1, "assistant", "hi."), (101, None, None, None)]
    return out


def test_query_equals_the_plain_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rows = made_up()
    spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r[n] for n in names) for r in got} == plainly(rows)


def test_repaired_turns_read_as_they_should(spark):
    rows = conversations.damaged(spark.createDataFrame([(*r, "c", "c", "c") for r in made_up()], SCHEMA))
    turns = conversations.repaired(rows, conversations.repairs(rows)).collect()
    by_conv = {}
    for r in turns:
        by_conv.setdefault(r.conv_id, []).append(r)
    assert by_conv
    for some in by_conv.values():
        assert [r.place for r in some] == list(range(len(some)))
        assert GOOD.fullmatch("".join(r.role[:1] for r in some))


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).count() == 0
