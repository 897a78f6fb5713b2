"""Conversation structure repair by integer weights.

A repaired conversation's role initials read ``(s?(ua)+)?``. Of each row it is known what has to happen: blank and repeated rows go,
others are kept, get another role or go, and empty turns may be inserted anywhere. A path through the rows and the pattern's states is one
integer: its high digits are the cost, the digits below them the letters of its edits from the left, one fixed-width digit per
letter in ASCII order, with zeros up to the end. The least integer is thus the cheapest path and, of equally cheap ones, the one
whose letters come first; the dynamic program over rows and states takes minima of integers and nothing else.

Long conversations are read in blocks of ``BLOCK`` rows, so integers stay short: at a block's end each state's digits are handed on
as one digit, its place among the states' letters so far. All paths have a letter per row there and end in one, so none is the
beginning of another and the place says all that a later comparison needs. A letter chain per state keeps what was decided.

Rows are dealt by conversation and stream through a task in order; only facts of rows (no texts) reach the program, and the texts are
shuffled once, together with the letters that are then applied to them. A task holds one block and the letters of one conversation.

Defined cases: a null role or text is one space; a null ``conv_id`` is a conversation of its own, and rows with a null turn come first. Rows
that share a turn are ordered by a hash of role and text, so repeated rows stand together. Conversations that lose all rows
get zeros, no letters and the hash of an empty string. Very long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose letters are digits of one integer.
BLOCK = 256
SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The turn that an inserted or renamed row becomes, by state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a kept row of an initial leads.
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
NAMES = {n: letter for letter, n in LETTERS.items()}
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1
DIGIT, PLACE = 3, 3
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows with faults put in by a checksum of conversation and turn; copies is 0 for a dropped row."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return table.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with a hash of role and text, by which they are compared and, within a turn, ordered."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("same", F.unhex(F.sha2(whole.cast("binary"), 256)))


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition, its rows in order; ``kind`` orders what stands at one place."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").isNotNull(), "turn", "same", "kind")


def _append(value: int, letter: int, size: int) -> int:
    """The path's integer with one more letter, in the first free digit of ``size``."""
    used = value & ((1 << DIGIT * size) - 1)
    at = size if not used else ((used & -used).bit_length() - 1) // DIGIT
    return value + (letter << DIGIT * (at - 1))


class Repair:
    """The cheapest repair of one conversation whose rows are given in order."""

    def __init__(self):
        self.rows: list[tuple[str, bool, bool]] = []
        self.paths: dict[int, tuple[int, tuple]] = {START: (0, ())}  # by state: cost, and the chain of letters so far

    def add(self, initial: str, must_go: bool, cut: bool) -> None:
        self.rows.append((initial, must_go, cut))
        if len(self.rows) >= BLOCK:
            self._close()

    def _block(self, final: bool) -> tuple[dict[int, int], int, list[int]]:
        """Per state the least integer after the block: cost, place of the state it began in, letters."""
        size = 3 * len(self.rows) + 3
        unit = 1 << (DIGIT * size + PLACE)
        begun = list(self.paths)  # in the order of their letters
        now = {state: self.paths[state][0] * unit + (place << DIGIT * size) for place, state in enumerate(begun)}

        def put(into: dict[int, int], state: int, value: int) -> None:
            into[state] = min(into.get(state, value), value)

        def inserted() -> None:
            for state in (START, SYSTEM, ASSISTANT, USER):
                if state in now:
                    put(now, NEXT[state], _append(now[state], LETTERS["I"], size) + INSERT * unit)

        for initial, must_go, cut in self.rows:
            inserted()
            after: dict[int, int] = {}
            for state, value in now.items():
                put(after, state, _append(value, LETTERS["D"], size) + DELETE * unit)
                if not must_go:
                    put(after, NEXT[state], _append(value, LETTERS["R"], size) + (RENAME + CUT * cut) * unit)
                    if (state, initial) in KEEPS:
                        put(after, KEEPS[state, initial], _append(value, LETTERS["K"], size) + CUT * cut * unit)
            now = after
        if final:
            inserted()
        return now, size, begun

    def _close(self) -> None:
        now, size, begun = self._block(False)
        low = 1 << (DIGIT * size + PLACE)
        self.paths = {s: (v // low, self._chain(v, size, begun)) for s, v in sorted(now.items(), key=lambda e: e[1] % low)}
        self.rows = []

    def _chain(self, value: int, size: int, begun: list[int]) -> tuple:
        state = begun[(value >> DIGIT * size) & ((1 << PLACE) - 1)]
        digits = [(value >> DIGIT * at) & ((1 << DIGIT) - 1) for at in range(size - 1, -1, -1)]
        return self.paths[state][1], "".join(NAMES[d] for d in digits if d)

    def result(self) -> tuple[int, str]:
        """(cost, letters) of the whole conversation."""
        now, size, begun = self._block(True)
        best = min(now[s] for s in (START, ASSISTANT) if s in now)
        chain, parts = self._chain(best, size, begun), []
        while chain:
            chain, letters = chain
            parts.append(letters)
        return best >> (DIGIT * size + PLACE), "".join(reversed(parts))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its next rows) batch by batch; a conversation that goes on in the next batch comes again."""
    for batch in batches:
        ids, columns = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            yield ids[at], zip(*(c[at:end] for c in columns), strict=True)
            at = end


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, REPORT and audit of every conversation of ``rows`` (conv_id, turn, role, text, copies): its faults and its cheapest repair."""
    kind = dict(rows.dtypes)["conv_id"]
    end = F.rtrim("text", F.lit(SPACE))
    facts = _keyed(rows).select("conv_id", "turn", "same", "copies", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = facts.where("copies > 0 AND NOT blank").groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    marks = firsts.select("conv_id", "turn", "same", F.lit(None).cast("int").alias("copies"), F.lit("").alias("initial"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(0).alias("kind"))
    ordered = _in_order(facts.withColumn("kind", F.lit(1)).unionByName(marks)).select("conv_id", "turn", "copies", "initial", "blank", "cut")
    names = ["conv_id", *REPORT, "audit"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            cost, letters = repair.result()
            gaps = high - low + 1 - turns if turns else 0
            return pa.RecordBatch.from_arrays([pa.array([conv], pa_type), *(pa.array([x], pa.int64()) for x in (gaps, *counts, cost)), pa.array([letters], pa.string())], names)

        begun, conv, done, pa_type = False, None, [], None
        for batch in batches:
            pa_type = batch.schema.field(0).type
            for own, some in _grouped([batch]):
                if not begun or own != conv:
                    if begun:
                        done.append(ended())
                    begun, conv, repair, counts, before, fresh = True, own, Repair(), [0, 0, 0, 0], None, False
                    low = high = None
                    turns = 0
                for turn, copies, initial, blank, cut in some:
                    if copies is None:  # the next row is the first of its role and text
                        fresh = True
                        continue
                    for _ in range(copies):
                        fault = 0 if blank else 1 if not fresh else 2 if cut else None
                        if fault is not None:
                            counts[fault] += 1
                        counts[3] += before is not None and before + initial not in ("su", "ua", "au")
                        repair.add(initial, fault in (0, 1), fault == 2)
                        before, fresh = initial, False
                    if copies and turn is not None and turn != high:
                        low, high, turns = turn if low is None else low, turn, turns + 1
            if len(done) >= 256:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if begun:
            done.append(ended())
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return ordered.mapInArrow(solve, f"conv_id {kind}, {', '.join(f'{n} long' for n in REPORT)}, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of all conversations after the edits of ``found`` (conv_id, audit), in order
    within each partition; edit says whether a turn was kept, renamed or inserted. No row for conversations that end up empty."""
    kind = dict(rows.dtypes)["conv_id"]
    blank = lambda name, sort: F.lit(None).cast(sort).alias(name)
    letters = found.select("conv_id", blank("turn", "long"), blank("role", "string"), F.col("audit").alias("text"), F.lit(0).alias("copies"), blank("same", "binary"), F.lit(-1).alias("kind"))
    both = _keyed(rows.where("copies > 0")).withColumn("kind", F.lit(1)).unionByName(letters)
    ordered = _in_order(both).select("conv_id", "role", "text", "copies", "kind")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, last = "", 0, START, 0, 0
        for batch in batches:
            out: list[tuple] = []

            def insertions(conv: object) -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    state = NEXT[state]
                    out.append((conv, place, "I", ROLES[state], ""))
                    at, place = at + 1, place + 1

            for conv, some in _grouped([batch]):
                for role, text, copies, mark in some:
                    if mark < 0:  # a conversation's letters stand in front of its rows
                        audit, at, state, place = text, 0, START, 0
                        last = len(audit.rstrip("I"))
                        if not last:
                            insertions(conv)
                    for _ in range(copies):
                        insertions(conv)
                        edit = audit[at]
                        at += 1
                        if edit == "D":
                            pass
                        elif edit == "R":
                            state = NEXT[state]
                            out.append((conv, place, edit, ROLES[state], text))
                        else:
                            state = KEEPS[state, role[:1]]
                            out.append((conv, place, edit, role, text))
                        place += edit != "D"
                        if at == last:
                            insertions(conv)  # after the last row
            if out:
                conv_type = batch.schema.field(0).type
                types = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    return ordered.mapInArrow(apply, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of each conversation; ``turns`` as ``repaired`` gives them, already in order. A digest reads
    its conversation from front to back, so one conversation is one task's work, in constant memory."""
    kind = dict(turns.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, held = False, None, hashlib.sha256()
        for batch in batches:
            out, pa_type = [], batch.schema.field(0).type
            for own, some in _grouped([batch]):
                if not begun or own != conv:
                    if begun:
                        out.append((conv, held.hexdigest()))
                    begun, conv, held, first = True, own, hashlib.sha256(), True
                for (line,) in some:
                    held.update(line.encode() if first else b"\n" + line.encode())
                    first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa_type), pa.array([d for _, d in out])], ["conv_id", "sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa_type), pa.array([held.hexdigest()])], ["conv_id", "sha256"])

    return turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(digest, f"conv_id {kind}, sha256 string")

