"""Cheapest repairs of conversations: delete, keep, rename or insert turns until roles alternate.

A weight is one integer: its high digits are the cost, its low digits the letters of the edits, first
letter first, with zeros at the end. An integer minimum over the graph of (turn, state) so settles cost
and ties at once: of equal costs the letters that come first in ASCII win.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialise

DELETE, INSERT, RENAME, CUT_OFF = 4, 3, 3, 3
#: Octal digits of the letters, in ASCII order.
_DIGITS = str.maketrans("DIKR", "1234")
_LETTERS = str.maketrans("1234", "DIKR")
#: States: nothing yet, after a system turn, after a user, after an assistant. The next user or assistant leads to:
_NEXT = (2, 2, 3, 2)
_ACCEPTED = (0, 3)
#: A turn in a byte: its role's initial (s, u, a, other), and its fault (0 none).
INITIALS = "sua"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _kept(state: int, initial: int) -> int | None:
    """The state after a turn that is kept as it is."""
    if initial == 0:
        return 1 if state == 0 else None
    return _NEXT[state] if initial == _NEXT[state] - 1 else None


def cheapest(codes: bytes, block: int = 64) -> tuple[int, str]:
    """Cost and letters of the best edits of turns: ``code`` is initial + 4 * fault.

    The minimum runs backwards, so a letter goes before the others and moves their digits down by one.
    After each ``block`` of turns, letters that all states share are put aside but for the first four:
    two ways through the same turns differ in inserts alone where one is the other's start, there are at
    most two inserts in a row, so the letters that follow decide within three. Integers stay short so.
    """
    values: list[int | None] = [0 if s in _ACCEPTED else None for s in range(4)]
    origin, marks, aside, guard, width = list(range(4)), [""] * 4, [], "", 0

    def before(letter: int, cost: int, value: int | None) -> int | None:
        if value is None:
            return None
        low = value & ((1 << 3 * width) - 1)
        return ((value >> 3 * width) + cost << 3 * width) | letter << 3 * (width - 1) | low >> 3

    def least(ways: Iterator[tuple[int | None, int]]) -> tuple[int | None, int]:
        return min((w for w in ways if w[0] is not None), default=(None, 0))

    def inserts(own: list[tuple[int | None, int]]) -> list[tuple[int | None, int]]:
        for _ in range(2):
            own = [least(iter((own[s], (before(2, INSERT, own[_NEXT[s]][0]), own[_NEXT[s]][1])))) for s in range(4)]
        return own

    def letters(value: int) -> str:
        low = value & ((1 << 3 * width) - 1)
        return format(low, f"0{width}o").rstrip("0") if width and low else ""

    for end in range(len(codes), -1, -block):
        some = codes[max(0, end - block) : end]
        more = 3 * len(some) + 4
        values, width = [None if v is None else v << 3 * more for v in values], width + more
        if end == len(codes):
            values, origin = map(list, zip(*inserts(list(zip(values, origin, strict=True))), strict=True))
        for code in reversed(some):
            initial, fault = code & 3, code >> 2
            extra = CUT_OFF if fault == TRUNCATED else 0
            own = []
            for s in range(4):
                ways = [(before(1, DELETE, values[s]), origin[s])]
                if fault not in (BLANK, DUPLICATE):
                    to = _kept(s, initial)
                    if to is not None:
                        ways.append((before(3, extra, values[to]), origin[to]))
                    ways.append((before(4, RENAME + extra, values[_NEXT[s]]), origin[_NEXT[s]]))
                own.append(least(iter(ways)))
            values, origin = map(list, zip(*inserts(own), strict=True))
        shared = {o for v, o in zip(values, origin, strict=True) if v is not None}
        if len(shared) == 1 and len(codes) > block:
            mark = marks[shared.pop()]
            costs = [None if v is None else v >> 3 * width for v in values]
            texts = [None if v is None else letters(v)[: len(letters(v)) - len(mark)] + mark[:4] for v in values]
            aside.append(mark[: len(mark) - len(guard)])
            guard, width = mark[:4], max(len(t) for t in texts if t is not None)
            marks = ["" if t is None else t for t in texts]
            values = [None if t is None else (c << 3 * width) | int(t.ljust(width, "0") or "0", 8) for c, t in zip(costs, texts, strict=True)]
            origin = list(range(4))
    found = letters(values[0])
    whole = found[: len(found) - len(guard)] + "".join(reversed(aside))
    return values[0] >> 3 * width, whole.translate(_LETTERS)


def edited(letters: str, turns: list[tuple[str, str]], done: int, system: bool) -> list[tuple[str, str]]:
    """Repaired turns: ``done`` are there before, the first of them a system turn if ``system``."""
    out, rows = [], iter(turns)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter != "D":
            named = ("user", "assistant")[(done + len(out) - system) % 2]
            out.append((role if letter == "K" else named, text))
    return out


def starts_with_system(letters: str, codes: bytes) -> bool:
    """Whether the first turn that stays is a system turn."""
    deleted = len(letters) - len(letters.lstrip("D"))
    return letters[deleted : deleted + 1] == "K" and codes[deleted] & 3 == 0


def _faults(blank: list[bool], cut: list[bool], digests: list[bytes], seen: set[bytes]) -> list[int]:
    out = []
    for empty, open_end, digest in zip(blank, cut, digests, strict=True):
        out.append(BLANK if empty else DUPLICATE if digest in seen else TRUNCATED if open_end else 0)
        seen.add(digest)
    return out


_TURNS = "array<struct<role:string,text:string>>"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _report(codes: bytes, spans: list[tuple[int, int, int]]) -> dict:
    """Counts, cost and letters of a conversation; ``spans`` has (first, last, distinct) turn numbers, in order."""
    cost, audit = cheapest(codes)
    faults, initials = [c >> 2 for c in codes], [c & 3 for c in codes]
    distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    legal = {(0, 1), (1, 2), (2, 1)}
    return {
        "gaps": spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(p not in legal for p in zip(initials, initials[1:])), "cost": cost, "audit": audit,
    }


class Repaired(NamedTuple):
    """``reports``: one row a conversation. ``turns``: (``conv_id``, ``part``, ``segment``, ``whole``, ``turns``), the repaired turns in order of part and segment; ``whole`` says that there is one segment."""

    reports: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, segment_rows: int = 1024, segment_bytes: int = 4 << 20) -> Repaired:
    """Repair conversations (``conv_id``, ``turn``, ``role``, ``text``, and ``gone`` rows that only name a conversation).

    Turns are sorted by range of (conversation, turn), so a conversation that is longer than others is
    spread over tasks. One that begins and ends within a task is repaired there; others, two a task and
    all that are longer than a segment, leave segments. Of these the decision sees a byte and a digest
    for each turn, and each segment is edited by its letters.

    Null turn numbers come first; rows of one turn go by the MD5 of role and text. Null conv_id is a
    conversation. A conversation without rows has zeros and no turns. Null role and text are one space.
    Columns of other names are ignored; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = F.coalesce(F.col("gone"), F.lit(False))
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), F.greatest("copies", F.lit(1)).alias("copies"))
    plain = plain.withColumns({
        "digest": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "initial": F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1,
    })
    plain = plain.withColumn("initial", F.when((F.col("initial") >= 0) & (F.length("role") > 0), F.col("initial")).otherwise(3))
    order = ["conv_id", "turn", "digest"]
    schema = f"conv_id long, part int, segment int, closed boolean, codes binary, digests binary, blanks binary, spans array<long>, {_REPORT}, turns {_TURNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, held = TaskContext.get().partitionId(), [], 0
        own: list[dict] = []
        at, size, segment, fresh, first = None, 0, 0, True, True

        def flush(last: bool) -> None:
            nonlocal own, size, segment, fresh, held
            stay = [r for r in own if not r["gone"] for _ in range(r["copies"])]
            numbers = [r["turn"] for r in stay if r["turn"] is not None]
            span = (min(numbers), max(numbers), len(set(numbers))) if numbers else None
            turns = [(r["role"], r["text"]) for r in stay]
            digests = [r["digest"] for r in stay]
            row = dict.fromkeys(names) | {"conv_id": at, "part": part, "segment": segment}
            if fresh and not first and not last:
                faults = _faults([r["blank"] for r in stay], [r["cut"] for r in stay], digests, set())
                codes = bytes(r["initial"] | f << 2 for r, f in zip(stay, faults, strict=True))
                row |= _report(codes, [span] if span else []) | {"closed": True}
                turns = edited(row["audit"], turns, 0, starts_with_system(row["audit"], codes))
            else:
                row |= {"closed": False, "codes": bytes(r["initial"] for r in stay), "digests": b"".join(digests), "blanks": bytes(r["blank"] | r["cut"] << 1 for r in stay), "spans": list(span) if span else None}
            out.append(row | {"turns": [{"role": a, "text": b} for a, b in turns]})
            held += size + 200
            own, size, segment, fresh = [], 0, segment + 1, False

        for batch in batches:
            for r in batch.to_pylist():
                if own and r["conv_id"] != at:
                    flush(False)
                    fresh, first = True, False
                elif len(own) >= segment_rows or size > segment_bytes:
                    flush(True)
                at = r["conv_id"]
                own.append(r)
                size += len(r["text"] or "") + 100
                if held > 8 << 20:
                    yield table(out)
                    out, held = [], 0
        if own:
            flush(True)
        if out:
            yield table(out)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 6, pa.string(), _TURN_TYPE]
    names = ["conv_id", "part", "segment", "closed", "codes", "digests", "blanks", "spans", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
    table = lambda out: pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, kinds, strict=True))))

    done = materialise(plain.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "repaired")
    reports = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    apart = done.where("not closed")
    decided = materialise(apart.select("conv_id", "part", "segment", "codes", "digests", "blanks", "spans").groupBy("conv_id").applyInArrow(_decide, f"conv_id long, part int, segment int, letters string, done long, system boolean, {_REPORT}"), "decided")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                turns = edited(r["letters"], [(t["role"], t["text"]) for t in r["turns"]], r["done"], r["system"])
                row = {c: r[c] for c in ("conv_id", "part", "segment")} | {"turns": [{"role": a, "text": b} for a, b in turns]}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("turns", _TURN_TYPE)]))

    letters = decided.where("part is not null").select("part", "segment", "letters", "done", "system")
    joined = apart.select("conv_id", "part", "segment", "turns").join(letters, ["part", "segment"])
    turns = done.where("closed").select("conv_id", "part", "segment", F.col("closed").alias("whole"), "turns").unionByName(joined.mapInArrow(edit, f"conv_id long, part int, segment int, turns {_TURNS}").withColumn("whole", F.lit(False)))
    return Repaired(done.where("closed").select(*reports).unionByName(decided.where("part is null").select(*reports)), turns)


def _decide(table: pa.Table) -> pa.Table:
    """One conversation from its segments: its report, and the letters of each segment. Inserts go with the turn after them."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["segment"]))
    seen: set[bytes] = set()
    codes = []
    for r in rows:
        digests = [r["digests"][k : k + 16] for k in range(0, len(r["digests"]), 16)]
        faults = _faults([bool(b & 1) for b in r["blanks"]], [bool(b & 2) for b in r["blanks"]], digests, seen)
        codes.append(bytes(c | f << 2 for c, f in zip(r["codes"], faults, strict=True)))
    whole = b"".join(codes)
    report = _report(whole, [tuple(r["spans"]) for r in rows if r["spans"]])
    audit, at, done = report["audit"], 0, 0
    system = starts_with_system(audit, whole)
    base = {"conv_id": rows[0]["conv_id"], "part": None, "segment": None, "letters": None, "done": None, "system": None} | report
    out = [base]
    for r, own in zip(rows, codes, strict=True):
        end, turns = at, 0
        while turns < len(own):
            turns += audit[end] != "I"
            end += 1
        if r is rows[-1]:
            end = len(audit)
        letters = audit[at:end]
        out.append(dict.fromkeys(base) | {"conv_id": r["conv_id"], "part": r["part"], "segment": r["segment"], "letters": letters, "done": done, "system": system})
        done += len(letters) - letters.count("D")
        at = end
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
    return pa.Table.from_pylist(out, pa.schema(list(zip(base, kinds, strict=True))))


def damaged(rows: DataFrame) -> DataFrame:
    """Damage rows by ``crc32(conv_id:turn) % 20``: 0 drops (``gone``), 1 empties, 2 removes ``[.!?]``, 3 repeats (``copies``), 4 makes a user's. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def joined(turns: Column) -> Column:
    """``role:text`` of repaired turns, newline-joined; null for none."""
    return F.when(F.size(turns) > 0, F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
