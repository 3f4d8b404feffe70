"""Packing tokenised documents into sequences by minimum bin slack, with free cuts.

A sequence is padded to the capacity unless its length is a power of two. Each window takes the
longest piece left and the multiset of other lengths that comes closest to the rest of the capacity,
found by subset sums on a bitset. If no multiset fills it, one more piece is cut to fill the gap; the
last pieces are cut into windows whose lengths are powers of two. So nothing is padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import key_bitmap, materialise, may_contain
from emberlog.llm.packing import numbered, tokenise

#: Bits of a piece's number among those of its length.
_NUMBER = 40


def closest(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, none used more often than it is there, whose sum is the largest up to ``target``.

    Bit k of ``reach`` says that k is a sum. Lengths join from the longest down, each as 1, 2, 4, ...
    copies, until the target is reached; the bitsets before each of them tell the counts backwards.
    """
    reach, mask, steps = 1, (2 << target) - 1, []
    for size in sorted((s for s, n in counts.items() if n > 0 and s <= target), reverse=True):
        left, copies = min(counts[size], target // size), 1
        while left and not reach >> target:
            copies = min(copies, left)
            steps.append((size, copies, reach))
            reach = (reach | reach << size * copies) & mask
            left, copies = left - copies, 2 * copies
        if reach >> target:
            break
    total, chosen = reach.bit_length() - 1, {}
    for size, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + copies
            total -= size * copies
    return chosen


class _Plan:
    """Places for all pieces of each length, by number: a row holds for a run of numbers.

    Rows are (part, length, first number, end, start in the piece, tokens, first sequence, how many
    to a sequence, offset, numbers before). A piece that is cut has a row for each of its parts,
    counted from 0. Lots are runs of pieces, or of what is left of them, of one length.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.lots = {int(s): deque([(int(s), 0, int(counts[s]), 0, 0)]) for s in np.flatnonzero(counts)}
        self.left = {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0

    def take(self, size: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Lots of ``n`` pieces of a length."""
        self.left[size] -= n
        own = self.lots[size]
        while n:
            length, first, many, start, part = own.popleft()
            if many > n:
                own.appendleft((length, first + n, many - n, start, part))
                many = n
            n -= many
            yield length, first, many, start, part
        if not self.left[size]:
            del self.left[size], self.lots[size]

    def put(self, size: int, lot: tuple[int, int, int, int, int]) -> None:
        self.lots.setdefault(size, deque()).append(lot)
        self.left[size] = self.left.get(size, 0) + lot[2]

    def place(self, size: int, tokens: int, times: int, each: int, offset: int) -> None:
        """Give ``times`` sequences ``each`` pieces of a length from ``offset`` on, or their first ``tokens``."""
        before = 0
        for length, first, many, start, part in self.take(size, times * each):
            self.rows.append((part, length, first, first + many, start, tokens, self.sequences, each, offset, before))
            before += many
            if tokens < size:
                self.put(size - tokens, (length, first, many, start + tokens, part + 1))

    def tail(self) -> None:
        """The last pieces, less than a window, in sequences whose lengths are powers of two."""
        total = sum(s * n for s, n in self.left.items())
        for bit in reversed(range(total.bit_length())):
            room = total & 1 << bit
            offset = 0
            while offset < room:
                size = max((s for s in self.left if s <= room - offset), default=max(self.left))
                tokens = min(size, room - offset)
                self.place(size, tokens, 1, 1, offset)
                offset += tokens
            self.sequences += bool(room)


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of ``_Plan`` for all pieces, by part, length and number.

    A window is repeated until one of its lengths runs out, so the work depends on the number of
    lengths, not on that of documents.
    """
    out = _Plan(counts)
    while out.left:
        largest = max(out.left)
        rest = dict(out.left)
        rest[largest] -= 1
        window = closest(rest, capacity - largest)
        window[largest] = window.get(largest, 0) + 1
        gap = capacity - sum(s * n for s, n in window.items())
        need = dict(window)
        if gap:
            # all that is left over is longer than the gap
            spare = max((s for s, n in out.left.items() if n > window.get(s, 0)), default=0)
            if not spare:
                out.tail()
                break
            need[spare] = need.get(spare, 0) + 1
        times, offset = min(out.left[s] // n for s, n in need.items()), 0
        for size in sorted(window, reverse=True):
            out.place(size, size, times, window[size], offset)
            offset += size * window[size]
        if gap:
            out.place(spare, gap, times, 1, offset)
        out.sequences += times
    return np.array(sorted(out.rows), dtype=np.int64).reshape(-1, 10)


def _parts(rows: np.ndarray, length: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per part of the pieces: their places in the batch, start, tokens, sequence and offset, and whether they are cut."""
    key = (rows[:, 0] << 13 | rows[:, 1]) << _NUMBER | rows[:, 2]
    every, part = np.arange(len(length)), 0
    while len(every):
        at = np.searchsorted(key, (part << 13 | length[every]) << _NUMBER | number[every], "right") - 1
        own = rows[np.maximum(at, 0)]
        found = (at >= 0) & (own[:, 0] == part) & (own[:, 1] == length[every]) & (number[every] < own[:, 3])
        every, own = every[found], own[found]
        place = own[:, 9] + number[every] - own[:, 2]
        yield every, own[:, 4], own[:, 5], own[:, 6] + place // own[:, 7], own[:, 8] + place % own[:, 7] * own[:, 5], own[:, 5] < length[every]
        part += 1


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Of ``pieces`` (``row``, ``piece``, ``length``): row, piece, ``part_start``, ``part_length``, ``sequence_id``, ``offset``, ``cut``.

    (``row``, ``piece``) is a unique key, lengths are from 1 to ``capacity``, 4096 at most. Whole
    sequences need no plan; for others the number of pieces of each length reaches the driver, and
    rows for runs of numbers go back. ``pieces`` is read three times; give a written table. An empty
    table gives no rows.
    """
    if not 0 < capacity <= 4096 or capacity & capacity - 1:
        raise ValueError("the capacity must be a power of two up to 4096")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 1).collect():
        counts[r["length"]] = r["n"]
    shared = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    ranked = numbered(pieces.where(F.col("length") < capacity).select("row", "piece", "length"), "length", ["row", "piece"], counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "place"))
            for at, *values in _parts(shared.value, length, number):
                if len(at):
                    keys = [batch.column(c).take(pa.array(at)) for c in ("row", "piece")]
                    yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, values)], ["row", "piece", "part_start", "part_length", "sequence_id", "offset", "cut"])

    placed = ranked.mapInArrow(place, "row long, piece int, part_start long, part_length long, sequence_id long, offset long, cut boolean")
    whole = pieces.where(F.col("length") == capacity).select("row", "piece", F.lit(0).cast("long").alias("part_start"), F.col("length").alias("part_length"), (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("cut"))
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document longer than ``capacity`` fills whole sequences first; its remainder is packed with the
    others. ``ids`` of remainders are written, and read again only for those that the plan cuts.
    Null text is empty: one piece with the end id. Null and repeated ids are ids like others, and
    repeated rows are packed each. Other columns are ignored, whatever their names; an empty table
    gives no rows; very long texts are tokenised whole.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), F.col("text"))
    pieces = tokenise(rows, tokenizer_file, end_id, capacity, id_col="key")
    remainder = F.when(F.col("length") < capacity, F.col("ids"))
    known = materialise(pieces.select("key.id", "key.row", "piece", "start", "length", "total", F.crc32("ids").alias("crc"), remainder.alias("ids")), "pieces")
    placed = materialise(pack(known, capacity), "placed")

    columns = (F.col("id").alias(id_col), (F.col("start") + F.col("part_start")).alias("start"), F.col("part_length").alias("length"))
    places = (F.col("total").alias("doc_tokens"), "sequence_id", "offset")
    kept = known.drop("ids").join(placed.where("not cut"), ["row", "piece"]).where("part_length = length").select(*columns, F.col("crc").alias("ids_crc32"), *places)
    cuts = placed.where("cut")
    if cuts.isEmpty():
        return kept
    bytes_of = F.expr("substring(ids, int(4 * part_start) + 1, int(4 * part_length))")
    texts = may_contain(known.where(F.col("length") < capacity), "row", key_bitmap(cuts.select("row").distinct(), "row"))
    parts = texts.join(cuts, ["row", "piece"]).select(*columns, F.crc32(bytes_of).alias("ids_crc32"), *places)
    return kept.unionByName(parts)
