"""Chunks of documents, and counts of keys shared between them.

Some statistics need, for every word pair or byte window of a text, a number from the whole corpus.
A row for each would shuffle many times the text. Instead documents are written once as chunks of a
few MB, one row each; every chunk asks for its distinct keys, packed, by key range; each range is
counted in one group; and the answers return to the chunk in the order of its keys.

A chunk deals its keys into 256 ranges at most. A group holds one range of up to 1024 chunks, about
four chunks' worth of keys; where there are more chunks, it adds its counts up and asks on, 256 finer
ranges a level, until one group has a range of all chunks. Rows and tasks so grow with the number of
chunks, and no group with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import discard, materialise, slices, text_buffers
from emberlog.llm.kernels import pack_keys, unpack_keys

CHUNK_SCHEMA = "chunk long, ids array<long>, flags array<boolean>, sizes array<int>, text binary"
_ASK = "range int, kind int, child long, keys binary, counts binary"
_ANSWER = "chunk long, kind int, range int, counts binary"
#: Keys are dealt by ``FAN_BITS`` bits at each level; chunks, and then groups, that meet at one level.
FAN_BITS, FIRST, NEXT = 8, 1024, 256


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_counts(values: np.ndarray) -> bytes:
    return squeeze(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def chunked(docs: DataFrame, id_col: str, text_col: str, flag: Column | None = None, size: int = 8 << 20) -> DataFrame:
    """Documents as written chunks of about ``size`` bytes of text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = number = 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            raw, sizes = [], []
            for b in waiting:
                data, offsets = text_buffers(b.column("text"))
                raw.append(data.tobytes())
                sizes.append(np.diff(offsets))
            sizes = np.concatenate(sizes).astype(np.int32)
            ids = pa.concat_arrays([b.column("id") for b in waiting])
            flags = pa.concat_arrays([b.column("flag") for b in waiting])
            row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | number], pa.int64()), row(ids), row(flags), row(pa.array(sizes)), pa.array([squeeze(b"".join(raw))], pa.binary())], ["chunk", "ids", "flags", "sizes", "text"])

        for whole in batches:
            for b in slices(whole, "text", size // 4):
                waiting.append(b)
                held += int(text_buffers(b.column("text"))[1][-1])
                if held >= size:
                    yield flush()
                    waiting, held, number = [], 0, number + 1
        if waiting:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).alias("flag"))
    return materialise(rows.mapInArrow(run, CHUNK_SCHEMA), "chunks")


def texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a chunk."""
    return np.frombuffer(expand(row["text"]), np.uint8), np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])


Keys = dict[int, tuple[np.ndarray, np.ndarray]]


def _table(out: list[tuple], names: list[str], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _asks(asked: Keys, child: int, bits: int) -> pa.Table:
    """Sorted distinct keys with their counts, cut by kind and by the first ``bits`` bits of the key."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    out = []
    for kind, (keys, counts) in asked.items():
        cut = np.append(np.searchsorted(keys, edges), len(keys))
        # only ranges that have keys
        full = np.flatnonzero(np.diff(cut))
        out += [(int(r), kind, child, squeeze(pack_keys(keys[cut[r] : cut[r + 1]])), pack_counts(counts[cut[r] : cut[r + 1]])) for r in full.tolist()]
    return _table(out, ["range", "kind", "child", "keys", "counts"], (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))


def _merged(rows: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray, list[dict], list[np.ndarray]]]:
    """Of a group's asks, by kind: distinct keys, sums of counts, the asks, and where each one's keys are."""
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        keys = [unpack_keys(expand(r["keys"])) for r in own]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([unpack_counts(r["counts"]) for r in own]), minlength=len(every)).astype(np.int64)
        out[kind] = every, total, own, np.split(back, np.cumsum([len(k) for k in keys])[:-1])
    return out


def shared_counts(
    chunks: DataFrame,
    keys_of: Callable[[dict], Keys],
    tell: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None,
    extra: Callable[[int, np.ndarray, np.ndarray], list[tuple[int, int, int]]] | None = None,
    fan_bits: int = FAN_BITS,
    first: int = FIRST,
    following: int = NEXT,
) -> DataFrame:
    """For each chunk, kind and range: the corpus counts of the chunk's keys, in their order; a written table.

    ``keys_of`` gives a chunk's sorted distinct keys and their counts by kind. ``tell`` makes what
    chunks are told from the distinct keys and sums of a kind in a range. ``extra`` makes rows (kind,
    range, value) of chunk -1 from them.
    """
    n = max(1, chunks.select("chunk").count())
    blocks = [-(-n // first)]
    while blocks[-1] > 1:
        blocks.append(-(-blocks[-1] // following))
    bits = fan_bits if len(blocks) > 1 else min(fan_bits, range_bits(n))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _asks(keys_of(row), row["chunk"], bits).to_batches()

    def ask_on(level: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: _asks({kind: m[:2] for kind, m in _merged(table.to_pylist()).items()}, table.column("node")[0].as_py(), bits * (level + 1))

    def told(table: pa.Table, merged: dict, values: dict[int, np.ndarray]) -> list[tuple]:
        return [(r["child"], kind, r["range"], pack_counts(values[kind][at])) for kind, (_, _, own, places) in merged.items() for r, at in zip(own, places, strict=True)]

    def answer(table: pa.Table) -> pa.Table:
        merged = _merged(table.to_pylist())
        out = told(table, merged, {kind: m[1] if tell is None else tell(kind, m[0], m[1]) for kind, m in merged.items()})
        for kind, m in merged.items() if extra is not None else ():
            out += [(-1, k, r, pack_counts(np.array([v]))) for k, r, v in extra(kind, m[0], m[1])]
        return _table(out, ["chunk", "kind", "range", "counts"], (pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    def pass_down(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = told(table, _merged(table.to_pylist()), in_key_order(answers)) if table.num_rows else []
        return _table(out, ["chunk", "kind", "range", "counts"], (pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    def dealt(asked: DataFrame, origin: Column, count: int) -> DataFrame:
        return asked.withColumn("node", F.shiftleft(F.pmod(F.xxhash64(origin), F.lit(count)), 32) + F.col("range"))

    levels = [dealt(chunks.mapInArrow(ask, _ASK), F.col("child"), blocks[0])]
    for level, count in enumerate(blocks[1:], 1):
        levels[-1] = materialise(levels[-1], "asks")
        levels.append(dealt(levels[-1].groupBy("node").applyInArrow(ask_on(level), _ASK), F.shiftright("child", 32), count))
    out = materialise(levels[-1].groupBy("node").applyInArrow(answer, _ANSWER), "counts")
    for below in reversed(levels[:-1]):
        own = out.where("chunk >= 0").withColumnRenamed("chunk", "node")
        down = below.groupBy("node").cogroup(own.groupBy("node")).applyInArrow(pass_down, _ANSWER)
        lower = materialise(down.unionByName(out.where("chunk < 0")), "counts")
        discard(out, below)
        out = lower
    return out


def in_key_order(answers: pa.Table) -> dict[int, np.ndarray]:
    """The answers of one chunk by kind, in the order of its sorted keys."""
    rows = sorted(answers.select(["kind", "range", "counts"]).to_pylist(), key=lambda r: (r["kind"], r["range"]))
    kinds = {r["kind"] for r in rows}
    return {k: np.concatenate([unpack_counts(r["counts"]) for r in rows if r["kind"] == k]) for k in kinds}


def range_bits(chunks: int, per_range: int = 4) -> int:
    """Bits for about one key range per ``per_range`` chunks."""
    return max(2, (chunks // per_range).bit_length())
