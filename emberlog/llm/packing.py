"""Packing tokenised documents into sequences of a fixed length, best two-fit."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import materialise

#: Marks that are tokens apart after a letter.
_MARKS = ".,;:!?"


#: Bytes of each of the two stores of known parts in a worker.
STORE_BYTES = 144 << 20


@functools.cache
def _ids(tokenizer_file: str, most_bytes: int) -> _Ids:
    """The parts that this worker knows, kept from one task to the next."""
    return _Ids(tokenizer_file, most_bytes)


class _Ids(dict):
    """Ids, as little-endian bytes, of the parts of texts between white space.

    Two stores of bounded size: when this one is full it becomes the old one, from which parts that
    are seen again come back, so that frequent parts are tokenised once.
    """

    def __init__(self, tokenizer_file: str, most_bytes: int = STORE_BYTES) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.most_bytes, self.held, self.old = Tokenizer.from_file(tokenizer_file), most_bytes, 0, {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._mixed(list(_MARKS))
        self.marks = dict(self)

    def learn(self, parts: set[str]) -> None:
        """Tokenise parts that are not known yet, many in one call; a mark at the end and upper-case ASCII make no part of their own."""
        if self.held > self.most_bytes:
            self.old, self.held = dict(self), 0
            self.clear()
            self.update(self.marks)
        old, fresh, before = self.old, [], len(self)
        for part in [p for p in parts if p not in self]:
            known = old.get(part)
            if known is None:
                fresh.append(part)
            else:
                self[part] = known
        composed, cores = [], set()
        for part in fresh:
            if part.isalpha() and (part.islower() or not part.isascii()):
                cores.add(part)
                continue
            # the mark after the last letter, unless that letter ends in a mark of its own in lower case
            core, tail = (part[:-1], part[-1]) if part[-1] in _MARKS and len(part) > 1 and part[-2].lower()[-1].isalpha() else (part, "")
            if core.isascii():
                core = core.lower()
            if core not in self:
                cores.add(core)
            if core != part:
                composed.append((part, core, tail))
        words, mixed = [], []
        for core in cores:
            known = old.get(core)
            if known is not None:
                self[core] = known
            elif core.isalpha() and (core.isascii() or core.lower().isalpha()):
                words.append(core)
            else:
                mixed.append(core)
        self._words(words)
        self._mixed(mixed)
        for part, core, tail in composed:
            self[part] = self[core] + self[tail]
        self.held += 200 * (len(self) - before) + 5 * sum(map(len, fresh))

    def _words(self, words: list[str]) -> None:
        """Parts of letters alone are one token run each, which ends with a word end."""
        for a in range(0, len(words), 5000):
            some = words[a : a + 5000]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                self._cut(some, ids, ends)
            else:
                self._mixed(some)

    def _mixed(self, parts: list[str]) -> None:
        for a in range(0, len(parts), 5000):
            some = parts[a : a + 5000]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            # ids of one part stand together, in the order of the parts
            self._cut(some, np.asarray(got.ids, dtype="<u4"), np.cumsum(np.bincount(np.asarray(got.word_ids, dtype=np.int64), minlength=len(some))))

    def _cut(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, start = ids.tobytes(), 0
        for part, end in zip(parts, (4 * ends).tolist(), strict=True):
            self[part] = raw[start:end]
            start = end

    def of(self, parts: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, parts))


def _parts(text: str | None) -> list[str]:
    return (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int = 1, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", store_bytes: int = STORE_BYTES, keep_store: bool = True) -> DataFrame:
    """Per piece: id, ``piece`` (from 0), ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit ids) and ``total``, its document's ids.

    The tokenizer must treat white space as a boundary, as word-level BPE does, so that the parts
    between are looked up once and kept; the store of parts is bounded by ``store_bytes`` and
    stays with the worker for its later tasks, or goes with each task without ``keep_store``. Null text is empty and gives
    one piece with the end id alone. Texts are never cut before they are tokenised. Other columns
    are ignored; an empty table gives no rows; a repeated row gives its pieces again.
    """
    if length < 1:
        raise ValueError("length must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = (_ids if keep_store else _Ids)(tokenizer_file, store_bytes), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids_of, piece, start, size, ids, total, waiting = [], [], [], [], [], [], 0
            keys = batch.column("id")

            def flush():
                return pa.RecordBatch.from_arrays([keys.take(pa.array(ids_of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["id", "piece", "start", "length", "ids", "total"])

            for first in range(0, batch.num_rows, 256):
                texts = [_parts(t) for t in batch.column("text").slice(first, 256).to_pylist()]
                new = set().union(*texts)
                known.learn(new)
                for row, parts in enumerate(texts, first):
                    whole = known.of(parts) + end
                    for k, at in enumerate(range(0, len(whole), 4 * length)):
                        cut = whole[at : at + 4 * length]
                        ids_of.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        size.append(len(cut) // 4)
                        ids.append(cut)
                        total.append(len(whole) // 4)
                    waiting += len(whole)
                    if waiting > 8 << 20:
                        yield flush()
                        ids_of, piece, start, size, ids, total, waiting = [], [], [], [], [], [], 0
            if ids_of:
                yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary, total long").withColumnRenamed("id", id_col)


def bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best two-fit over a count per length: bins as (how many alike, [(length, how many in each)]).

    Each kind of bin is filled greedily, the longest that fits first. Then its smallest document
    goes if two unpacked ones fill the gap it leaves more tightly; it is packed later. A kind is
    repeated until one of its lengths runs out, so the work depends on ``capacity``, not on the
    number of documents.
    """
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        own: dict[int, int] = {}
        lengths, gap = np.flatnonzero(left), capacity
        at = len(lengths) - 1
        while (at := min(at, int(np.searchsorted(lengths, gap, "right")) - 1)) >= 0 and gap > 0:
            size = int(lengths[at])
            n = int(min(left[size], gap // size))
            own[size], gap, at = n, gap - n * size, at - 1
        if gap > 0:
            small = min(own)
            rest = left.copy()
            for size, n in own.items():
                rest[size] -= n
            free, room = np.flatnonzero(rest), gap + small
            a = free[free < room]
            if len(a):
                b = np.searchsorted(free, room - a, "right") - 1
                b = np.where((b >= 0) & (free[b] == a) & (rest[a] < 2), b - 1, b)
                both = np.where(b >= 0, a + free[b], 0)
                best = int(np.argmax(both))
                if both[best] > small:
                    own[small] -= 1
                    for size in (int(a[best]), int(free[b[best]])):
                        own[size] = own.get(size, 0) + 1
                    own = {size: n for size, n in own.items() if n}
        times = min(int(left[size]) // n for size, n in own.items())
        for size, n in own.items():
            left[size] -= times * n
        out.append((times, sorted(own.items(), reverse=True)))
    return out


def numbered(pieces: DataFrame, length: str, order: list[str], counts: np.ndarray, bucket_rows: int = 256) -> DataFrame:
    """``pieces`` with ``place``: the number of each among those of its length, from 0 and without gaps.

    Rows of one length are ordered within hashed buckets of about ``bucket_rows``; the rows before a
    bucket are summed within groups of 256 buckets first, and then over the groups, so a length that
    a third of all rows share is spread over many tasks. ``counts`` has the rows of each length.
    """
    spark = pieces.sparkSession
    buckets = spark.createDataFrame([(int(k), int(-(-counts[k] // bucket_rows))) for k in np.flatnonzero(counts)] or [(1, 1)], f"{length} long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), length).withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("buckets")
    inside = dealt.withColumn("place", F.row_number().over(Window.partitionBy(length, "bucket").orderBy(*order)) - 1)
    each = dealt.groupBy(length, "bucket").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("bucket") / 256))
    earlier = lambda *keys: Window.partitionBy(length, *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upper = each.groupBy(length, "upper").agg(F.sum("n").alias("n")).select(length, "upper", F.coalesce(F.sum("n").over(earlier("upper")), F.lit(0)).alias("first"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(earlier("upper", "bucket")), F.lit(0)))
    if int(counts.max(initial=0)) > 256 * bucket_rows:
        before = before.join(upper, [length, "upper"]).withColumn("before", F.col("before") + F.col("first"))
    return inside.join(before.select(length, "bucket", "before"), [length, "bucket"]).withColumn("place", F.col("place") + F.col("before")).select(*pieces.columns, "place")


def pack(pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id", bucket_rows: int = 256) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``: places without gaps from 0.

    Only the number of pieces of each length, ``capacity`` numbers at most, reaches the driver; the
    bins it answers with are as bounded. Pieces of one length are numbered by hashed buckets of
    about ``bucket_rows``, so a length that a third of all rows share is spread over many tasks, and
    each takes the place of its number. ``pieces`` is read twice; give a written table.

    Null ids are ids like others, and repeated rows are packed each. Other columns may have any
    names; those called ``sequence_id`` or ``offset`` are replaced. An empty table gives no rows. A
    length that is null, below 1 or above ``capacity`` is an error.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    own_id, piece, length = inner[id_col], inner["piece"], inner["length"]
    pieces = pieces.select(*(F.col(f"`{c}`").alias(inner[c]) for c in names))
    counted = pieces.groupBy(length).agg(F.count("*").alias("n")).limit(capacity + 2).collect()
    if any(r[length] is None or not 1 <= r[length] <= capacity for r in counted):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted:
        counts[r[length]] = r["n"]
    used, base, table = np.zeros(capacity + 1, np.int64), 0, []
    for times, own in bins(counts, capacity):
        offset = 0
        for size, n in own:
            table.append(((size << 44) + used[size], n, base, offset))
            used[size] += times * n
            offset += n * size
        base += times
    table.sort()
    slots = np.array(table, dtype=np.int64).reshape(-1, 4)
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(slots)

    ranked = numbered(pieces, length, [own_id, piece], counts, bucket_rows)
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
            key = (size << 44) + number
            at = np.searchsorted(own[:, 0], key, "right") - 1
            into = key - own[at, 0]
            each = own[at, 1]
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(own[at, 2] + into // each), pa.array(own[at, 3] + into % each * size)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    return packed.select(*(F.col(inner[c]).alias(c) for c in names), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, length: int = 4096, end_id: int = 1, store_bytes: int = STORE_BYTES, keep_store: bool = True) -> DataFrame:
    """Tokenise, digest each piece's ids, write that small table, and pack it."""
    pieces = tokenise(docs, tokenizer_file, end_id, length, store_bytes=store_bytes, keep_store=keep_store)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialise(digests, "pieces"), length)
