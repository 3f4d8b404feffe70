"""Evidence files read in parts: facts of files in a stream, and compressed files as splits.

Spark lists the files; a task opens what it is given with a file system of pyarrow, seeks and reads a
part at a time, so that no file is ever one value.
"""

from __future__ import annotations

import bz2
import hashlib
import io
import lzma
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.session import written

CHUNK = 1 << 20
# First bytes of formats, and marks inside them.
GZIP, BZIP2, XZ, SQLITE = b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"SQLite format 3\x00"
BZIP2_BLOCK, BZIP2_END = 0x314159265359, 0x177245385090


class Damaged(ValueError):
    """A compressed file that does not expand."""


def open_file(path: str) -> BinaryIO:
    """A file by path or address, to seek and read in."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inner = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def list_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(``path``, ``length``) of files, without their content."""
    reader = spark.read.format("binaryFile")
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(paths).select("path", "length")


def file_facts(files: DataFrame) -> DataFrame:
    """(``path``, ``length``, ``head``, ``sha256``) of ``files``: the first 16 bytes, and the digest of a stream; of a file that cannot be read both are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, digests = [], []
            for path in batch.column("path").to_pylist():
                try:
                    with open_file(path) as f:
                        digest, head = hashlib.sha256(), None
                        while part := f.read(CHUNK):
                            head = bytes(part[:16]) if head is None else head
                            digest.update(part)
                    heads.append(head or b"")
                    digests.append(digest.hexdigest())
                except OSError:
                    heads.append(None)
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary()), pa.array(digests, pa.string())], ["path", "length", "head", "sha256"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, head binary, sha256 string")


def _bits_at(data: bytes, mark: int) -> list[int]:
    """Bit positions of a mark of 48 bits, at any bit."""
    out = []
    for shift in range(8):
        seven = (mark << (8 - shift)).to_bytes(7, "big")
        middle, low, high = seven[1:6], (1 << (8 - shift)) - 1, (0xFF << (8 - shift)) & 0xFF
        at = data.find(middle, 1)
        while at >= 0:
            if at + 5 <= len(data) - (shift > 0) and data[at - 1] & low == seven[0] and (not shift or data[at + 5] & high == seven[6]):
                out.append(8 * (at - 1) + shift)
            at = data.find(middle, at + 1)
    return out


def _cut_bits(data: bytes, start: int, end: int) -> tuple[int, int]:
    """Bits ``start`` to ``end`` as a number, and how many they are."""
    first, last = start // 8, -(-end // 8)
    return (int.from_bytes(data[first:last], "big") >> (8 * last - end)) & ((1 << (end - start)) - 1), end - start


def _bzip2_block(data: bytes, start: int, end: int) -> bytes:
    """A block as a stream of its own: its header's checksum is that of the stream."""
    bits, n = _cut_bits(data, start, end)
    check = (bits >> (n - 80)) & 0xFFFFFFFF
    whole = ((int.from_bytes(b"BZh9", "big") << n | bits) << 48 | BZIP2_END) << 32 | check
    size = 32 + n + 80
    return bz2.decompress((whole << (-size % 8)).to_bytes(-(-size // 8), "big"))


def bzip2_pieces(f: BinaryIO, start: int) -> Iterator[tuple[int, bytes]]:
    """(byte at which it begins, text) of each block from ``start`` on. Blocks begin at any bit; a mark that is no end is skipped."""
    f.seek(start)
    base, data, done = start, b"", False
    while not done:
        part = f.read(4 * CHUNK)
        done = not part
        data += part
        marks = sorted([(p, True) for p in _bits_at(data, BZIP2_BLOCK)] + [(p, False) for p in _bits_at(data, BZIP2_END)])
        used, k = 0, 0
        while k < len(marks):
            place, block = marks[k]
            if not block:
                used, k = place + 48, k + 1
                continue
            text, j = None, k + 1
            while text is None and j < len(marks):
                try:
                    text = _bzip2_block(data, place, marks[j][0])
                except (OSError, ValueError):
                    j += 1
            if text is None:
                if done:
                    raise Damaged("bzip2")
                break
            yield base + place // 8, text
            used, k = marks[j][0], j
        keep = used // 8 if marks else max(0, len(data) - 8)
        base, data = base + keep, data[keep:]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def _as_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def xz_blocks(f: BinaryIO, length: int) -> list[tuple[int, int, int, bytes]]:
    """(offset, size, expanded size, flags) of every block, by the indexes at the ends of the streams."""
    out, end = [], length
    while end > 0:
        f.seek(end - 12)
        footer = f.read(12)
        if footer == b"\x00" * 12 or footer[8:] == b"\x00" * 4:
            end -= 4
            continue
        if footer[10:] != b"YZ":
            raise Damaged("xz")
        size, flags = 4 * (struct.unpack("<I", footer[4:8])[0] + 1), footer[8:10]
        f.seek(end - 12 - size)
        index = f.read(size)
        if index[:1] != b"\x00" or struct.unpack("<I", index[-4:])[0] != zlib.crc32(index[:-4]):
            raise Damaged("xz")
        n, at = _varint(index, 1)
        own = []
        for _ in range(n):
            packed, at = _varint(index, at)
            expanded, at = _varint(index, at)
            own.append((packed, expanded))
        offset = end - 12 - size - sum(-(-p // 4) * 4 for p, _ in own)
        end = offset - 12
        stream = []
        for packed, expanded in own:
            stream.append((offset, packed, expanded, flags))
            offset += -(-packed // 4) * 4
        out = stream + out
    return out


def xz_pieces(f: BinaryIO, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the blocks from ``start`` on: each is expanded as a stream of its own, a part at a time."""
    for offset, packed, expanded, flags in xz_blocks(f, length):
        if offset < start:
            continue
        index = b"\x00" + b"\x01" + _as_varint(packed) + _as_varint(expanded)
        index += b"\x00" * (-len(index) % 4)
        index += struct.pack("<I", zlib.crc32(index))
        tail = struct.pack("<I", len(index) // 4 - 1) + flags
        machine, left = lzma.LZMADecompressor(lzma.FORMAT_XZ), -(-packed // 4) * 4
        f.seek(offset)
        fed = XZ + flags + struct.pack("<I", zlib.crc32(flags))
        while True:
            text = machine.decompress(fed, CHUNK)
            if text:
                yield offset, text
            if machine.eof:
                break
            fed = b""
            if machine.needs_input:
                if left < 0:
                    raise Damaged("xz")
                fed = f.read(min(CHUNK, left)) if left else index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"
                if left and not fed:
                    raise Damaged("xz")
                left = left - len(fed) if left else -1


#: Head of a gzip member that names its own size, in bytes that follow.
_SIZED = b"\x1f\x8b\x08\x04"


def _sized(head: bytes) -> int:
    """The size of a gzip member that tells it, else 0."""
    return struct.unpack("<H", head[16:18])[0] + 1 if head[:4] == _SIZED and head[10:16] == b"\x06\x00BC\x02\x00" else 0


def gzip_pieces(f: BinaryIO, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the members from ``start`` on; from a start inside, of members that tell their size."""
    if start:
        f.seek(start)
        data = f.read(2 * 65536 + 18)
        at = data.find(_SIZED)
        while at >= 0 and not (n := _sized(data[at : at + 18])) or at >= 0 and start + at + n < length and data[at + n : at + n + 4] not in (_SIZED, b""):
            at = data.find(_SIZED, at + 1)
        if at < 0:
            return
        start += at
    f.seek(start)
    machine, place, fed, seen = zlib.decompressobj(31), start, b"", start
    while True:
        if not fed:
            fed = f.read(CHUNK)
            seen += len(fed)
            if not fed:
                if not machine.eof and place < length and machine.unconsumed_tail == b"" and seen > place:
                    raise Damaged("gzip")
                return
        text = machine.decompress(fed, CHUNK)
        fed = machine.unconsumed_tail
        if text:
            yield place, text
        if machine.eof:
            fed = machine.unused_data
            place = seen - len(fed)
            if not fed:
                fed = f.read(CHUNK)
                seen += len(fed)
            if not fed or fed.strip(b"\x00") == b"":
                return
            machine = zlib.decompressobj(31)


class Split(NamedTuple):
    """A part of a compressed file: blocks that begin in [start, stop)."""

    format: str
    start: int
    stop: int


def splits(f: BinaryIO, length: int, size: int) -> list[Split]:
    """How a compressed file can be read: bzip2 by ranges of bytes, xz by its blocks, gzip by members where they tell their size, else whole. None for other files."""
    f.seek(0)
    head = f.read(18)
    ranges = [(a, min(a + size, length)) for a in range(0, length, size)]
    if head.startswith(BZIP2):
        return [Split("bzip2", a, b) for a, b in ranges]
    if head.startswith(XZ):
        starts = [b[0] for b in xz_blocks(f, length)]
        cuts = [0, *(a for a, before in zip(starts[1:], starts, strict=False) if a // size != before // size), length]
        return [Split("xz", a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    if head.startswith(GZIP):
        return [Split("gzip", a, b) for a, b in (ranges if _sized(head) else [(0, length)])]
    return []


def pieces(f: BinaryIO, split: Split, length: int) -> Iterator[tuple[int, bytes]]:
    if split.format == "bzip2":
        return bzip2_pieces(f, split.start)
    return xz_pieces(f, split.start, length) if split.format == "xz" else gzip_pieces(f, split.start, length)


def whole_lines(found: Iterator[tuple[int, bytes]], split: Split) -> Iterator[bytes]:
    """The bytes of lines that begin in a split: but for the first one it starts after its first line's end, and it goes on to the first line's end after its own blocks."""
    skip = split.start > 0
    for place, text in found:
        if place >= split.stop:
            if skip:
                return
            end = text.find(b"\n") + 1
            yield text[:end] if end else text
            if end:
                return
        elif skip:
            end = text.find(b"\n") + 1
            if end:
                skip = False
                yield text[end:]
        else:
            yield text


class _Stream(io.RawIOBase):
    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.rest = parts, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.rest = part
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def compressed_lines(spark: SparkSession, paths: str | list[str], size: int = 32 << 20, batch: int = 50_000) -> DataFrame:
    """(``source_path``, ``line_no``, ``raw``, ``problem``) of gzip, bzip2 and xz files, told by their first bytes.

    Files are planned as splits of about ``size`` compressed bytes, which are dealt to tasks: bzip2 by
    blocks, xz by the blocks of its index, gzip by members that tell their size. A gzip file of another
    kind, or an xz file of one block, is one split, expanded a part at a time. Lines are numbered in
    their split and then by the splits before, as the table is written once. A file of another format
    has one row with ``problem`` ``unsupported``; one that does not expand has ``damaged`` after the
    lines that came before. Bad UTF-8 is replaced; ``\\r``, ``\\n`` and both end a line.
    """
    kinds = {"path": pa.string(), "length": pa.int64(), "format": pa.string(), "start": pa.int64(), "stop": pa.int64(), "split": pa.int32()}

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                try:
                    with open_file(row["path"]) as f:
                        own = splits(f, row["length"], size) or [Split("unsupported", 0, row["length"])]
                except (Damaged, OSError, IndexError, struct.error):
                    own = [Split("damaged", 0, row["length"])]
                out += [{**row, "format": s.format, "start": s.start, "stop": s.stop, "split": k} for k, s in enumerate(own)]
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(kinds.items())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.schema([("source_path", pa.string()), ("split", pa.int32()), ("place", pa.int64()), ("raw", pa.string()), ("problem", pa.string())])
        for rows in batches:
            for row in rows.to_pylist():
                problem, at = None if row["format"] in ("bzip2", "xz", "gzip") else row["format"], 0
                some = lambda texts, first, p: pa.RecordBatch.from_pydict({"source_path": [row["path"]] * len(texts), "split": [row["split"]] * len(texts), "place": list(range(first, first + len(texts))), "raw": texts, "problem": [p] * len(texts)}, columns)  # noqa: B023, E731
                held: list[str] = []
                try:
                    if problem is None:
                        with open_file(row["path"]) as f:
                            split = Split(row["format"], row["start"], row["stop"])
                            stream = _Stream(whole_lines(pieces(f, split, row["length"]), split))
                            for line in io.TextIOWrapper(io.BufferedReader(stream, CHUNK), "utf-8", "replace"):
                                held.append(line.removesuffix("\n"))
                                if len(held) >= batch:
                                    yield some(held, at + 1, None)
                                    at, held = at + len(held), []
                except (Damaged, OSError, EOFError, lzma.LZMAError, ValueError, zlib.error, IndexError, struct.error):
                    problem = "damaged"
                if held:
                    yield some(held, at + 1, None)
                if problem:
                    yield some([None], 0, problem)

    planned = list_files(spark, paths).mapInArrow(plan, "path string, length long, format string, start long, stop long, split int")
    # a task for each few splits, whichever file they are of
    dealt = planned.repartition(F.col("path"), F.col("split"))
    own = written(dealt.mapInArrow(read, "source_path string, split int, place long, raw string, problem string"), "lines")
    counts = own.groupBy("source_path", "split").agg(F.count("raw").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").drop("n")
    numbered = own.join(before, ["source_path", "split"], "left")
    return numbered.select("source_path", F.when(F.col("problem").isNull(), F.col("place") + F.coalesce("before", F.lit(0))).otherwise(0).alias("line_no"), "raw", "problem")
