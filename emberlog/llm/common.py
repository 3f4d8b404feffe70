"""Shared pieces: the scratch folder, written intermediate tables, key bitmaps, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import shared_folder

#: Logarithms of the least and the most bits of a key bitmap: 32 KB and 16 MB.
LEAST_BITS, MOST_BITS = 18, 27
#: Folders of the tables that this driver has written and not removed by ``discard_since``.
_FOLDERS: list[str] = []
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a temporary one only where none is set and all is one process."""
    return shared_folder(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later stages restart from there when an executor is lost.

    The shuffle files of the write are of no use once it has ended, so Spark removes them then.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/emberlog-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    _FOLDERS.append(folder)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """A mark for ``discard_since``."""
    return len(_FOLDERS)


def discard_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Remove all tables written since a mark but ``kept``: nothing may read the others any more."""
    used = {file for table in kept for file in table.inputFiles()[:1]}
    for folder in _FOLDERS[mark:]:
        if not any(folder.rsplit("/", 1)[1] in file for file in used):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _FOLDERS.remove(folder)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            _FOLDERS[:] = [f for f in _FOLDERS if not f.endswith("/" + folder.getName())]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Bitmap(NamedTuple):
    """A bitmap of hashed keys as a table, 4 KB a row, and the logarithm of its number of bits."""

    table: DataFrame
    bits: int


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1


def key_bitmap(keys: DataFrame, column: str, written: bool = False) -> Bitmap:
    """A bitmap of keys with 32 bits or more for each, but of ``MOST_BITS`` at most, so that it can always be broadcast. ``written`` says that ``keys`` is a written table, which need not be written again."""
    own = keys.select(F.col(column).alias("key"))
    own = own if written else materialise(own, "keys")
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * own.count()).bit_length()))
    bit = own.select(_bit(F.col("key"), bits).alias("bit"))
    return Bitmap(bit.groupBy(F.bitmap_bucket_number("bit").alias("bm_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bm")), bits)


def _probed(df: DataFrame, key: str, bitmap: Bitmap, how: str) -> tuple[DataFrame, Column]:
    """``df`` joined with the bitmap's rows, and the bit of each key."""
    bit = _bit(F.col(key), bitmap.bits)
    probed = df.withColumn("bm_bucket", F.bitmap_bucket_number(bit)).withColumn("bm_pos", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.expr("substring(bm, int(bm_pos div 8) + 1, 1)")), 16, 10).cast("int")
    return probed.join(F.broadcast(bitmap.table), "bm_bucket", how), F.getbit(byte, F.pmod(F.col("bm_pos"), F.lit(8)).cast("int"))


def may_contain(df: DataFrame, key: str, bitmap: Bitmap) -> DataFrame:
    """Rows whose key may be among the bitmap's: every true one and a few others."""
    probed, bit = _probed(df, key, bitmap, "inner")
    return probed.where(bit == 1).select(*df.columns)


def parted(df: DataFrame, key: str, bitmap: Bitmap) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the bitmap's, as ``may_contain`` gives them, and all the others. ``df`` is read for each; give a table."""
    probed, bit = _probed(df, key, bitmap, "left")
    return may_contain(df, key, bitmap), probed.where(F.coalesce(bit, F.lit(0)) == 0).select(*df.columns)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the row offsets into them; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if n else raw[:0]
    return raw, offsets - (offsets[0] if n else 0)
