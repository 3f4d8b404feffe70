"""A table in one order over many tasks: sorted ranges, positions, and the rows after a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.session import written


def ordered_ranges(df: DataFrame, order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """``df`` with ``part``, the number of its range of ``order``, and ``place`` in it, from 0; a written table.

    Spark samples the order and sorts each range in a task of its own; where ``ranges`` is not given
    there are as many as the session shuffles to, joined to the advised size. Rows are read once.
    """
    keys = [F.col(c) for c in order]
    dealt = df.repartitionByRange(*keys) if ranges is None else df.repartitionByRange(ranges, *keys)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(dealt.sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), inside.alias("place")), "ranges")


def _sizes(own: DataFrame, weight: str | None = None) -> list[tuple[int, int, int]]:
    """(part, rows, weight) in order; as many rows as there are ranges."""
    one = F.count("*") if weight is None else F.sum(weight)
    return sorted(tuple(r) for r in own.groupBy("part").agg(F.count("*").alias("rows"), one.alias("weight")).collect())


def positions(own: DataFrame, weight: str | None = None, name: str = "position") -> DataFrame:
    """Add the place in the whole order, from 1, or the running sum of the column ``weight``, to a table of ``ordered_ranges``."""
    before, total = [], 0
    for part, _, n in _sizes(own, weight):
        before.append((part, total))
        total += n
    first = own.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    inside = F.col("place") + 1 if weight is None else F.sum(weight).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("inside", inside).join(F.broadcast(first), "part").withColumn(name, F.col("inside") + F.col("before")).drop("inside", "before")


def with_halo(own: DataFrame, rows: int) -> DataFrame:
    """Each range of ``own`` with the first ``rows`` rows after it, marked ``halo``: what a frame of rows in the whole order needs.

    Ranges with fewer rows than that pass on what comes after them; a range gets a list of as many
    ranges as it takes, ``rows`` at most that are not empty.
    """
    sizes, pairs = _sizes(own), []
    for k, (to, n, _) in enumerate(sizes):
        taken = 0
        for part, m, _ in sizes[k + 1 :]:
            if taken >= rows:
                break
            pairs.append((part, to, rows - taken, n + taken))
            taken += m
    table = own.sparkSession.createDataFrame(pairs or [(-1, -1, 0, 0)], "part int, to int, upto long, shift long")
    columns = [c for c in own.columns if c not in ("part", "place")]
    near = own.where(F.col("place") < rows).join(F.broadcast(table), "part").where("place < upto")
    halo = near.select(*columns, F.col("to").alias("part"), (F.col("place") + F.col("shift")).alias("place"), F.lit(True).alias("halo"))
    return own.select(*columns, "part", "place", F.lit(False).alias("halo")).unionByName(halo)


def next_rows(n: int) -> Window:
    """The frame of a row of ``with_halo`` and the ``n - 1`` rows after it."""
    return Window.partitionBy("part").orderBy("place").rowsBetween(0, n - 1)


def flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))
