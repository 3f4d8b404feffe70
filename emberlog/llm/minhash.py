"""Near-duplicate groups by an LSH forest over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm import kernels
from emberlog.llm.common import key_bitmap, materialise, may_contain, shuffle_width, slices, text_buffers
from emberlog.llm.graph import components

TREES, DEPTH, LEAST = 20, 9, 4
#: Trees of the first pass, which links most of what is very similar, so that the others have little left.
FIRST_TREES = 5
SKETCH = 256
#: Rare shingles before each that are kept beside it.
BACK = 16
_RNG = np.random.Generator(np.random.PCG64(7))
_MUL = (_RNG.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, SKETCH, dtype=np.uint32)[:, None]


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each of ``SKETCH`` hash functions over a set."""
    x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 512):
        np.minimum(out, (x[:, at : at + 512] * _MUL + _ADD).min(1), out=out)
    return out


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set size, 128-bit hash of the set, forest labels (16 bits a value) and sketch (8 bits a value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                hashes, offsets = kernels.words(*text_buffers(batch.column("text")))
                n, a, b, labels, sketch = [], [], [], [], []
                for i in range(batch.num_rows):
                    own = np.unique(kernels.shingles(hashes[offsets[i] : offsets[i + 1]], width))
                    values = signature(own)
                    n.append(len(own))
                    a.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                    b.append(int(kernels.mix(own + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).astype(np.int64)))
                    labels.append((values[: TREES * DEPTH] & np.uint32(0xFFFF)).astype(">u2").tobytes())
                    sketch.append((values & np.uint32(0xFF)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(labels, pa.binary()), pa.array(sketch, pa.binary())], ["id", "n_shingles", "set_a", "set_b", "labels", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, set_a long, set_b long, labels binary, sketch binary")


def in_order(forest: DataFrame, block: int = 2048) -> DataFrame:
    """The rows of all trees in one order (by tree, label, rep), with the ``block`` of that many rows each stands in and its ``place``; a written table.

    Spark sorts by ranges; the rows of the ranges before, a number for each range, give the place.
    """
    key = ["tree", "label", "rep"]
    ranged = forest.repartitionByRange(shuffle_width(forest.sparkSession), *key).sortWithinPartitions(*key).withColumn("id", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ranged").withColumns({"range": F.shiftright("id", 33), "inside": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    placed = ranged.join(F.broadcast(before), "range").withColumn("place", F.col("inside") + F.col("before"))
    return placed.select("tree", "label", "rep", "sketch", "key", "place", F.floor(F.col("place") / block).alias("block"))


def neighbours(ordered: DataFrame, reach: int, least: float, each: int | None = None, once: bool = False, block: int = 2048) -> DataFrame:
    """Pairs (``a`` > ``b``, ``est``) of rows at most ``reach`` apart in the order, with a common prefix and a likely sketch.

    ``ordered`` comes from ``in_order``, with a ``comp`` for each row. A block also gets the first
    ``reach`` rows of the next one, so no pair is lost between blocks. Rows of one ``comp`` are not
    paired; with ``each``, a row has at most that many pairs with each other ``comp`` in one
    direction, the likeliest. With ``once``, and all ``labels`` of a row, a pair comes from the first
    tree in which it has a common prefix, if it is within reach there.
    """
    if reach > block:
        raise ValueError("reach is within a block")
    head = (F.col("place") % block < reach) & (F.col("block") > 0)
    dealt = ordered.withColumn("block", F.explode(F.when(head, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))
    sorted_ = dealt.repartition(shuffle_width(ordered.sparkSession), "block").sortWithinPartitions("block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            prefix = label[:, : 2 * LEAST].copy().view("<u8").ravel()
            tree, rep, comp, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "rep", "comp", "block"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            own, old = [part, tree, prefix, rep, comp, sketch], 0
            if once:
                own.append(np.ascontiguousarray(np.frombuffer(b"".join(batch.column("labels").to_pylist()), "<u2").reshape(batch.num_rows, TREES, DEPTH)[:, :, :LEAST]).view("<u8")[:, :, 0])
            if kept is not None:
                own, old = [np.concatenate(x) for x in zip(kept, own, strict=True)], len(kept[0])
            part, tree, prefix, rep, comp, sketch, *every = own
            found = []
            for lag in range(1, min(reach, len(rep) - 1) + 1):
                first = max(0, old - lag)
                near = (part[first:-lag] == part[first + lag :]) & (tree[first:-lag] == tree[first + lag :]) & (prefix[first:-lag] == prefix[first + lag :])
                if not near.any():
                    break
                i = np.flatnonzero(near & (comp[first:-lag] != comp[first + lag :])) + first
                for k in range(0, len(i), 8192):
                    j = i[k : k + 8192]
                    est = (sketch[j] == sketch[j + lag]).mean(1)
                    good = est >= least
                    j, est = j[good], est[good]
                    if once and len(j):
                        first_tree = np.argmax(every[0][j] == every[0][j + lag], axis=1) == tree[j]
                        j, est = j[first_tree], est[first_tree]
                    if len(j):
                        found.append((j, j + lag, est))
            kept = [x[-reach:].copy() for x in own]
            if found:
                i, j, est = (np.concatenate(x) for x in zip(*found, strict=True))
                if each is not None:
                    order = np.lexsort((-est, comp[j], i))
                    i, j, est = i[order], j[order], est[order]
                    new = np.ones(len(i), bool)
                    new[1:] = (i[1:] != i[:-1]) | (comp[j[1:]] != comp[j[:-1]])
                    start = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                    few = np.arange(len(i)) - start < each
                    i, j, est = i[few], j[few], est[few]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[i], rep[j])), pa.array(np.minimum(rep[i], rep[j])), pa.array(est)], ["a", "b", "est"])

    pairs = sorted_.select("block", "tree", "label", "rep", "comp", "sketch", *["labels"] * once).mapInArrow(run, "a long, b long, est double")
    return pairs.groupBy("a", "b").agg(F.max("est").alias("est"))


def rare_pairs(crowded: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs of ``rare_meetings``, each once."""
    return rare_meetings(crowded, docs, width, percent, id_col, text_col).distinct()


def rare_meetings(crowded: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """All pairs (``a``, ``b``) of different components among ``crowded`` (``rep``, ``comp``) that can be similar enough: an exact prefix filter.

    Of sets of sizes m and n that are, the m - ceil(percent * m / 100) + 1 rarest shingles of one
    and those of the other share one, in any fixed order, and enough come after it. Of the rows with
    a shingle, those of the largest component there are not paired with each other, so a group of
    copies makes no square. A pair that shares several such shingles meets at the first, and at
    others only where none of those shared is among the ``BACK`` before, in both sets.
    """
    found = may_contain(docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")), "rep", key_bitmap(crowded, "rep"))
    texts = found.join(crowded, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                hashes, offsets = kernels.words(*text_buffers(batch.column("text")))
                sets = [np.unique(kernels.shingles(hashes[offsets[i] : offsets[i + 1]], width)) for i in range(batch.num_rows)]
                n = np.array([len(x) for x in sets])
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), batch.column("comp").take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "comp", "n", "h"])

    rows = materialise(texts.select("rep", "comp", "text").mapInArrow(run, "rep long, comp long, n long, h long"), "shingles")
    shared = rows.groupBy("h", "comp").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("df"), F.max_by("comp", "k").alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    shared = materialise(shared, "shared")
    # shingles of one component alone come first in the order; they only count, and where they fill the prefix, the row meets nothing
    own = Window.partitionBy("rep")
    some = may_contain(rows, "h", key_bitmap(shared, "h", written=True)).withColumn("m", F.count("*").over(own))
    some = some.where(F.col("m") >= F.ceil(F.col("n") * percent / 100)).drop("m")
    ranked = some.join(shared, "h").withColumn("i", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "h")))
    prefix = ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    back = F.collect_list("h").over(Window.partitionBy("rep").orderBy("i").rowsBetween(-BACK, -1))
    prefix = materialise(prefix.withColumn("back", back), "prefixes")
    a = prefix.where("comp <> largest").select("h", "largest", F.col("rep").alias("ra"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("back").alias("ba"))
    b = prefix.select("h", F.col("rep").alias("rb"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("back").alias("bb"))
    # of two rows outside the largest component, the smaller is on the left
    need = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("largest")) | (F.col("ra") < F.col("rb")))
    need &= (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    need &= (1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    need &= ~F.arrays_overlap("ba", "bb")
    met = a.join(b, "h").where(need)
    return met.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (``a``, ``b``) whose full shingle sets are similar enough. ``pairs`` is read several times; give a written table."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    texts = may_contain(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", key_bitmap(ids, "id"))
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 20):
                sides = []
                for c in ("text_a", "text_b"):
                    hashes, offsets = kernels.words(*text_buffers(batch.column(c)))
                    sides.append([np.unique(kernels.shingles(hashes[offsets[i] : offsets[i + 1]], width)) for i in range(batch.num_rows)])
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", reach: int = 64) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id linked, itself included), ``kept``.

    Rows are linked when the Jaccard index of their sets of ``width``-word shingles is at least
    ``percent`` / 100, confirmed on full sets. Rows with equal sets are one class first. Classes
    stand in ``TREES`` sorted signature orders; neighbours in an order that share a prefix of
    ``LEAST`` values or more, the longest first, are candidates, so depth adapts to how crowded a
    region is. A first pass takes close neighbours in a few trees and the likeliest link of each
    class; a second one looks ``reach`` classes ahead, past all that is linked already, for the likeliest links
    between components; a third takes all that is left there, at a wider bound of the estimate. Classes of regions with more than
    ``reach`` rows that are not linked meet by their rare shingles besides, which is exact.

    A pair of similarity 0.8 shares a prefix in some order with probability 0.99997, and the
    estimate of a pair's sketch is within four standard errors, by which candidates are cut, with
    0.99997.

    Ids are whole numbers. Null or empty text, and text without words, has no shingles and no
    links; text of fewer words is one shingle. Repeated rows are one class. Rows with a null id get
    null component and are kept. Other columns are ignored; an empty table gives no rows.
    """
    sigma = 0.025
    least, likely = percent / 100 - 4 * sigma, percent / 100 - sigma
    drawn = materialise(sketches(docs, width, id_col, text_col), "sketches")
    usable = drawn.where("n_shingles > 0 and id is not null")
    classes = usable.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").cast("long").alias("rep"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")

    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    label = F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * DEPTH})")
    key = F.xxhash64("tree", F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * LEAST})"))
    placed = classes.select("rep", "labels", trees).select("rep", key.alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = classes.select("rep", "labels", "sketch", trees).select("tree", label.alias("label"), "rep", "sketch", key.alias("key"))
    forest = in_order(may_contain(rows, "key", key_bitmap(shared, "key")))

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links among written pairs."""
        return materialise(confirmed(pairs, docs, width, percent, id_col, text_col), "links")

    def labelled(comps: DataFrame) -> DataFrame:
        return forest.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs between components, which are named."""
        for side in ("a", "b"):
            pairs = pairs.join(comps.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        return pairs.where("ca <> cb")

    close = neighbours(forest.where(F.col("tree") < FIRST_TREES).withColumn("comp", F.col("rep")), 2, likely)
    likeliest = close.groupBy("a").agg(F.max_by("b", "est").alias("b"))
    edges = confirm(materialise(likeliest, "pairs"))
    comps = components(edges)

    # the likeliest link between each class and each other component first, then all that still lie across
    order = Window.partitionBy("a", "cb").orderBy(F.desc("est"), "b")
    across = apart(neighbours(labelled(comps), reach, likely, each=3), comps)
    tried = materialise(across.withColumn("k", F.row_number().over(order)).where("k = 1").select("a", "b"), "pairs")
    edges = edges.unionByName(confirm(tried))
    comps = components(edges)

    def mixed(comps: DataFrame) -> DataFrame:
        """Rows of the prefixes under which several components stand, with the number of rows there."""
        own = labelled(comps)
        several = own.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "rows")
        return own.join(several, "key")

    # a pair that is out of reach in a tree is in a crowded region, where rare shingles find it
    left = materialise(mixed(comps).join(classes.select("rep", "labels"), "rep"), "mixed")
    rest = neighbours(left, reach, least, once=True).select("a", "b").join(tried, ["a", "b"], "left_anti")
    rest = materialise(rest, "pairs")
    crowded = materialise(left.where(F.col("rows") > reach + 1).select("rep", "comp").distinct(), "crowded")
    if not crowded.isEmpty():
        far = rare_pairs(crowded, docs, width, percent, id_col, text_col).join(tried, ["a", "b"], "left_anti")
        rest = materialise(rest.unionByName(far).distinct(), "pairs")
    if not rest.isEmpty():
        last = confirm(rest)
        if not last.isEmpty():
            comps = components(edges.unionByName(last))

    own = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = drawn.select("id", "n_shingles", "set_a", "set_b").join(own, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
