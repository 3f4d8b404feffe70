"""The prefix trie of conversations by blocks of turns.

Conversations are grouped by the digests of successive blocks of several turns. A block with no sibling
is one chain: its turns all have the block's members. Only blocks with siblings are taken apart, turn by
turn, and that once for each distinct block. A node is (smallest member, depth), and the nodes of one
smallest member are a chain that ends where that conversation ends; sums over subtrees go over chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import discard, materialise
from emberlog.llm.digest import ordered_sha256

#: Turns of a block; blocks, and nodes of a chain, that one window sums at once.
BLOCK, RUN = 8, 4096
_ROOT = "0" * 32
_LANES = [f"k{i}" for i in range(4)]


def numbered_turns(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` (``conv_id``, ...) with ``ordinal``, from 1 in the order of ``order`` within each conversation; a written table.

    Rows are sorted by range, so a long conversation is spread over tasks. The turns of a conversation
    before a task's first are one number a task.
    """

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            local = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
            if ids[0] == last:
                local[: starts[1] if len(starts) > 1 else len(ids)] += count
            last, count = ids[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(local)], [*names, "part", "local"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    own = materialise(rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).mapInArrow(run, f"{schema}, part int, local long"), "turns")
    counts = own.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    # a task's first conversation alone can have turns before it
    carried = F.broadcast(before.where("before > 0").select("conv_id", "part", "before"))
    out = materialise(own.join(carried, ["conv_id", "part"], "left").select(*columns, (F.col("local") + F.coalesce("before", F.lit(0))).alias("ordinal")), "placed")
    discard(own)
    return out


def _lanes(text: Column) -> list[Column]:
    """A 128-bit digest as four numbers of 32 bits, whose sums over any number of rows stay exact."""
    h = F.md5(text.cast("binary"))
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"k{i}") for i in range(4)]


def _key(lanes: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", *(c.cast("string") for c in lanes)).cast("binary"))


def _sums(rows: DataFrame, by: str, at: str, columns: list[str], descending: bool = False) -> DataFrame:
    """Running sums of ``columns`` along ``at`` within ``by``: within runs of ``RUN``, to which the sums of whole runs before are added where there are any."""
    run = F.floor(F.col(at) / RUN)
    rows = rows.withColumn("run", -run if descending else run)
    direction = F.col(at).desc() if descending else F.col(at).asc()
    inside = Window.partitionBy(by, "run").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(c).over(inside).alias(f"{c}_sum") for c in columns))
    totals = rows.where(F.col(by).isNotNull()).groupBy(by, "run").agg(*(F.sum(c).alias(c) for c in columns))
    several = totals.join(totals.groupBy(by).agg(F.count("*").alias("runs")).where("runs > 1").select(by), by)
    ahead = Window.partitionBy(by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = several.select(by, "run", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in columns))
    out = out.join(carried, [by, "run"], "left")
    return out.select(*(c for c in rows.columns if c != "run"), *((F.col(f"{c}_sum") + F.coalesce(f"{c}_before", F.lit(0))).alias(f"{c}_sum") for c in columns))


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of ``turns`` (``conv_id``, ``depth`` from 1 without gaps, ``digest`` of the turn, ``words``).

    ``conversations`` has every ``conv_id`` with ``n``, its turns (0 for none). Returns ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. No conversations give no rows. Prefixes are told by 128-bit digests.
    """
    # blocks of every conversation, and the digest of all turns up to the end of each
    blocks = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"))
    named = blocks.select("conv_id", "block", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    named = named.select("*", *_lanes(F.concat(F.col("block").cast("string"), F.lit(":"), F.concat_ws("", F.transform("digests", F.hex)))))
    summed = _sums(named, "conv_id", "block", _LANES)
    ends = [F.col(f"{c}_sum") for c in _LANES]
    own = summed.select("conv_id", "block", "digests", "words", _key(ends).alias("key"), F.when(F.col("block") == 0, _ROOT).otherwise(_key([e - F.col(c) for e, c in zip(ends, _LANES, strict=True)])).alias("parent"))
    own = materialise(own, "blocks")
    distinct = own.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("parent", "block", "digests", "words")))
    distinct = materialise(distinct, "distinct")

    # blocks with siblings, turn by turn; the end of a whole block keeps the block's key
    siblings = distinct.groupBy("parent").agg(F.count("*").alias("siblings"))
    dealt = distinct.join(siblings, "parent").select("*", F.posexplode("digests").alias("i", "digest"))
    some = F.concat_ws("", F.transform(F.slice("digests", 1, F.col("i") + 1), F.hex))
    inner = lambda i, text: F.md5(F.concat(F.lit("in:"), "parent", F.lit(":"), i.cast("string"), F.lit(":"), text).cast("binary"))
    alone = F.col("siblings") == 1
    steps = dealt.select(
        F.when(F.col("i") + 1 == block, F.col("key")).otherwise(inner(F.col("i"), some)).alias("node"),
        F.when(F.col("i") == 0, F.col("parent")).otherwise(inner(F.col("i") - 1, F.concat_ws("", F.transform(F.slice("digests", 1, F.col("i")), F.hex)))).alias("above"),
        (F.col("block") * block + F.col("i") + 1).alias("depth"), "conv_id", "n_convs", F.col("words")[F.col("i")].alias("words"),
        F.when(F.col("i") + 1 == F.size("digests"), F.col("key")).alias("end"), alone.alias("alone"), (alone & (F.col("i") > 0)).alias("chained"),
    )
    steps = materialise(steps, "steps")
    single = steps.where("alone").select("node", "above", "depth", "conv_id", "n_convs", "words", "chained")
    parted = steps.where("not alone").groupBy("node").agg(F.first("above").alias("above"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"))
    nodes = materialise(single.unionByName(parted.withColumn("chained", F.lit(False))), "nodes")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("words"))
    tops = nodes.where("not chained")
    smallest = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id")).unionByName(root.select(F.lit(_ROOT).alias("above"), F.col("conv_id").alias("parent_conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "words"]
    placed = tops.join(smallest, "above").select(*columns).unionByName(nodes.where("chained").withColumn("parent_conv_id", F.col("conv_id")).select(*columns)).unionByName(root)
    placed = materialise(placed, "placed")

    found = _subtrees(placed)
    last = own.join(conversations, "conv_id").where(F.col("block") == F.floor((F.col("n") - 1) / block)).select("conv_id", "key")
    ended = _ends(last.unionByName(conversations.where("n = 0").select("conv_id", F.lit(_ROOT).alias("key"))))
    where = steps.where("end is not null").select(F.col("end").alias("key"), "node", "depth").join(nodes.select("node", "conv_id"), "node").select("key", "conv_id", "depth")
    where = where.unionByName(root.select(F.lit(_ROOT).alias("key"), "conv_id", "depth"))
    digests = ended.join(where, "key").select("conv_id", "depth", "ends_sha256")
    out = found.join(digests, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _ends(last: DataFrame, run: int = 1024) -> DataFrame:
    """(``key``, ``ends_sha256``): of conversations (``conv_id``, ``key``) by key, ids in order of number, comma-joined, hashed.

    Ids are sorted by range and joined by runs of ``run`` ids first, so the stream of a key has few rows.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = (np.arange(batch.num_rows) + seen) // run + (part << 40)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], ["conv_id", "key", "run"])

    dealt = last.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(runs, "conv_id long, key string, run long")
    joined = dealt.groupBy("key", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return ordered_sha256(joined, "key", ["run"], "ids", ",", "ends_sha256")


def _subtrees(placed: DataFrame, rounds: int = 40) -> DataFrame:
    """``placed`` with ``n_children``, ``n_leaves``, ``saved_tokens``.

    A chain hangs from a node of another chain. Its subtree is summed by doubling: each round adds what
    hangs twice as far below, so rounds grow with the logarithm of the branchings on a path.
    """
    saved = (F.col("n_convs") - 1) * F.col("words")
    chains = placed.groupBy("conv_id").agg(F.max("depth").alias("bottom"), F.sum(saved).alias("saved"), F.min_by(F.struct("parent_conv_id", "depth"), "depth").alias("top"))
    hanging = materialise(chains.select("conv_id", "bottom", "saved", F.col("top.parent_conv_id").alias("over"), (F.col("top.depth") - 1).alias("at")), "chains")
    # a chain's last node has no children unless chains hang from it
    below = hanging.where("over is not null").groupBy(F.col("over").alias("conv_id"), F.col("at").alias("bottom")).agg(F.lit(1).alias("some"))
    sums = hanging.join(below, ["conv_id", "bottom"], "left").select("conv_id", F.col("over").alias("up"), F.when(F.col("some").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    sums = materialise(sums, "sums")
    for _ in range(rounds):
        if sums.where("up is not null").isEmpty():
            break
        lower = sums.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        jump = sums.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        step = sums.join(lower, "conv_id", "left").join(jump, "up", "left")
        following = materialise(step.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("most", F.lit(0))).alias("saved")), "sums")
        discard(sums)
        sums = following
    else:
        raise RuntimeError("subtrees did not settle")
    hung = hanging.where("over is not null").select("conv_id", "over", "at").join(sums.select("conv_id", "leaves", "saved"), "conv_id")
    hung = hung.groupBy(F.col("over").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
    nodes = placed.join(hanging.select("conv_id", "bottom"), "conv_id").join(hung, ["conv_id", "depth"], "left")
    children = F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("bottom")).cast("long")
    nodes = nodes.withColumn("n_children", children).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (saved + F.coalesce("more", F.lit(0))).alias("saved"), (F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("leaves"))
    return _sums(nodes, "conv_id", "depth", ["leaves", "saved"], descending=True).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves_sum").alias("n_leaves"), F.col("saved_sum").alias("saved_tokens"))


def rebuilt(rows: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: ``turns`` and ``conversations`` as ``trie`` takes them.

    Conversation c has the first h = crc32(c) % ``heads`` turns of conversation c - c % ``every``, then its
    own after its first h. Turns go by ``turn``, null first, and of one number by the MD5 of role and text.
    Null role or text is empty; rows without a conv_id take no part. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), words.alias("words"))
    placed = numbered_turns(own, ["turn", "digest"], ["conv_id", "digest", "words"])
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    lengths = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    conversations = counts.select("conv_id", "own", head, base).join(lengths, "base", "left").select("conv_id", "own", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("shared"))
    conversations = materialise(conversations.withColumn("n", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    first = placed.where((F.col("conv_id") % every == 0) & (F.col("ordinal") < heads)).withColumnRenamed("conv_id", "base")
    before = conversations.where("shared > 0").join(first, "base").where("ordinal <= shared").select("conv_id", F.col("ordinal").alias("depth"), "digest", "words")
    short = conversations.where("shared < h and own > h").select("conv_id", (F.col("h") - F.col("shared")).alias("less"))
    after = placed.select("*", head).where("ordinal > h").join(short, "conv_id", "left").select("conv_id", (F.col("ordinal") - F.coalesce("less", F.lit(0))).alias("depth"), "digest", "words")
    return before.unionByName(after), conversations.select("conv_id", "n")
