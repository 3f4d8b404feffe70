"""Nearest neighbours by learned partitions."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import materialise


@dataclass(frozen=True)
class Router:
    """A small classifier from vectors to partitions, and how many partitions a query tries."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    recall: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by dot products: quick, and right to about 1e-12 of the squared norms."""
    return np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :], 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = distances(x[a : a + 512], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, graph: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """True for ``left`` of the nodes: a spectral cut of the graph at that size, bettered by exchanges."""
    inside = np.full(len(graph), -1)
    inside[nodes] = np.arange(len(nodes))
    rows, cols = np.repeat(np.arange(len(nodes)), graph.shape[1]), inside[graph[nodes]].ravel()
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    rows, cols = np.concatenate([rows, cols]), np.concatenate([cols, rows])
    degree = np.maximum(np.bincount(rows, minlength=len(nodes)), 1)
    x = rng.standard_normal(len(nodes))
    for _ in range(80):
        x = 0.5 * x + 0.5 * np.bincount(rows, weights=x[cols], minlength=len(nodes)) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.linalg.norm(x) + 1e-300
    side = np.zeros(len(nodes), bool)
    side[np.argsort(x, kind="stable")[:left]] = True
    for _ in range(20):
        same = np.bincount(rows, weights=(side[rows] == side[cols]).astype(float), minlength=len(nodes))
        gain = np.bincount(rows, minlength=len(nodes)) - 2 * same
        a, b = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
        n = min(len(a), len(b))
        n = min(int(np.sum(gain[a[:n]] + gain[b[:n]] > 2)), max(1, len(nodes) // 50))
        if n == 0:
            break
        before, kept = same.sum(), side.copy()
        side[a[:n]], side[b[:n]] = False, True
        if (side[rows] == side[cols]).sum() <= before:
            side = kept
            break
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Parts of equal size, cut from the neighbour graph by recursive bisection."""
    out, rng = np.zeros(len(graph), np.int64), np.random.default_rng(seed)

    def divide(nodes: np.ndarray, first: int, number: int) -> None:
        if number == 1:
            out[nodes] = first
            return
        half = number // 2
        side = _bisect(nodes, graph, len(nodes) * half // number, rng)
        divide(nodes[side], first, half)
        divide(nodes[~side], first + half, number - half)

    divide(np.arange(len(graph)), 0, parts)
    return out


def fit(sample: np.ndarray, tests: np.ndarray, parts: int, k: int = 10, aim: float = 0.98, hidden: int = 64, epochs: int = 40) -> Router:
    """Partition the sample's neighbour graph, learn to route, and choose the probes that reach ``aim`` on ``tests``."""
    k = min(k, len(sample) - 1)
    rng = np.random.default_rng(1)
    graph = neighbour_graph(sample, k)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.arange(len(sample)), part), k)
    np.add.at(target, (np.repeat(np.arange(len(sample)), k), part[graph].ravel()), 1)
    target /= target.sum(1, keepdims=True)
    mean, scale = sample.mean(0), float(sample.std()) + 1e-12
    x = (sample - mean) / scale
    w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    m, v, step = [0 * p for p in w], [0 * p for p in w], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[batch] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[batch]) / len(batch)
            gh = g @ w[2].T * (h > 0)
            step += 1
            for i, d in enumerate((x[batch].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                w[i] = w[i] - 3e-3 * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *w, probes=parts, recall=1.0)
    own = router.scores(sample).argmax(1)
    true = np.argsort(distances(tests, sample), axis=1, kind="stable")[:, :k]
    order = np.argsort(-router.scores(tests), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    needed = np.take_along_axis(rank, own[true], axis=1)
    for probes in range(1, parts + 1):
        reached = float((needed < probes).mean())
        if reached >= aim:
            break
    return Router(mean, scale, *w, probes=probes, recall=reached)


def vectors(df: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """Rows (``id``, ``v``: little-endian doubles, ``query``) that take part: neither null, nor zero, nor with null or non-finite components, nor of a rarer dimension."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).where("id is not null and v is not null and size(v) > 0")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = common[0]["d"] if common else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), pa.array([r.tobytes() for r in x[good]], pa.binary()), batch.column("query").filter(pa.array(good))], ["id", "v", "query"])

    return rows.where(F.size("v") == dim).where(~F.exists("v", lambda c: c.isNull())).mapInArrow(run, "id long, v binary, query boolean")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def number_of_parts(rows: int, sampled: int) -> int:
    """Partitions that ``rows`` rows are divided into: about half their square root, 256 at most, each with 16 sampled rows or more."""
    return max(1, min(256, sampled // 16, math.ceil(math.sqrt(rows) / 2)))


def _fitted(k: int, parts: int | None):
    """Fit a router on the sampled rows of one partition; none where they are too few or alike to divide."""

    def run(table: pa.Table) -> pa.Table:
        x = np.unique(_matrix(table.column("v")), axis=0)
        x = x[np.random.default_rng(0).permutation(len(x))]
        held = max(1, min(256, len(x) // 8))
        tests, sample = x[:held], x[held:]
        number = parts or number_of_parts(table.column("rows")[0].as_py(), len(sample))
        router = fit(sample, tests, min(number, len(sample)), k) if number > 1 and len(sample) > k else None
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "router": pa.array([pickle.dumps(router)], pa.binary()), "divides": pa.array([router is not None], pa.bool_())})

    return run


def _routed(own: bool):
    """Rows of a block with the partitions below theirs: each row's own, or all that a query tries."""

    def run(rows: pa.Table, routers: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return rows.select(["id", "v", "part"])
        router = pickle.loads(routers.column("router")[0].as_py()) if routers.num_rows else None
        below = rows.column("part").to_numpy() * 256
        if router is None:
            return pa.table({"id": rows.column("id"), "v": rows.column("v"), "part": pa.array(below)})
        order = np.argsort(-router.scores(_matrix(rows.column("v"))), axis=1, kind="stable")[:, : 1 if own else router.probes]
        at = pa.array(np.repeat(np.arange(rows.num_rows), order.shape[1]))
        return pa.table({"id": rows.column("id").take(at), "v": rows.column("v").take(at), "part": pa.array(np.repeat(below, order.shape[1]) + order.ravel())})

    return run


_PLACED = "id long, v binary, part long"


def _counted(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table with a row for each partition, to be broadcast if it has no more than ``most``."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def learned_partitions(rows: DataFrame, queries: DataFrame, k: int, sample_size: int, part_rows: int, block_rows: int, parts: int | None = None, levels: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every row with its partition, and every query with those it tries (``id``, ``v``, ``part``); written tables.

    Both come as written tables of one partition. One of more than ``part_rows`` rows is divided: a router is
    fitted on about ``sample_size`` of its rows, drawn by a hash, and 256 more choose how many
    partitions a query tries. What is still too large is divided again, so partitions grow in number
    with the rows. Rows meet their router in blocks of ``block_rows``; nothing reaches the driver.
    """
    placed, asked = rows, queries
    for level in range(levels):
        sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
        large = sizes if level == 0 else sizes.where(F.col("rows") > part_rows)
        # a row is drawn by its own hash, so no task sees more than it reads
        chance = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)
        drawn = placed.withColumn("chance", chance).join(_counted(large), "part").where(F.col("chance") * F.col("rows") < sample_size + 256).select("part", "rows", "v")
        routers = materialise(drawn.groupBy("part").applyInArrow(_fitted(k, parts), "part long, router binary, divides boolean"), "routers")
        if routers.where("divides").isEmpty():
            break

        def route(df: DataFrame, own: bool, name: str) -> DataFrame:
            blocks = _counted(df.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))  # noqa: B023
            dealt = df.join(blocks, "part").select("part", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), "id", "v")  # noqa: B023
            held = routers.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "router")  # noqa: B023
            return materialise(dealt.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(_routed(own), _PLACED), name)

        placed, asked = route(placed, True, "indexed"), route(asked, False, "asked")
        if parts is not None:
            break
    return placed, asked


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_size: int = 4096, part_rows: int = 4096, block_rows: int = 4096, parts: int | None = None) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``is_query`` holds: ``query_id``, ``rank``, the id, ``score`` (Euclidean distance).

    All rows are indexed by ``learned_partitions``. Rows of a partition are dealt into blocks of
    about ``block_rows``, and so are its queries, so one that attracts a third of all is many tasks
    of bounded size; each block of rows meets each block of queries, and every row in it is
    measured. The nearest are picked by dot products of centred vectors, with all that rounding may
    have put behind them, and measured again from differences in double precision.

    Rows that are null, zero, of another dimension than most, or hold null or non-finite
    components take no part, nor do those with a null id. A query is not its own neighbour; ties go
    to the smaller id. With fewer candidates all are returned, for an empty table none. Rows that
    repeat an id count once each. Other columns are ignored.
    """
    spark = df.sparkSession
    every = materialise(vectors(df, is_query, id_col, vec_col).withColumn("part", F.lit(0).cast("long")), "vectors")
    if every.limit(2).count() < 2:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    queries = materialise(every.where("query").drop("query"), "queries")
    if parts == 1:
        placed, asked = every.drop("query"), queries
    else:
        placed, asked = learned_partitions(every.drop("query"), queries, k, sample_size, part_rows, block_rows, parts)
    count = lambda x, name: x.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    blocks = _counted(count(placed, "blocks").join(count(asked, "query_blocks"), "part"))
    number = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = placed.join(blocks, "part").select("part", number("blocks").alias("block"), every_of("query_blocks").alias("query_block"), "id", "v")
    wanted = asked.join(blocks, "part").select("part", every_of("blocks").alias("block"), number("query_blocks").alias("query_block"), "id", "v")

    def nearest(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if rows.num_rows and wanted.num_rows:
            x, ids = _matrix(rows.column("v")), rows.column("id").to_numpy()
            q, who = _matrix(wanted.column("v")), wanted.column("id").to_numpy()
            middle = x.mean(0)
            near_x, near_q = x - middle, q - middle
            # what rounding may do to a squared distance: of the dot products, and of the shift to the middle
            size = (near_x * near_x).sum(1).max() + (near_q * near_q).sum(1)
            shift = 1e-14 * (np.abs(x).max() + np.abs(q).max()) * math.sqrt(x.shape[1])
            for a in range(0, len(q), 256):
                d = distances(near_q[a : a + 256], near_x)
                d[who[a : a + 256, None] == ids[None, :]] = np.inf
                top = min(k, d.shape[1]) - 1
                limit = np.partition(d, top, axis=1)[:, top]
                for i, edge in enumerate(limit):
                    wide = edge + 1e-12 * size[a + i] + shift * (2 * math.sqrt(edge) + shift) if np.isfinite(edge) else edge
                    near = np.flatnonzero((d[i] <= wide) & np.isfinite(d[i]))
                    exact = np.sqrt(((x[near] - q[a + i]) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))[:k]
                    out[0].append(np.full(len(best), who[a + i]))
                    out[1].append(ids[near[best]])
                    out[2].append(exact[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "id", "score"])

    keys = ("part", "block", "query_block")
    found = dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(nearest, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def exact(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Brute force, for measuring recall: one partition that every query tries."""
    return search(df, is_query, k, id_col, vec_col, parts=1)
