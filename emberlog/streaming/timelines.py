"""Timeline operators on streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from emberlog.operators.timeline import SAME
from emberlog.session import shared_folder


def stream_dedupe(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first event of those that agree in all fields of identity, within the watermark; state is bounded by it."""
    keyed = events.withColumn("dedupe_key", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SAME)), 256))
    return keyed.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["dedupe_key"]).drop("dedupe_key")


def stream_failures(events: DataFrame, length: str = "30 minutes", slide: str = "10 minutes", late: str = "10 minutes", actions: tuple[str, ...] = ("ssh_login_failure", "ssh_invalid_user")) -> DataFrame:
    """Failures per address in sliding windows; rows later than the watermark are dropped by Spark."""
    used = events.where(F.col("event_action").isin(*actions)).withWatermark("timestamp", late)
    counts = used.groupBy(F.window("timestamp", length, slide), "src_ip").agg(F.count("*").alias("failures"), F.approx_count_distinct("user").alias("users"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "src_ip", "failures", "users")


_GROUP = "node string, audit_id string, at long, types array<string>, bodies array<string>"
_CHUNK = "node array<string>, audit_id array<string>, at array<long>, due array<long>, type array<string>, body array<string>"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds that stand for no time: after all others.
_NEVER = 1 << 62


class _AuditGroups(StatefulProcessor):
    """Open groups of a bucket of ids: a list of chunks of records that is appended to, and timers for groups that get no end.

    A record without a time marks its group as closed. The list is written anew only once it holds
    more of closed groups than of open ones, so a record is written a few times at most.
    """

    def __init__(self, wait_ms: int, end: str, most: int = 10_000) -> None:
        self.wait_ms, self.end, self.most = wait_ms, end, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", _CHUNK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[tuple, list[tuple]] = {}
        for r in rows:
            texts = (r[c].astype(object).where(r[c].notna(), None) for c in ("node", "audit_id", "type", "body"))
            for node, audit_id, kind, body, at in zip(*texts, r["at"].tolist(), strict=True):
                new.setdefault((node, audit_id), []).append((at, body, kind))
        # a group that is late already closes with the next batch
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        waiting, ended = [], {}
        for group, own in new.items():
            own.sort(key=lambda r: (r[0], r[1] is None, r[1] or ""))
            first = own[0][0]
            due = max(first // 1000 + self.wait_ms, soonest) if first < _NEVER else soonest
            records = [(*group, at, due, kind, body) for at, body, kind in own]
            if any(r[4] == self.end for r in records):
                ended[group] = records
            else:
                waiting += records
        if ended:
            groups, size = self._open()
            before = {g: groups.pop(g) for g in ended if g in groups}
            if before:
                self._forget(before, groups, size)
            yield self._closed({g: before.get(g, []) + own for g, own in ended.items()})
        if waiting:
            self._append(waiting)
            self.handle.registerTimer(min(r[3] for r in waiting))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        groups, size = self._open()
        late = {g: groups.pop(g) for g in [g for g, own in groups.items() if own[0][3] < mark]}
        if late:
            self._forget(late, groups, size)
            yield self._closed(late)
        if groups:
            self.handle.registerTimer(min(own[0][3] for own in groups.values()))

    def _open(self) -> tuple[dict[tuple, list[tuple]], int]:
        """Records of open groups, in the order in which they came, and the number of all that the list holds. A group is due when its first record is."""
        groups, size = {}, 0
        for chunk in self.chunks.get():
            size += len(chunk[0])
            for r in zip(*chunk, strict=True):
                if r[2] is None:
                    groups.pop(r[:2], None)
                else:
                    groups.setdefault(r[:2], []).append(r)
        return groups, size

    def _append(self, records: list[tuple]) -> None:
        self.chunks.appendList([tuple(map(list, zip(*records[k : k + self.most], strict=True))) for k in range(0, len(records), self.most)])

    def _forget(self, closed: Iterable[tuple], groups: dict[tuple, list[tuple]], size: int) -> None:
        left = [r for own in groups.values() for r in own]
        if size > 2 * len(left):
            self.chunks.clear()
            if left:
                self._append(left)
        else:
            self._append([(*g, None, None, None, None) for g in closed])

    def _closed(self, groups: dict[tuple, list[tuple]]) -> pd.DataFrame:
        nodes, ids = zip(*groups, strict=True)
        types = [sorted({r[4] for r in own}, key=lambda t: (t is not None, t or "")) for own in groups.values()]
        return pd.DataFrame({"node": nodes, "audit_id": ids, "at": [min(r[2] for r in own) for own in groups.values()], "types": types, "bodies": [[r[5] for r in own] for own in groups.values()]})


def stream_audit_groups(records: DataFrame, late: str = "1 minute", end: str = "EOE", buckets: int = 1024) -> DataFrame:
    """Audit records (``timestamp``, ``node``, ``audit_id``, ``type``, ``body``) gathered per node and id, epoch included in the id.

    A group is emitted when its end marker comes, or when the watermark passes its first record by
    ``late``. Records of an id whose group was emitted open another. Ids are dealt by hash into
    ``buckets``, which a batch calls Python for once each: a call for each id costs more than all
    the rest. State holds open groups, and closed ones until they outnumber them. It needs RocksDB,
    which the session is set to where it names no store. A stream keeps its number of buckets.
    """
    spark = records.sparkSession
    if spark.conf.get(_STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKS)
    wait_ms = int(pd.Timedelta(late).total_seconds() * 1000)
    at, bucket = F.coalesce(F.unix_micros("timestamp"), F.lit(_NEVER)), F.pmod(F.xxhash64("node", "audit_id"), F.lit(buckets))
    used = records.select("timestamp", "node", "audit_id", "type", "body").withWatermark("timestamp", late).withColumns({"at": at, "bucket": bucket})
    groups = used.groupBy("bucket").transformWithStateInPandas(_AuditGroups(wait_ms, end), _GROUP, "append", "EventTime")
    return groups.select("node", "audit_id", F.when(F.col("at") < _NEVER, F.timestamp_micros("at")).alias("timestamp"), "types", "bodies")


def stream_success_after_failures(events: DataFrame, window_seconds: int = 1800, least: int = 5, failure: str = "ssh_login_failure", success: str = "ssh_login_success", last: int = 5, late: str = "10 minutes") -> DataFrame:
    """Successes with ``least`` failures or more of the same user and address in the time before, on a stream: the rows of the batch operator, once the watermark has passed them.

    A join of two streams within an interval, whose state the watermark bounds: successes wait for
    failures that are late, failures for the length of the window. Null users and addresses are equal.
    Spark holds the watermark behind the join back by the window, so a row comes that much later.
    """
    same = lambda c: F.coalesce(c, F.lit("\x00"))
    won = events.where(F.col("event_action") == success).select("event_id", "user", "src_ip", "timestamp", same("user").alias("u"), same("src_ip").alias("s")).withWatermark("timestamp", late)
    lost = events.where(F.col("event_action") == failure).select(F.col("event_id").alias("failure_id"), F.col("timestamp").alias("failed_at"), same("user").alias("fu"), same("src_ip").alias("fs")).withWatermark("failed_at", late)
    near = (F.col("u") == F.col("fu")) & (F.col("s") == F.col("fs")) & (F.col("failed_at") <= F.col("timestamp")) & (F.col("failed_at") >= F.col("timestamp") - F.expr(f"interval {int(window_seconds)} seconds"))
    met = won.join(lost, near).groupBy("timestamp", "event_id", "user", "src_ip").agg(F.count("*").alias("failures"), F.collect_list(F.struct("failed_at", "failure_id")).alias("found"))
    ids = F.transform(F.slice(F.array_sort("found"), -last, last), lambda x: x["failure_id"])
    return met.where(F.col("failures") >= least).select("event_id", "user", "src_ip", "timestamp", "failures", ids.alias("failure_ids"))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def run_available(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, append its rows to a table in the shared folder, and read that."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/emberlog-stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
