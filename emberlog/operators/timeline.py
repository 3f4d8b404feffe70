"""Core operators on timelines: binding, provenance, ids, duplicates, order, windows, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.text import digest, severity_rank, slug
from emberlog.schemas import TIMELINE_SCHEMA

#: The fields that make an event what it is, for its id.
IDENTITY = (
    "collection_id", "timestamp", "timestamp_raw", "time_start", "time_end", "evidence_role", "source_path", "source_sha256", "source_type", "parser", "event_action", "host",
    "user", "uid", "gid", "src_ip", "dst_ip", "port", "process", "pid", "command", "file_path", "raw", "extra",
)
#: The fields in which duplicates agree; null is empty.
SAME = ("collection_id", "timestamp", "time_start", "time_end", "evidence_role", "source_path", "source_sha256", "event_action", "host", "user", "src_ip", "dst_ip", "command", "file_path", "raw")
_DEFAULTS = {"schema_version": "1.2", "timezone": "UTC", "timezone_confidence": "assumed", "evidence_role": "behavior", "severity": "informational", "confidence": "medium"}


def to_timeline(df: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """Bind any table to the timeline schema; columns that are not mapped get their defaults."""
    out = []
    for field in TIMELINE_SCHEMA.fields:
        if field.name in mapping:
            value = mapping[field.name].cast(field.dataType)
        elif field.name in _DEFAULTS:
            value = F.lit(_DEFAULTS[field.name])
        elif field.dataType.typeName() == "array":
            value = F.array().cast(field.dataType)
        elif field.dataType.typeName() == "map":
            value = F.create_map().cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def attach_provenance(events: DataFrame, inventory: DataFrame, parser_version: str = "1") -> DataFrame:
    """Add the source's hash by path, and the precision and confidence of the time where none is set."""
    hashes = inventory.select(F.col("relative").alias("source_path"), F.col("sha256").alias("found_sha256"))
    timed = F.col("timestamp").isNotNull()
    return (
        events.join(hashes, "source_path", "left")
        .withColumns(
            {
                "source_sha256": F.coalesce("source_sha256", "found_sha256"),
                "parser_version": F.coalesce("parser_version", F.lit(parser_version)),
                "timestamp_precision": F.coalesce("timestamp_precision", F.when(timed, "second").otherwise("unknown")),
                "timestamp_confidence": F.coalesce("timestamp_confidence", F.when(timed, "medium").otherwise("none")),
            }
        )
        .select(*events.columns)
    )


def derived_hash(paths_and_hashes: Column) -> Column:
    """The hash of a row made from several sources: of their sorted ``path|hash`` lines."""
    return F.sha2(F.array_join(F.array_sort(paths_and_hashes), "\n"), 256)


def anchor_observations(events: DataFrame, acquired: Column) -> DataFrame:
    """Give undated state the time of acquisition as its interval, with low confidence."""
    undated = F.col("timestamp").isNull() & (F.col("evidence_role") != "behavior") & F.col("time_start").isNull() & acquired.isNotNull()
    return events.withColumns({"time_start": F.when(undated, acquired).otherwise(F.col("time_start")), "time_end": F.when(undated, acquired).otherwise(F.col("time_end")), "timestamp_confidence": F.when(undated, "low").otherwise(F.col("timestamp_confidence"))})


def collection_hosts(events: DataFrame, names: DataFrame, override: str | None = None) -> DataFrame:
    """(``collection_id``, ``collection_host``): the override, else the smallest host seen, else the collection's name."""
    seen = events.where("host <> ''").groupBy("collection_id").agg(F.min("host").alias("seen"))
    return names.join(seen, "collection_id", "left").select("collection_id", F.coalesce(F.lit(override), "seen", "collection_name").alias("collection_host"))


def attach_collection(events: DataFrame, collections: DataFrame) -> DataFrame:
    """Set the collection columns, and the host where an event has none. ``collections`` has a row for each collection."""
    new = collections.select("collection_id", *(F.col(c).alias(f"new_{c}") for c in ("collection_name", "collection_input", "collection_host")))
    joined = events.join(new, "collection_id", "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("collection_name", "collection_input", "collection_host")} | {"host": F.coalesce(F.nullif("host", F.lit("")), "new_collection_host")}).select(*events.columns)


def collection_id(name: Column, fingerprint: Column) -> Column:
    return F.concat_ws("-", slug(name), F.substring(F.sha2(fingerprint, 256), 1, 12))


def assign_event_ids(events: DataFrame, length: int = 20, most: int = 100_000) -> DataFrame:
    """``evt_`` and a prefix of the identity's hash; ids that are set stay.

    A prefix that different identities share grows by four digits. Shared prefixes are found by the
    least and the largest of what follows them, partial in each task. There are hardly any: up to
    ``most`` are fetched by one job and broadcast, so that events are not dealt anew; none cost
    nothing, and more are joined.
    """
    extra = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("extra", lambda k, _: k != "previous_event_id")))))
    whole = digest(*(extra if c == "extra" else F.col(c) for c in IDENTITY))
    hashed = events.withColumn("identity", whole).withColumn("prefix", F.substring("identity", 1, length))
    rest = F.conv(F.substring("identity", length + 1, 15), 16, 10).cast("long")
    ends = hashed.where(F.coalesce("event_id", F.lit("")) == "").groupBy("prefix").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    clash = ends.where("lo <> hi").select("prefix", F.lit(True).alias("clash"))
    few = clash.limit(most + 1).collect()
    if not few:
        grown = hashed.withColumn("clash", F.lit(False))
    elif len(few) <= most:
        grown = hashed.join(F.broadcast(events.sparkSession.createDataFrame(few, clash.schema)), "prefix", "left")
    else:
        grown = hashed.join(clash, "prefix", "left")
    fresh = F.concat(F.lit("evt_"), F.when(F.col("clash"), F.substring("identity", 1, length + 4)).otherwise(F.col("prefix")))
    return grown.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), fresh)).select(*events.columns)


def reassign_ids(events: DataFrame) -> DataFrame:
    """Compute ids anew, keep the old one in ``extra``, and follow it in ``related_event_ids``."""
    kept = events.withColumn("extra", F.map_concat("extra", F.create_map(F.lit("previous_event_id"), F.col("event_id")))).withColumn("event_id", F.lit(None).cast("string"))
    fresh = assign_event_ids(kept)
    names = fresh.select(F.col("extra.previous_event_id").alias("old"), F.col("event_id").alias("new")).where("old is not null").dropDuplicates(["old"])
    links = fresh.select("event_id", F.posexplode("related_event_ids").alias("at", "old")).distinct()
    moved = links.join(names, "old", "left").groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "old").alias("id")))), lambda s: s["id"]).alias("moved"))
    return fresh.join(moved, "event_id", "left").withColumn("related_event_ids", F.coalesce("moved", "related_event_ids")).select(*events.columns)


def order_columns() -> list[Column]:
    return [F.col("timestamp").asc_nulls_last(), F.col("source_path").asc_nulls_first(), F.col("event_action").asc_nulls_first(), F.col("raw").asc_nulls_first()]


def dedupe_events(events: DataFrame) -> DataFrame:
    """The first event, in timeline order, of those that agree in all of ``SAME``.

    Times are part of the key, so what is left of the order is source, action and text, which are
    parts too: the choice falls on ids, and a partial minimum finds it without a sort of the group.
    """
    key = digest(*(F.col(c) for c in SAME)).alias("key")
    first = F.min_by(F.struct(*events.columns), F.struct(F.coalesce("event_id", F.lit("")))).alias("e")
    return events.groupBy(key).agg(first).select("e.*")


def sort_events(events: DataFrame) -> DataFrame:
    return events.orderBy(*order_columns())


def filter_window(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dated events from ``start`` to ``end``, both included; either may be open."""
    inside = F.col("timestamp").isNotNull()
    if start is not None:
        inside &= F.col("timestamp") >= F.lit(start).cast("timestamp")
    if end is not None:
        inside &= F.col("timestamp") <= F.lit(end).cast("timestamp")
    return events.where(inside)


def analysis_scope(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The window and all undated events of medium severity or more; everything where there is no window."""
    if start is None and end is None:
        return events
    inside = F.lit(True)
    if start is not None:
        inside &= F.col("timestamp") >= F.lit(start).cast("timestamp")
    if end is not None:
        inside &= F.col("timestamp") <= F.lit(end).cast("timestamp")
    return events.where((F.col("timestamp").isNotNull() & inside) | (F.col("timestamp").isNull() & (severity_rank(F.col("severity")) >= 2)))


def inspect_time_range(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First and last time with their sources, and counts; log times alone where there are any."""
    log = (F.col("timestamp_type") == "log_time") & F.col("timestamp").isNotNull()
    sides = {}
    for name, used in (("log", log), ("all", F.col("timestamp").isNotNull())):
        at = F.when(used, F.struct("timestamp", "source_path"))
        sides[name] = (F.min(at).alias(f"{name}_first"), F.max(at).alias(f"{name}_last"))
    found = events.groupBy(*by).agg(F.count("*").alias("events"), F.count("timestamp").alias("timed"), F.count_if(log).alias("log_timed"), *sides["log"], *sides["all"])
    pick = lambda side, field: F.when(F.col("log_timed") > 0, F.col(f"log_{side}")[field]).otherwise(F.col(f"all_{side}")[field])
    return found.select(
        *by, "events", "timed", (F.col("events") - F.col("timed")).alias("untimed"), F.when(F.col("log_timed") > 0, "log_time").otherwise("all").alias("basis"),
        pick("first", "timestamp").alias("earliest"), pick("first", "source_path").alias("earliest_source"), pick("last", "timestamp").alias("latest"), pick("last", "source_path").alias("latest_source"),
    )


def inspect_many(events: DataFrame) -> DataFrame:
    """The ranges of all collections in one row."""
    each = inspect_time_range(events, ("collection_id",))
    return each.agg(F.count("*").alias("collections"), F.sum("events").alias("events"), F.sum("timed").alias("timed"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def mask_secrets(lines: DataFrame, source_types: tuple[str, ...] = ("shadow",), mask: str = "[masked]") -> DataFrame:
    return lines.withColumn("raw", F.when(F.col("source_type").isin(*source_types), F.lit(mask)).otherwise(F.col("raw")))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark limits the groups of each task before they meet."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def first_ids(df: DataFrame, keys: list[str], order: list[Column], n: int, id_col: str = "event_id", name: str = "event_ids") -> DataFrame:
    """Per key, its first ``n`` ids in order; groups are cut before they are gathered."""
    cut = first_n(df, keys, order, n)
    return cut.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(id_col).alias("id")))), lambda s: s["id"]).alias(name))
