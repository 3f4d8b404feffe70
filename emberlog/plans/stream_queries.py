"""Queries that run as streams over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.plans.bindings import TL, at, query, timeline
from emberlog.streaming import timelines


def _stream(spark, d):
    return timeline(spark, d, timelines.read_stream(spark, f"{d}/events.parquet"))


@query(
    f"""WITH {TL}, e AS (SELECT * FROM tl WHERE event_type = 'error'), w AS (SELECT src_ip, unnest([0, 1, 2]) * -600 + floor(epoch(ts) / 600) * 600 AS s FROM e), m AS (SELECT max(epoch(ts)) - 600 AS mark FROM e)
    SELECT strftime(make_timestamp((s * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS window_start, src_ip, count(*) AS failures FROM w, m WHERE s + 1800 <= mark GROUP BY 1, 2"""
)
def stream_failures(spark, d):
    """Failures per address in sliding windows that the watermark has passed."""
    return timelines.run_available(timelines.stream_failures(_stream(spark, d))).select(at("window_start").alias("window_start"), "src_ip", "failures")


@query(f"WITH {TL} SELECT event_id FROM tl WHERE ts IS NOT NULL")
def stream_dedupe(spark, d):
    """Each event comes three times in the stream; the first stays."""
    twice = _stream(spark, d).unionByName(_stream(spark, d)).unionByName(_stream(spark, d))
    return timelines.run_available(timelines.stream_dedupe(twice).select("event_id", "timestamp")).select("event_id")


@query(
    f"""WITH {TL}, g AS (SELECT n // 5 AS g, host, count(*) AS n, bool_or(n % 5 = 4 AND n % 2 = 0) AS closed, min(ts) AS t, string_agg(DISTINCT CASE WHEN n % 5 = 4 AND n % 2 = 0 THEN 'EOE' ELSE event_type END, ',' ORDER BY CASE WHEN n % 5 = 4 AND n % 2 = 0 THEN 'EOE' ELSE event_type END) AS types FROM tl GROUP BY 1, 2)
    SELECT host, g::VARCHAR AS audit_id, types, n AS records FROM g, (SELECT max(epoch(ts)) - 60 AS mark FROM tl) WHERE closed OR epoch(t) + 60 < mark"""
)
def stream_audit_groups(spark, d):
    """Records of one node and id, however far apart in time, gathered at the end marker or once the watermark has passed them."""
    n = F.substring("event_id", 2, 20).cast("long")
    kind = F.when((n % 5 == 4) & (n % 2 == 0), "EOE").otherwise(F.regexp_extract("raw", "^([a-z]+)", 1))
    tl = _stream(spark, d).select("timestamp", F.col("host").alias("node"), F.floor(n / 5).cast("string").alias("audit_id"), kind.alias("type"), F.col("raw").alias("body"))
    groups = timelines.run_available(timelines.stream_audit_groups(tl))
    return groups.select(F.col("node").alias("host"), "audit_id", F.array_join("types", ",").alias("types"), F.size("bodies").cast("long").alias("records"))


@query(
    f"""WITH {TL}, s AS (SELECT * FROM tl WHERE event_type = 'signup'), f AS (SELECT * FROM tl WHERE event_type = 'error'), w AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM f)) - INTERVAL 10 MINUTE - INTERVAL 7 DAY AS mark),
    m AS (SELECT s.event_id, s.usr, s.src_ip, s.at_text, s.ts, f.event_id AS fid, row_number() OVER (PARTITION BY s.event_id ORDER BY f.ts DESC, f.event_id DESC) AS k, count(*) OVER (PARTITION BY s.event_id) AS failures
      FROM s JOIN f ON s.usr = f.usr AND s.src_ip = f.src_ip AND f.ts <= s.ts AND f.ts >= s.ts - INTERVAL 7 DAY)
    SELECT event_id, usr AS user_name, src_ip, at_text, failures, string_agg(fid, ',' ORDER BY k DESC) FILTER (k <= 5) AS failure_ids FROM m, w WHERE failures >= 5 AND ts < mark GROUP BY ALL"""
)
def stream_success_after_failures(spark, d):
    """The batch operator's rows that the watermark has passed."""
    found = timelines.run_available(timelines.stream_success_after_failures(_stream(spark, d), 7 * 86_400))
    return found.select("event_id", F.col("user").alias("user_name"), "src_ip", at("timestamp").alias("at_text"), "failures", F.array_join("failure_ids", ",").alias("failure_ids"))
