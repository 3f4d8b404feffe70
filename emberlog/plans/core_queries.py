"""Queries on core, behaviour and case operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlog.functions import text, times
from emberlog.operators import behaviour as b
from emberlog.operators import cases as c
from emberlog.operators import timeline as t
from emberlog.plans.bindings import INV, SRC, TL, at, csv, inventory, query, sources, table, timeline
from emberlog.session import shared_folder, written

WEEK = 7 * 86400


@query(f"WITH {TL} SELECT event_id, at_text, event_action, event_category, usr AS user_name, src_ip, collection_id, severity, command, evidence_role FROM tl")
def to_timeline(spark, d):
    return timeline(spark, d).select("event_id", at("timestamp").alias("at_text"), "event_action", "event_category", F.col("user").alias("user_name"), "src_ip", "collection_id", "severity", "command", "evidence_role")


@query(f"WITH {TL} SELECT event_id, at_text FROM tl WHERE ts >= (SELECT min(ts) FROM tl) AND at_text BETWEEN '2024-01-05 00:00:00' AND '2024-02-01 12:00:00'")
def filter_window(spark, d):
    return t.filter_window(timeline(spark, d), "2024-01-05 00:00:00", "2024-02-01 12:00:00").select("event_id", at("timestamp").alias("at_text"))


@query(f"WITH {TL} SELECT event_id, CASE WHEN n % 3 = 0 THEN NULL ELSE at_text END AS at_text FROM tl WHERE (n % 3 <> 0 AND at_text <= '2024-02-01 12:00:00') OR (n % 3 = 0 AND severity IN ('medium', 'high', 'critical'))")
def analysis_scope(spark, d):
    tl = timeline(spark, d).withColumn("timestamp", F.when(F.substring("event_id", 2, 20).cast("long") % 3 != 0, F.col("timestamp")))
    return t.analysis_scope(tl, None, "2024-02-01 12:00:00").select("event_id", at("timestamp").alias("at_text"))


@query(f"WITH {TL} SELECT 'a' || event_id AS event_id, event_action FROM tl")
def dedupe_events(spark, d):
    tl = timeline(spark, d)
    copies = [tl.withColumn("event_id", F.concat(F.lit(p), F.col("event_id"))) for p in ("a", "b", "c")]
    return t.dedupe_events(t.union_sources(*copies)).select("event_id", "event_action")


@query(f"WITH {TL} SELECT 'x' AS part, event_id FROM tl UNION ALL SELECT 'y', event_id FROM tl WHERE event_type = 'error'")
def union_sources(spark, d):
    tl = timeline(spark, d)
    return t.union_sources(tl.select(F.lit("x").alias("part"), "event_id"), tl.where("event_action = 'ssh_login_failure'").select("event_id", F.lit("y").alias("part")))


@query(
    f"WITH {TL} SELECT event_id AS old_id, 'evt_' || substr(sha256(concat_ws(chr(31), collection_id, at_text, '', '', '', evidence_role, source_path, '', source_type, 'events', event_action, host, usr, '', '', src_ip, '', port, '', '', coalesce(command, ''), '', raw, '{{}}')), 1, 20) AS event_id FROM tl"
)
def assign_event_ids(spark, d):
    tl = timeline(spark, d)
    return t.assign_event_ids(tl.withColumn("summary", F.col("event_id")).withColumn("event_id", F.lit(None).cast("string"))).select(F.col("summary").alias("old_id"), "event_id")


@query(f"WITH {TL}, ids AS (SELECT event_id, 'evt_' || substr(sha256(concat_ws(chr(31), collection_id, at_text, '', '', '', evidence_role, source_path, '', source_type, 'events', event_action, host, usr, '', '', src_ip, '', port, '', '', coalesce(command, ''), '', raw, '{{}}')), 1, 20) AS new_id, 'e' || (n // 2) AS related FROM tl) SELECT a.new_id AS event_id, a.event_id AS previous, coalesce(b.new_id, a.related) AS related FROM ids a LEFT JOIN ids b ON a.related = b.event_id")
def reassign_ids(spark, d):
    half = F.floor(F.substring("event_id", 2, 20).cast("long") / 2).cast("string")
    tl = timeline(spark, d).withColumn("related_event_ids", F.array(F.concat(F.lit("e"), half)))
    return t.reassign_ids(tl).select("event_id", F.col("extra.previous_event_id").alias("previous"), csv("related_event_ids").alias("related"))


@query(f"WITH {TL} SELECT collection_id, count(*) AS events, count(*) FILTER (n % 5 <> 0) AS timed, count(*) FILTER (n % 5 = 0) AS untimed, 'log_time' AS basis, min(at_text) FILTER (n % 5 <> 0) AS earliest, max(at_text) FILTER (n % 5 <> 0) AS latest FROM tl GROUP BY collection_id")
def inspect_time_range(spark, d):
    tl = timeline(spark, d).withColumn("timestamp", F.when(F.substring("event_id", 2, 20).cast("long") % 5 != 0, F.col("timestamp")))
    return t.inspect_time_range(tl, ("collection_id",)).select("collection_id", "events", "timed", "untimed", "basis", at("earliest").alias("earliest"), at("latest").alias("latest"))


@query(f"WITH {TL} SELECT count(DISTINCT collection_id) AS collections, count(*)::BIGINT AS events, count(ts)::BIGINT AS timed, min(at_text) AS earliest, max(at_text) AS latest FROM tl")
def inspect_many(spark, d):
    return t.inspect_many(timeline(spark, d)).select("collections", "events", "timed", at("earliest").alias("earliest"), at("latest").alias("latest"))


@query(f"WITH {TL}, f AS (SELECT DISTINCT source_path, sha256(source_path) AS h FROM tl WHERE event_type <> 'view') SELECT event_id, h AS source_sha256, 'second' AS timestamp_precision, 'medium' AS timestamp_confidence, '1' AS parser_version FROM tl LEFT JOIN f USING (source_path)")
def attach_provenance(spark, d):
    tl = timeline(spark, d)
    files = tl.where("event_action <> 'http_request'").select(F.col("source_path").alias("relative"), F.sha2("source_path", 256).alias("sha256")).distinct()
    return t.attach_provenance(tl, files).select("event_id", "source_sha256", "timestamp_precision", "timestamp_confidence", "parser_version")


@query(f"WITH {TL} SELECT event_id, CASE WHEN event_type = 'view' THEN '2024-06-01 00:00:00' END AS time_start, CASE WHEN event_type = 'view' THEN 'low' END AS timestamp_confidence FROM tl")
def anchor_observations(spark, d):
    tl = timeline(spark, d).withColumn("timestamp", F.when(F.col("evidence_role") == "behavior", F.col("timestamp")))
    return t.anchor_observations(tl, times.acquisition_time(F.lit("host-20240601000000.tar.gz"))).select("event_id", at("time_start").alias("time_start"), "timestamp_confidence")


@query(f"WITH {TL} SELECT collection_id, min(host) AS collection_host FROM tl GROUP BY collection_id")
def collection_hosts(spark, d):
    tl = timeline(spark, d)
    return t.collection_hosts(tl, tl.select("collection_id", F.concat(F.lit("name "), "collection_id").alias("collection_name")).distinct())


@query("SELECT s_suppkey, 'supplier-' || s_suppkey || '__x-' || substr(sha256(s_suppkey::VARCHAR), 1, 12) AS collection_id FROM supplier")
def collection_id(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", t.collection_id(F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string"), F.lit("__X!")), F.col("s_suppkey").cast("string")).alias("collection_id"))


@query("SELECT s_suppkey, sha256('a/' || s_suppkey || '|1' || chr(10) || 'b/' || s_suppkey || '|2') AS source_sha256 FROM supplier")
def derived_provenance(spark, d):
    k = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", t.derived_hash(F.array(F.concat(F.lit("b/"), k, F.lit("|2")), F.concat(F.lit("a/"), k, F.lit("|1")))).alias("source_sha256"))


@query(
    f"""WITH {TL}, s AS (SELECT * FROM tl WHERE event_type = 'signup'), f AS (SELECT * FROM tl WHERE event_type = 'error'),
    m AS (SELECT s.event_id, s.usr, s.src_ip, s.at_text, f.event_id AS fid, row_number() OVER (PARTITION BY s.event_id ORDER BY f.ts DESC, f.event_id DESC) AS k, count(*) OVER (PARTITION BY s.event_id) AS failures
      FROM s JOIN f ON s.usr = f.usr AND s.src_ip = f.src_ip AND f.ts <= s.ts AND f.ts >= s.ts - INTERVAL 7 DAY)
    SELECT event_id, usr AS user_name, src_ip, at_text, failures, string_agg(fid, ',' ORDER BY k DESC) FILTER (k <= 5) AS failure_ids FROM m WHERE failures >= 5 GROUP BY ALL"""
)
def success_after_failures(spark, d):
    return b.success_after_failures(timeline(spark, d), WEEK, 5).select("event_id", F.col("user").alias("user_name"), "src_ip", at("timestamp").alias("at_text"), "failures", csv("failure_ids").alias("failure_ids"))


@query(
    f"""WITH {TL}, p AS (SELECT CASE event_type WHEN 'error' THEN 'audit_anomaly' WHEN 'purchase' THEN 'destructive_command' WHEN 'view' THEN 'suid_file_observed' ELSE event_action END AS action, * FROM tl),
    h AS (SELECT action AS policy, * FROM p WHERE action IN ('audit_anomaly', 'destructive_command', 'suid_file_observed') UNION ALL SELECT 'destructive_command', * FROM p WHERE n % 10 = 0),
    e AS (SELECT policy, event_id, count(*) AS c, any_value(evidence_role) AS role, any_value(confidence) AS sure, any_value(ts) AS ts FROM h GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY ts, event_id) AS r FROM e),
    g AS (SELECT policy, sum(c)::BIGINT AS hits, bool_and(role <> 'behavior') AS state_only, bool_and(sure = 'high') AS sure, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 10) AS event_ids, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM k GROUP BY policy)
    SELECT CASE policy WHEN 'audit_anomaly' THEN 'Audit Anomaly' WHEN 'destructive_command' THEN 'Destructive Command' ELSE 'Suid File Observed' END AS title, CASE WHEN state_only OR policy IN ('suid_file_observed', 'audit_anomaly') THEN 'medium' ELSE 'high' END AS severity,
      CASE WHEN state_only THEN 'low' WHEN sure THEN 'high' ELSE 'medium' END AS confidence, hits, event_ids, policy || CASE WHEN state_only THEN ',contextual_evidence,requires_corroboration' ELSE '' END AS tags, roles AS evidence_roles, 'Observed ' || hits || CASE WHEN state_only THEN ' state or inferred' ELSE '' END || ' event(s) matching ' || policy || CASE WHEN state_only THEN '; this shows no execution or action of an attacker without corroboration.' ELSE '.' END AS summary FROM g"""
)
def policy_findings(spark, d):
    a = F.col("event_action")
    action = F.when(a == "ssh_login_failure", "audit_anomaly").when(a == "sudo_command", "destructive_command").when(a == "http_request", "suid_file_observed").otherwise(a)
    names = F.when(F.substring("event_id", 2, 20).cast("long") % 10 == 0, F.array(F.lit("destructive_command"))).otherwise(F.array().cast("array<string>"))
    found = b.policy_findings(timeline(spark, d).withColumns({"event_action": action, "detection_names": names}))
    return found.withColumns({x: csv(x) for x in ("event_ids", "tags", "evidence_roles")})


@query(
    f"""WITH {TL}, u AS (SELECT src_ip, usr, count(*) AS c, min(at_text) AS a, max(at_text) AS z, row_number() OVER (PARTITION BY src_ip ORDER BY usr) AS r FROM tl WHERE event_type = 'error' GROUP BY 1, 2),
    i AS (SELECT src_ip, event_id, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS r FROM tl WHERE event_type = 'error'), f AS (SELECT src_ip, string_agg(event_id, ',' ORDER BY r) AS event_ids FROM i WHERE r <= 5 GROUP BY 1)
    SELECT src_ip, sum(c)::BIGINT AS failures, count(*) AS users, min(a) AS first_seen, max(z) AS last_seen, string_agg(usr, ',' ORDER BY usr) FILTER (r <= 10) AS first_users, any_value(event_ids) AS event_ids FROM u JOIN f USING (src_ip) GROUP BY src_ip HAVING sum(c) >= 20"""
)
def bruteforce_campaigns(spark, d):
    return b.bruteforce_campaigns(timeline(spark, d)).withColumns({"first_seen": at("first_seen"), "last_seen": at("last_seen"), "first_users": csv("first_users"), "event_ids": csv("event_ids")})


@query(f"WITH {TL} SELECT CASE event_type WHEN 'signup' THEN 'created' ELSE 'password' END AS kind, count(DISTINCT usr) AS users, count(*)::BIGINT AS events, string_agg(DISTINCT usr, ',' ORDER BY usr) AS names FROM tl WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def account_lifecycle(spark, d):
    return b.account_lifecycle(_account_events(spark, d)).withColumn("names", csv("names"))


def _account_events(spark, d):
    a = F.col("event_action")
    return timeline(spark, d).withColumn("event_action", F.when(a == "ssh_login_success", "user_created").when(a == "sudo_command", "password_changed").when(a == "http_request", "user_modified").otherwise(a))


@query(
    f"""WITH {TL}, a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM tl WHERE event_type IN ('signup', 'purchase', 'view')),
    k AS (SELECT event_type, count(DISTINCT usr) AS u, count(*) AS n, string_agg(DISTINCT usr, ', ' ORDER BY usr) AS names FROM tl GROUP BY 1)
    SELECT 'Account Lifecycle Changes Detected' AS title, 'high' AS severity, 'high' AS confidence, (SELECT string_agg(event_id, ',' ORDER BY r) FROM a WHERE r <= 15) AS event_ids, 'account_lifecycle,account_diff' AS tags,
      'Account changes detected via backup file diffing and log analysis: ' || (SELECT u || ' unique account(s) observed as created (' || names || ') across ' || n || ' supporting event(s)' FROM k WHERE event_type = 'signup')
      || '; ' || (SELECT u || ' unique account(s) with password changes or unlocks (' || names || ') across ' || n || ' supporting event(s)' FROM k WHERE event_type = 'purchase') || '.' AS summary"""
)
def account_finding(spark, d):
    """Modified accounts open the gate and are listed, but make no part of the summary."""
    return b.account_finding(_account_events(spark, d)).withColumns({"event_ids": csv("event_ids"), "tags": csv("tags")})


_SIGNALS = "CASE WHEN command LIKE 'curl%' THEN 'download_execute_chain' WHEN command = 'crontab -e' THEN 'cron_modified' WHEN command LIKE 'chmod%' THEN 'chmod_executable' WHEN command LIKE 'xmrig%' THEN 'miner_execution' END"


@query(
    f"""WITH {TL}, s AS (SELECT *, {_SIGNALS} AS signal, row_number() OVER (ORDER BY ts, event_id) AS p FROM tl),
    w AS (SELECT event_id, at_text, event_type, list(signal) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS l, last_value(at_text) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS e,
      list(CASE WHEN severity IN ('medium', 'high') THEN event_id END) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS i FROM s)
    SELECT event_id, at_text AS start_at, e AS end_at, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x IS NOT NULL))), ',') AS signals, array_to_string(list_slice(list_filter(i, lambda x: x IS NOT NULL), 1, 15), ',') AS event_ids, 'A login or web request is followed by high-signal Linux attack behaviors.' AS summary FROM w
    WHERE event_type IN ('signup', 'view') AND (list_contains(l, 'download_execute_chain') OR list_contains(l, 'cron_modified') OR (list_contains(l, 'chmod_executable') AND list_contains(l, 'miner_execution')))"""
)
def initial_access_storylines(spark, d):
    cmd = F.coalesce("command", F.lit(""))
    signal = F.when(cmd.startswith("curl"), "download_execute_chain").when(cmd == "crontab -e", "cron_modified").when(cmd.startswith("chmod"), "chmod_executable").when(cmd.startswith("xmrig"), "miner_execution")
    tl = timeline(spark, d).withColumn("detection_names", F.array_compact(F.array(signal)))
    found = b.initial_access_storylines(tl)
    return found.select("event_id", at("start").alias("start_at"), at("end").alias("end_at"), csv("signals").alias("signals"), csv("event_ids").alias("event_ids"), "summary")


@query(
    f"""WITH {TL}, u AS (SELECT * FROM tl WHERE event_type IN ('error', 'signup')), c AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, count(*) FILTER (event_type = 'error') OVER (PARTITION BY src_ip) AS a, min(at_text) FILTER (event_type = 'error') OVER (PARTITION BY src_ip) AS began FROM u),
    s AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS r FROM c WHERE event_type = 'signup' AND b >= 5 AND a >= 10), f AS (SELECT * FROM s WHERE r = 1),
    m AS (SELECT f.event_id, e.event_id AS fid, row_number() OVER (PARTITION BY f.event_id ORDER BY e.ts DESC, e.event_id DESC) AS k FROM f JOIN u e ON e.event_type = 'error' AND e.src_ip = f.src_ip AND e.ts <= f.ts),
    three AS (SELECT event_id, string_agg(fid, ',' ORDER BY fid) AS failure_ids, string_agg(fid, ',' ORDER BY k DESC) AS before_ids FROM m WHERE k <= 3 GROUP BY 1),
    n AS (SELECT f.event_id, t.event_id AS nid, t.at_text AS n_at, row_number() OVER (PARTITION BY f.event_id ORDER BY t.ts, t.event_id) AS k FROM f JOIN tl t ON t.event_type IN ('purchase', 'click') AND t.ts >= f.ts),
    ten AS (SELECT event_id, string_agg(nid, ',' ORDER BY k) AS next_ids, max(n_at) AS z, count(*) AS c FROM n WHERE k <= 10 GROUP BY 1)
    SELECT src_ip, f.event_id, usr AS user_name, began AS start_at, greatest(at_text, coalesce(z, at_text)) AS end_at, b AS failures_before, a AS all_failures, failure_ids, coalesce(next_ids, '') AS next_ids, before_ids || ',' || f.event_id || coalesce(',' || next_ids, '') AS event_ids, b || ' failed attempts from ' || src_ip || ' preceded a successful ' || usr || ' login. ' || coalesce(c, 0) || ' post-access events followed.' AS summary
    FROM f JOIN three ON f.event_id = three.event_id LEFT JOIN ten ON f.event_id = ten.event_id"""
)
def bruteforce_storylines(spark, d):
    return b.bruteforce_storylines(timeline(spark, d)).select("src_ip", "event_id", F.col("user").alias("user_name"), at("start").alias("start_at"), at("end").alias("end_at"), "failures_before", "all_failures", *(csv(x).alias(x) for x in ("failure_ids", "next_ids", "event_ids")), "summary")


@query(
    f"""WITH {TL}, a AS (SELECT event_id, ts FROM tl WHERE event_type = 'signup'), p AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS k FROM tl WHERE event_type = 'purchase'),
    c AS (SELECT a.event_id, min(p.k) AS k FROM a ASOF JOIN (SELECT ts, min(k) AS k FROM p GROUP BY ts) p ON p.ts >= a.ts GROUP BY 1)
    SELECT c.event_id, string_agg(p.event_id, ',' ORDER BY p.k) AS next_ids FROM c JOIN p ON p.k >= c.k AND p.k < c.k + 10 GROUP BY 1"""
)
def following_events(spark, d):
    tl = timeline(spark, d)
    anchors = tl.where("event_action = 'ssh_login_success'").select("event_id", F.col("timestamp").alias("start"))
    return b.following_events(tl, anchors, ("sudo_command",), 10).select("event_id", csv("next_ids").alias("next_ids"))


@query(f"WITH {TL}, u AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM tl WHERE event_type = 'signup') SELECT 'Credential modification activity' AS title, 'medium' AS confidence, count(*) AS events, min(at_text) AS start_at, max(at_text) AS end_at, count(DISTINCT usr) AS users, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 15) AS event_ids, count(*) || ' credential change(s) detected for user(s): ' || string_agg(DISTINCT usr, ', ' ORDER BY usr) || '. Review whether these changes were authorized.' AS summary FROM u HAVING count(*) > 0")
def credential_storyline(spark, d):
    found = b.credential_storyline(timeline(spark, d), ("ssh_login_success",))
    return found.select("title", "confidence", "events", at("start").alias("start_at"), at("end").alias("end_at"), "users", csv("event_ids").alias("event_ids"), "summary")


@query(f"WITH {TL}, k AS (SELECT usr, event_id, row_number() OVER (PARTITION BY usr ORDER BY ts DESC, event_id) AS place FROM tl) SELECT usr AS user_name, event_id, place::INT AS place FROM k WHERE place <= 3")
def rank_first_n(spark, d):
    return t.first_n(timeline(spark, d).select("user", "event_id", "timestamp"), ["user"], [F.desc("timestamp"), F.col("event_id")], 3).select(F.col("user").alias("user_name"), "event_id", "place")


@query(f"WITH {TL} SELECT event_id, usr AS user_name, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY usr ORDER BY ts, event_id)))::BIGINT AS gap_seconds FROM tl")
def lag_gap(spark, d):
    return b.lag_gap(timeline(spark, d)).select("event_id", F.col("user").alias("user_name"), "gap_seconds")


def _shared(kind: str, value: str, where: str, high: str, title: str, summary: str) -> str:
    return f"""WITH {TL}, u AS (SELECT *, {value} AS value, {high} AS high FROM tl WHERE {where}), k AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY ts, event_id) AS r FROM u WHERE value IS NOT NULL),
    g AS (SELECT CASE WHEN bool_or(high) THEN 'high' ELSE 'medium' END AS severity, value, count(DISTINCT collection_id) AS collections, count(*)::BIGINT AS events, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'signup') AS successes, string_agg(DISTINCT collection_id, ',' ORDER BY collection_id) AS collection_names, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 20) AS event_ids FROM k GROUP BY value)
    SELECT '{kind}' AS type, {title} AS title, {summary} AS summary, {'*' if kind == 'shared_source_ip' else '* EXCLUDE (failures, successes)'} FROM g WHERE collections >= 2"""


_ADDRESS = _shared(
    "shared_source_ip", "host", "event_category = 'authentication'", "event_type = 'signup'", "'Shared authentication source IP across ' || collections || ' collections'",
    "value || ' appears in authentication activity across ' || collections || ' collections with ' || failures || ' failure(s) and ' || successes || ' success(es). Treat as shared activity observed unless outbound host-to-host evidence exists.'",
)


def _texts(df):
    return df.withColumns({"collection_names": csv("collection_names"), "event_ids": csv("event_ids")})


@query(_ADDRESS)
def shared_source_ip(spark, d):
    """Hosts stand for the addresses, which collections share."""
    return _texts(c.shared_source_ip(timeline(spark, d).withColumn("src_ip", F.col("host"))))


@query(_shared("shared_user_activity", "host", "event_type IN ('signup', 'purchase')", "false", "'Shared suspicious user activity: ' || value", "'User ' || value || ' appears in suspicious authentication, sudo, or account activity across ' || collections || ' collections.'"))
def shared_user(spark, d):
    return _texts(c.shared_user(timeline(spark, d).withColumn("user", F.col("host"))))


@query(_shared("shared_tooling", "CASE WHEN command LIKE 'xmrig%' THEN 'xmrig' WHEN command LIKE 'rclone%' THEN 'rclone' END", "true", "true", "'Shared tool observed: ' || value", "value || ' appears across ' || collections || ' collections. Treat as shared tooling observed pending raw-line validation.'"))
def shared_tool(spark, d):
    return _texts(c.shared_tool(timeline(spark, d)))


@query(_shared("shared_suspicious_path", "CASE WHEN command LIKE 'chmod%' THEN '/tmp/run' WHEN command LIKE 'tar%' THEN '/tmp/b.tgz' END", "true", "false", "'Shared suspicious path: ' || value", "value || ' appears in suspicious path activity across ' || collections || ' collections.'"))
def shared_path(spark, d):
    return _texts(c.shared_path(timeline(spark, d)))


_HIGH = f"""WITH {TL}, u AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM tl WHERE severity = 'high'),
    g AS (SELECT count(*) AS events, count(DISTINCT collection_id) AS collections, min(at_text) AS first_seen, max(at_text) AS last_seen, string_agg(DISTINCT collection_id, ',' ORDER BY collection_id) AS collection_names, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 30) AS event_ids FROM u)
    SELECT 'cross_host_high_signal_timeline' AS type, 'medium' AS severity, 'Cross-collection high-signal activity timeline' AS title, 'high_signal_timeline' AS value, *,
      events || ' high-signal event(s) span ' || collections || ' collections between ' || replace(first_seen, ' ', 'T') || 'Z and ' || replace(last_seen, ' ', 'T') || 'Z. This is a possible campaign-level pattern, not lateral movement by itself.' AS summary FROM g"""


@query(_HIGH)
def cross_host_high_signal(spark, d):
    return _texts(c.cross_host_high_signal(timeline(spark, d)).withColumns({"first_seen": at("first_seen"), "last_seen": at("last_seen")}))


@query(f"SELECT type, title, summary, severity, value, collections, events, collection_names, event_ids FROM ({_ADDRESS}) UNION ALL SELECT type, title, summary, severity, value, collections, events, collection_names, event_ids FROM ({_HIGH})")
def incremental_correlations(spark, d):
    """Two collections summarised and written, then a third: the correlations are those of all three."""
    tl = timeline(spark, d).withColumn("src_ip", F.col("host"))
    before = written(c.case_summaries(tl.where("collection_id <> 'c1'")), "summaries")
    after = before.unionByName(written(c.case_summaries(tl.where("collection_id = 'c1'")), "summaries"))
    found = c.correlations(after).where("type in ('shared_source_ip', 'cross_host_high_signal_timeline')")
    return _texts(found.select("type", "title", "summary", "severity", "value", "collections", "events", "collection_names", "event_ids"))


@query(f"SELECT title, severity, 'medium' AS confidence, summary, event_ids, collection_names AS collections, 'case_correlation,shared_source_ip' AS tags FROM ({_ADDRESS})")
def correlations_to_findings(spark, d):
    return c.correlations_to_findings(c.shared_source_ip(timeline(spark, d).withColumn("src_ip", F.col("host")))).withColumns({"event_ids": csv("event_ids"), "collections": csv("collections"), "tags": csv("tags")})


@query(f"WITH {TL}, {SRC}, a AS (SELECT collection_id, count(*) AS events, count(ts) AS timed, count(*) FILTER (severity = 'high') AS high_events FROM tl GROUP BY 1), b AS (SELECT collection_id, count(*) AS sources, count(*) FILTER (parser_status = 'error') AS errors FROM src GROUP BY 1) SELECT * FROM a FULL JOIN b USING (collection_id)")
def case_source_index(spark, d):
    return c.case_source_index(timeline(spark, d), sources(spark, d))


@query(f"WITH {SRC} SELECT parser_status, count(*) AS sources, count(DISTINCT source_type) AS source_types, sum(event_count)::BIGINT AS events FROM src GROUP BY 1")
def source_coverage(spark, d):
    return c.source_coverage(sources(spark, d))


@query(f"WITH {INV}, k AS (SELECT *, row_number() OVER (PARTITION BY coverage_status ORDER BY relative, key) AS r FROM inv) SELECT coverage_status, count(*) AS files, string_agg(relative, ',' ORDER BY r) FILTER (r <= 10) AS first_files FROM k GROUP BY 1")
def evidence_coverage(spark, d):
    return c.evidence_coverage(inventory(spark, d)).withColumn("first_files", csv("first_files"))


@query(f"WITH {INV}, l AS (SELECT DISTINCT collection_id, relative || '|' || size || '|' || sha256 AS line FROM inv) SELECT collection_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM l GROUP BY 1")
def collection_fingerprint(spark, d):
    return c.collection_fingerprint(inventory(spark, d))


_FP = "fp AS (SELECT 'c' || s_suppkey AS collection_id, sha256((s_suppkey % 40)::VARCHAR) AS fingerprint FROM supplier)"


def _fingerprints(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("collection_id"), F.sha2((k % 40).cast("string"), 256).alias("fingerprint"))


@query(f"WITH {_FP} SELECT fingerprint, min(collection_id) AS canonical, string_agg(collection_id, ',' ORDER BY collection_id) AS collections FROM fp GROUP BY 1 HAVING count(*) > 1")
def duplicate_collections(spark, d):
    return c.duplicate_collections(_fingerprints(spark, d)).withColumn("collections", csv("collections"))


@query(f"WITH {TL}, {_FP}, r AS (SELECT collection_id FROM (SELECT *, min(collection_id) OVER (PARTITION BY fingerprint) AS m FROM fp) WHERE collection_id <> m) SELECT event_id FROM tl WHERE 'c' || (n % 100) NOT IN (SELECT collection_id FROM r)")
def exclude_duplicates(spark, d):
    tl = timeline(spark, d).withColumn("collection_id", F.concat(F.lit("c"), (F.substring("event_id", 2, 20).cast("long") % 100).cast("string")))
    return c.exclude_duplicates(tl, _fingerprints(spark, d)).select("event_id")


@query(f"WITH {TL} SELECT (SELECT count(*) FROM tl) AS events, (SELECT count(ts) FROM tl) AS timed, (SELECT count(DISTINCT collection_id) FROM tl) AS collections, count(*) AS findings, count(*) AS high_findings, (SELECT count(*) FROM tl WHERE event_type = 'purchase') AS storylines FROM (SELECT DISTINCT src_ip FROM tl WHERE event_type = 'signup')")
def summary_header(spark, d):
    tl = timeline(spark, d)
    findings = tl.where("event_action = 'ssh_login_success'").select("src_ip").distinct().select(F.lit("high").alias("severity"))
    return c.summary_header(tl, findings, tl.where("event_action = 'sudo_command'"))


@query(f"WITH {_FP}, r AS (SELECT collection_id FROM (SELECT *, min(collection_id) OVER (PARTITION BY fingerprint) AS m FROM fp) WHERE collection_id <> m), k AS (SELECT *, row_number() OVER (ORDER BY collection_id) AS n FROM r) SELECT 'Duplicate Collection Evidence Detected' AS title, 'medium' AS severity, 'Detected ' || count(*) || ' byte-equivalent repeated collection(s).' AS summary, count(*) AS repeated, string_agg(collection_id, ',' ORDER BY n) FILTER (n <= 50) AS collections FROM k HAVING count(*) > 0")
def duplicate_finding(spark, d):
    return c.duplicate_finding(_fingerprints(spark, d)).select("title", "severity", "summary", "repeated", csv("collections").alias("collections"))


@query(f"WITH {TL}, u AS (SELECT DISTINCT event_type AS change, usr FROM tl), k AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY usr) AS r FROM u) SELECT change, count(*) AS users, string_agg(usr, ',' ORDER BY r) FILTER (r <= 10) AS first_users FROM k GROUP BY 1")
def account_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("change"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"))
    return c.account_summary(e).withColumn("first_users", csv("first_users"))


@query(f"WITH {TL} SELECT event_id, CASE WHEN n % 2 = 0 AND severity IN ('informational', 'low') THEN 'medium' ELSE severity END AS severity FROM tl")
def merge_severity(spark, d):
    other = F.when(F.substring("event_id", 2, 20).cast("long") % 2 == 0, "medium").otherwise("informational")
    return timeline(spark, d).select("event_id", text.merge_severity(F.col("severity"), other).alias("severity"))




@query(f"WITH {TL} SELECT event_id, coalesce(host, '') AS host, 'name ' || collection_id AS collection_name, 'in ' || collection_id AS collection_input FROM tl")
def attach_collection(spark, d):
    tl = timeline(spark, d)
    names = tl.select("collection_id").distinct().select("collection_id", *(F.concat(F.lit(p), "collection_id").alias(c) for p, c in (("name ", "collection_name"), ("in ", "collection_input"), ("h ", "collection_host"))))
    return t.attach_collection(tl, names).select("event_id", "host", "collection_name", "collection_input")


@query(f"WITH {TL} SELECT event_id, CASE WHEN source_type = 'web_log' THEN '[masked]' ELSE raw END AS raw FROM tl")
def mask_secrets(spark, d):
    return t.mask_secrets(timeline(spark, d), ("web_log",)).select("event_id", "raw")


@query(f"WITH {TL} SELECT row_number() OVER (ORDER BY ts NULLS LAST, source_path, event_action, raw) AS place, event_id FROM (SELECT * REPLACE (CASE WHEN n % 11 <> 0 THEN ts END AS ts) FROM tl)")
def sort_events(spark, d):
    """The order itself: places are told by the rows of a partition and of those before it."""
    undated = F.substring("event_id", 2, 20).cast("long") % 11 == 0
    tl = timeline(spark, d).withColumn("timestamp", F.when(~undated, F.col("timestamp")))
    folder = f"{shared_folder(spark)}/emberlog-files-{uuid.uuid4().hex}/sorted"
    t.sort_events(tl).select("event_id", F.monotonically_increasing_id().alias("id")).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumns({"part": F.shiftright("id", 33), "inside": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(t.Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select((F.col("inside") + F.col("before") + 1).alias("place"), "event_id")


@query(f"WITH {TL} SELECT DISTINCT 'evt_' || substr(sha256(concat_ws(chr(31), collection_id, at_text, '', '', '', evidence_role, source_path, '', source_type, 'events', event_action, host, usr, '', '', src_ip, '', port, '', '', coalesce(command, ''), '', raw, '{{}}')), 1, 20) AS event_id, event_action FROM tl")
def case_timeline(spark, d):
    tl = timeline(spark, d)
    return c.case_timeline(tl, tl).select("event_id", "event_action")


@query(f"WITH {INV}, l AS (SELECT DISTINCT collection_id, relative || '|' || sha256 || '|' || size AS line FROM inv) SELECT collection_id, sha256('exchange-v1' || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM l GROUP BY 1")
def exchange_fingerprint(spark, d):
    return c.exchange_fingerprint(inventory(spark, d))


@query(
    f"""WITH {TL}, x AS (SELECT event_id, ts, unnest(CASE event_type WHEN 'error' THEN ['ssh_login_failure', 'spray', 'ttp.spray'] WHEN 'signup' THEN ['ssh_login_success'] ELSE [] END) AS signal FROM tl),
    e AS (SELECT event_id, min(struct_pack(k := CASE signal WHEN 'ssh_login_success' THEN 1 ELSE 0 END, s := signal, t := ts)) AS place FROM x WHERE signal IN ('ssh_login_failure', 'ttp.spray', 'ssh_login_success') GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY place, event_id) AS n FROM e)
    SELECT 'spray' AS profile_id, 'Spray' AS title, 'medium' AS confidence, 'ssh_login_failure,ttp.spray' AS strong, 'ssh_login_success' AS supporting, count(*) AS events, string_agg(event_id, ',' ORDER BY n) FILTER (n <= 15) AS event_ids FROM r"""
)
def actor_similarity(spark, d):
    """Of five profiles only the first has enough strong and supporting indicators, one of those it requires, and enough events."""
    base = {"strong_indicators": ["ssh_login_failure", "ttp.spray"], "supporting_indicators": ["ssh_login_success"], "display_name": "Spray", "confidence_cap": "medium"}
    profiles = {"spray": base | {"required_any_indicators": ["spray", "nothing"]}, "needy": base | {"required_any_indicators": ["nothing"]}, "strict": base | {"minimum_strong_indicators": 3}, "wide": base | {"required_evidence_count": 4}, "rare": {"strong_indicators": ["sudo_command"], "supporting_indicators": ["no such"]}}
    tl = timeline(spark, d).withColumn("ttp_flags", F.array_compact(F.array(F.when(F.col("event_action") == "ssh_login_failure", F.lit("spray")))))
    return b.actor_similarity(tl, profiles).select("profile_id", "title", "confidence", csv("matched_strong").alias("strong"), csv("matched_supporting").alias("supporting"), "events", csv("event_ids").alias("event_ids"))


@query(
    f"""WITH {TL}, a AS (SELECT usr, count(*) AS n FROM tl WHERE event_type = 'view' GROUP BY 1)
    SELECT title, severity, confidence, summary FROM (
      SELECT 'SSH Brute-Force Campaign from ' || src_ip AS title, 'high' AS severity, 'high' AS confidence, count(*) || ' failed SSH attempts from ' || src_ip || ' targeting ' || count(DISTINCT usr) || ' user(s) between ' || replace(min(at_text), ' ', 'T') || 'Z and ' || replace(max(at_text), ' ', 'T') || 'Z. Targeted users include: ' || array_to_string(list_slice(list_sort(list(DISTINCT usr)), 1, 10), ', ') || CASE WHEN count(DISTINCT usr) > 10 THEN ' and ' || (count(DISTINCT usr) - 10) || ' more' ELSE '' END AS summary FROM tl WHERE event_type = 'error' GROUP BY src_ip HAVING count(*) >= 20
      UNION ALL SELECT 'Suid File Observed', 'medium', 'low', 'Observed ' || count(*) || ' state or inferred event(s) matching suid_file_observed; this shows no execution or action of an attacker without corroboration.' FROM tl WHERE event_type = 'view'
      UNION ALL SELECT 'Lateral Movement Assessment Has Coverage Gaps', 'informational', 'low', 'No outbound lateral-movement evidence was observed in the available sources, but coverage is incomplete. Missing: SSH host history, network state.'
      UNION ALL SELECT 'Successful SSH login after repeated failures', 'high', 'medium', s.usr || ' logged in from ' || s.src_ip || ' after ' || count(*) || ' failed attempts within 30 minutes.' FROM tl s JOIN tl f ON s.event_type = 'signup' AND f.event_type = 'error' AND s.usr = f.usr AND s.src_ip = f.src_ip AND f.ts <= s.ts AND f.ts >= s.ts - INTERVAL 30 MINUTE GROUP BY s.event_id, s.usr, s.src_ip HAVING count(*) >= 5)"""
)
def derive_findings(spark, d):
    a = F.col("event_action")
    tl = timeline(spark, d).withColumn("event_action", F.when(a == "http_request", "suid_file_observed").otherwise(a))
    return b.derive_findings(tl).select("title", "severity", "confidence", "summary")


_OUT = "'Outbound Lateral Movement Evidence' AS title, 'high' AS severity, 'medium' AS confidence"


@query(
    f"""WITH {TL}, k AS (SELECT CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS kind, * FROM tl WHERE event_type IN ('error', 'signup') OR event_type = 'view' AND n % 3 = 0),
    o AS (SELECT event_id, row_number() OVER (ORDER BY kind, ts, event_id) AS r FROM k), d AS (SELECT DISTINCT src_ip FROM k WHERE kind < 2 ORDER BY 1 LIMIT 10)
    SELECT {_OUT}, count(*)::BIGINT AS indicators, '' AS missing, (SELECT string_agg(event_id, ',' ORDER BY r) FROM o WHERE r <= 15) AS event_ids, 'lateral_movement,outbound' AS tags,
      'Found ' || count(*) || ' action indicator(s) of outbound lateral movement: ' || count(*) FILTER (kind = 0) || ' SSH commands, ' || count(*) FILTER (kind = 1) || ' file transfers, and ' || count(*) FILTER (kind = 2) || ' active SSH connections. Destinations: ' || (SELECT string_agg(src_ip, ', ' ORDER BY src_ip) FROM d) AS summary FROM k"""
)
def lateral_movement(spark, d):
    """Failures, logins and a third of the requests stand for the three kinds; requests have no destination."""
    a = F.col("event_action")
    third = F.substring("event_id", 2, 20).cast("long") % 3 == 0
    name = F.when(a == "ssh_login_failure", "outbound_ssh_command").when(a == "ssh_login_success", "outbound_file_transfer_command").when((a == "http_request") & third, "outbound_ssh_connection")
    tl = timeline(spark, d).withColumns({"detection_names": F.array_compact(F.array(name)), "dst_ip": F.when(a != "http_request", F.col("src_ip"))})
    return _listed(b.lateral_movement_findings(tl))


def _listed(findings):
    return findings.withColumns({"event_ids": csv("event_ids"), "tags": csv("tags")})


@query(
    f"""WITH {TL}, g AS (SELECT * FROM (VALUES ('command history', ['shell_history']), ('network state', ['ss_output', 'netstat_output', 'network_state']), ('SSH host history', ['known_hosts'])) v(name, kinds)), m AS (SELECT name FROM g WHERE NOT EXISTS (SELECT 1 FROM tl WHERE list_contains(g.kinds, tl.source_type) AND tl.event_type IN ('click', 'view'))),
    h AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r FROM tl WHERE event_type = 'view')
    SELECT 'Lateral Movement Assessment Has Coverage Gaps' AS title, 'informational' AS severity, 'low' AS confidence, 0::BIGINT AS indicators, string_agg(name, ',' ORDER BY name) AS missing, '' AS event_ids, 'lateral_movement,coverage_gap,inconclusive_finding' AS tags,
      'No outbound lateral-movement evidence was observed in the available sources, but coverage is incomplete. Missing: ' || string_agg(name, ', ' ORDER BY name) || '.' AS summary FROM m HAVING count(*) > 0
    UNION ALL SELECT 'Known SSH Destination Observed', 'low', 'low', count(*)::BIGINT, '', string_agg(event_id, ',' ORDER BY r) FILTER (r <= 15), 'ssh,known_hosts,contextual_evidence,not_lateral_movement_by_itself',
      'Observed ' || count(*) || ' SSH known-host entries. This is historical destination context and does not establish an outbound connection or lateral movement.' FROM h HAVING count(*) > 0"""
)
def lateral_movement_gaps(spark, d):
    tl = timeline(spark, d).where("event_action in ('shell_command', 'http_request')")
    a = F.col("event_action")
    return _listed(b.lateral_movement_findings(tl.withColumn("event_action", F.when(a == "http_request", "known_host_observed").otherwise(a))))


@query(f"WITH {TL}, k AS (SELECT raw, row_number() OVER (ORDER BY raw) AS r FROM tl WHERE severity IN ('medium', 'high')) SELECT count(*) FILTER (event_type = 'view') AS listeners, count(*) FILTER (event_type = 'click') AS inbound, count(*) FILTER (event_type = 'error') AS outbound, count(*) FILTER (n % 9 = 0) AS untimed, count(*) FILTER (severity IN ('medium', 'high')) AS suspicious, (SELECT string_agg(raw, ',' ORDER BY raw) FROM k WHERE r <= 10) AS first_suspicious FROM tl")
def network_state_summary(spark, d):
    a = F.col("event_action")
    undated = F.substring("event_id", 2, 20).cast("long") % 9 == 0
    tl = timeline(spark, d).withColumns({"source_type": F.lit("network_state"), "summary": F.col("raw"), "timestamp": F.when(~undated, F.col("timestamp")), "event_action": F.when(a == "http_request", "listening_port").when(a == "shell_command", "inbound_connection").when(a == "ssh_login_failure", "outbound_connection").otherwise("connection_observed")})
    return c.network_state_summary(tl).withColumn("first_suspicious", csv("first_suspicious"))
