"""Queries on rules, correlation, snapshots, review, assistance, exchange, audit and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import correlate as k
from emberlog.operators import review as r
from emberlog.operators import rules
from emberlog.operators import timeline as t
from emberlog.plans.bindings import INV, SRC, TL, annotations, at, csv, inventory, query, sources, table, timeline
from emberlog.sources import readers, sinks

_TOKEN = lambda c, x: f"regexp_matches({c}, '(^|[^a-z0-9_.-])({x})($|[^a-z0-9_.-])')"
#: Rules as SQL conditions on low (all text) and ran (executed text), in order of name.
_RULES = {
    "account_or_privilege_change": r"regexp_matches(ran, '\b(sudo\s+-l|sudo\s+su|su\s+-|usermod|useradd|adduser|groupmod|gpasswd)\b')",
    "archive_creation_candidate": r"regexp_matches(ran, '\b(tar|zip|7z|rar|gzip|xz)\b.*\b(/home|/var/www|/etc|/root|/opt|/srv)\b')",
    "chmod_executable": r"regexp_matches(ran, '\bchmod\s+\+?x\b')",
    "cloud_container_tool": _TOKEN("ran", "kubectl|docker|crictl|ctr|nerdctl"),
    "credential_material_access": "evidence_role = 'behavior' AND regexp_matches(low, '/etc/shadow|id_rsa|id_ed25519|\\.aws/credentials|\\.kube/config|authorized_keys')",
    "cron_modified": r"regexp_matches(ran, '\b(crontab|/etc/cron|cron\.d)\b')",
    "database_dump": r"regexp_matches(ran, '\b(mysqldump|pg_dump|mongodump|redis-cli\s+save)\b')",
    "destructive_command": r"regexp_matches(ran, '\b(rm\s+-rf|shred|wipe|dd\s+if=)\b')",
    "download_execute_chain": r"regexp_matches(ran, '(curl|wget)\b.*\|\s*(bash|sh|zsh)')",
    "execution_or_artifact_from_tmp": r"regexp_matches(low, '(/tmp|/var/tmp|/dev/shm|/run)/[^\s;|&]+')",
    "exfil_tool_usage": _TOKEN("ran", "rclone|megacmd|aws|gsutil|azcopy|scp|rsync|sftp"),
    "miner_execution": _TOKEN("ran", "xmrig|kinsing|minerd|xmr-stak"),
    "network_scanner": _TOKEN("ran", "nmap|masscan|zmap"),
    "outbound_ssh_command": r"regexp_matches(ran, '\bssh\s+[^-\s]\S*@\S+')",
    "plaintext_password_in_history": "source_type = 'shell_history' AND command = 'Passw0rd!x'",
    "tunnel_or_proxy_tool": _TOKEN("ran", "chisel|frp|ngrok|cloudflared|socat|ncat|nc"),
}
_HITS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in _RULES.items()) + "], lambda x: x IS NOT NULL), ',')"
_LOW = "lower(concat_ws(' ', command, raw)) AS low, lower(coalesce(command, '')) AS ran"
_FOUND = f"fd AS (SELECT *, {_HITS} AS names FROM (SELECT *, {_LOW} FROM tl))"


@query(f"WITH {TL}, {_FOUND} SELECT event_id, names AS detections, CASE WHEN regexp_matches(names, 'plaintext') THEN 'critical' WHEN regexp_matches(names, 'credential|database|destructive|download|exfil|miner|outbound|tunnel') THEN 'high' WHEN names <> '' AND severity IN ('informational', 'low') THEN 'medium' ELSE severity END AS severity FROM fd")
def builtin_rules(spark, d):
    return rules.apply_builtin_rules(timeline(spark, d)).select("event_id", csv("detection_names").alias("detections"), "severity")


#: Commands for the rules that no command of the timeline meets, and the rules that each meets.
MORE_COMMANDS = {
    "sudo su": "account_or_privilege_change",
    "systemctl enable x.service": "systemd_persistence_or_service_change",
    "history -c": "log_or_history_tampering",
    "tar cf x a/home/b": "archive_creation_candidate",
    "esxcli vm list": "esxi_or_vmware_admin_command",
    "bash -i": "reverse_shell_or_tunnel_pattern",
    "curl http://169.254.169.254/": "cloud_metadata_access",
    "scp f a@b:/x": "exfil_tool_usage,outbound_file_transfer_command",
    "telnet h 22": "network_connectivity_test",
    "ls docker.sock": "docker_socket_access",
    "passwd bob": "password_set_command",
    "ngrok http": "tunnel_or_proxy_tool",
    "kubectl get pods": "cloud_container_tool",
    "passwd must change": "",
    "grep -r 'bash -i' /": "",
}
_MORE_MITRE = ("T1136.001,T1548.003", "T1543.002", "T1070", "T1560.001", "T1486", "T1059.004,T1095", "T1552.005", "T1021.004,T1105,T1567", "T1046", "T1611", "T1098", "T1090", "T1613", "", "")
_quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"WITH {TL}, m AS (SELECT *, (n % {len(MORE_COMMANDS)} + 1)::INT AS i FROM tl) SELECT event_id, {_quoted(MORE_COMMANDS.values())}[i] AS detections, CASE event_type WHEN 'view' THEN '' ELSE {_quoted(_MORE_MITRE)}[i] END AS mitre, CASE event_type WHEN 'view' THEN {_quoted(_MORE_MITRE)}[i] ELSE '' END AS candidates FROM m")
def more_builtin_rules(spark, d):
    n = F.substring("event_id", 2, 20).cast("long")
    tl = timeline(spark, d).withColumn("command", F.element_at(F.array(*map(F.lit, MORE_COMMANDS)), (n % len(MORE_COMMANDS) + 1).cast("int")))
    return rules.apply_builtin_rules(tl).select("event_id", csv("detection_names").alias("detections"), csv("mitre").alias("mitre"), csv("mitre_candidates").alias("candidates"))


_BUILTIN = "t0 AS (SELECT *, CASE WHEN command LIKE 'nmap%' THEN 'tool_nmap_executed' WHEN command LIKE 'rclone%' THEN 'tool_sync_executed' WHEN event_type = 'signup' THEN 'tool_door_observed' END AS x FROM tl)"
_TOOLS = {"nmap": {"match_literals": ["NMAP"], "category": "scan", "confidence_when_matched": "medium", "mitre": ["T1046"]}, "sync": {"match_literals": ["no-such-tool", "copy /srv"], "confidence_when_matched": "high"}, "door": {"match_literals": ["signup"], "category": "access", "confidence_when_matched": "high", "mitre": ["T1021"]}}


@query(f"WITH {TL}, {_BUILTIN} SELECT event_id, coalesce(x, '') AS detections, CASE WHEN x = 'tool_nmap_executed' AND severity IN ('informational', 'low') THEN 'medium' WHEN x = 'tool_sync_executed' THEN 'high' ELSE severity END AS severity, CASE x WHEN 'tool_nmap_executed' THEN 'T1046' WHEN 'tool_door_observed' THEN 'T1021' ELSE '' END AS mitre, CASE x WHEN 'tool_nmap_executed' THEN 'tool.nmap,tool_category.scan,tool_confidence.medium,tooling' WHEN 'tool_sync_executed' THEN 'tool.sync,tool_category.tooling,tool_confidence.high,tooling' WHEN 'tool_door_observed' THEN 'tool.door,tool_category.access,tool_confidence.high,tooling' ELSE '' END AS tags FROM t0")
def tag_tools(spark, d):
    """A tool in a command is executed; one in the text of an event that ran nothing is observed, with its techniques."""
    return rules.tag_tools(timeline(spark, d), _TOOLS).select("event_id", csv("detection_names").alias("detections"), "severity", csv("mitre").alias("mitre"), csv("tags").alias("tags"))


_TTPS = {"spray": {"match_event_actions": ["ssh_login_failure"], "severity": "high", "mitre": ["T1110"], "confidence_when_matched": "high"}, "chain": {"match_detection_names": ["spray"], "severity": "critical"}, "old": {"match_tags": ["seen"], "severity": "low"}}


@query(f"WITH {TL} SELECT event_id, CASE WHEN event_type = 'error' THEN 'spray' WHEN n % 3 = 0 THEN 'old' ELSE '' END AS detections, CASE WHEN event_type = 'error' THEN 'high' WHEN n % 3 = 0 AND severity = 'informational' THEN 'low' ELSE severity END AS severity, CASE WHEN event_type = 'error' THEN 'ttp,ttp.spray,ttp_confidence.high' WHEN n % 3 = 0 THEN 'seen,ttp,ttp.old,ttp_confidence.medium' ELSE '' END AS tags FROM tl")
def tag_ttps(spark, d):
    n = F.substring("event_id", 2, 20).cast("long")
    tl = timeline(spark, d).withColumn("tags", F.array_compact(F.array(F.when((F.col("event_action") != "ssh_login_failure") & (n % 3 == 0), F.lit("seen")))))
    return rules.tag_ttps(tl, _TTPS).select("event_id", csv("detection_names").alias("detections"), "severity", csv("tags").alias("tags"))


def _phase_tables(spark):
    techniques = spark.createDataFrame([("T1078", "initial-access"), ("T1078", "persistence"), ("T1110", "credential-access"), ("T1190", "initial-access"), ("T1190", "execution")], "mitre string, phase string")
    signals = spark.createDataFrame([("ssh_login_success", "initial-access"), ("stay", "persistence")], "signal string, phase string")
    order = spark.createDataFrame([("initial-access", 1), ("execution", 2), ("persistence", 3), ("credential-access", 4)], "phase string, place int")
    return techniques, signals, order


def _techniques(spark, d):
    """Logins and failures are confirmed, commands hint by a flag, and a state row has a technique of one phase only."""
    a, none = F.col("event_action"), F.array().cast("array<string>")
    one = lambda *names: F.array(*map(F.lit, names))
    return timeline(spark, d).withColumns(
        {
            "mitre": F.when(a.isin("ssh_login_success", "sudo_command"), one("T1078")).when(a == "ssh_login_failure", one("T1110")).when(a == "http_request", one("T1190", "T1110")).otherwise(none),
            "mitre_candidates": F.when(a == "ssh_login_failure", one("T1078")).otherwise(none),
            "ttp_flags": F.when(a == "sudo_command", one(" Stay")).otherwise(none),
        }
    )


def _phased(spark, d):
    return rules.classify_attack_phases(_techniques(spark, d), *_phase_tables(spark))


_PHASES = "CASE event_type WHEN 'signup' THEN 'initial-access' WHEN 'error' THEN 'credential-access' WHEN 'purchase' THEN 'persistence' ELSE '' END AS phases, CASE event_type WHEN 'error' THEN 'initial-access,persistence' WHEN 'view' THEN 'initial-access,execution,credential-access' ELSE '' END AS candidates"


@query(f"WITH {TL} SELECT event_id, {_PHASES} FROM tl")
def classify_attack_phases(spark, d):
    return _phased(spark, d).select("event_id", csv("attack_phases").alias("phases"), csv("attack_phase_candidates").alias("candidates"))


@query(f"WITH {TL}, c AS (SELECT {_PHASES} FROM tl), p AS (SELECT unnest(string_split(phases, ',')) AS phase, 1 AS c, 0 AS m FROM c WHERE phases <> '' UNION ALL SELECT unnest(string_split(candidates, ',')), 0, 1 FROM c WHERE candidates <> '') SELECT phase, sum(c)::BIGINT AS confirmed, sum(m)::BIGINT AS candidates FROM p GROUP BY 1")
def phase_counts(spark, d):
    return rules.phase_counts(_phased(spark, d))


@query(f"WITH {TL} SELECT event_id, CASE WHEN n % 3 = 0 OR n % 7 = 0 THEN 1 ELSE 0 END AS hunt FROM tl")
def indicator_search_guard(spark, d):
    n = F.substring("event_id", 2, 20).cast("long")
    command = F.when(n % 3 == 0, "egrep -r 'curl|wget' /var").when(n % 7 == 0, "Profile tampering: grep -E x").otherwise("grep password /etc/x")
    return timeline(spark, d).withColumn("command", command).select("event_id", F.when(rules.indicator_search(), 1).otherwise(0).alias("hunt"))


@query(
    f"""WITH {TL}, i AS (SELECT DISTINCT src_ip AS v FROM tl WHERE event_type = 'error' UNION SELECT '10.1.1.1')
    SELECT event_id, v AS ioc, 'ip' AS kind FROM tl JOIN i ON tl.src_ip = i.v OR list_contains(regexp_extract_all(coalesce(command, ''), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'), i.v)
    UNION ALL SELECT event_id, '/ETC/shadow', 'path' FROM tl WHERE command LIKE '%/etc/shadow%' UNION ALL SELECT event_id, 'xmrig', 'literal' FROM tl WHERE command LIKE 'xmrig %'
    UNION ALL SELECT event_id, 'LOG/err', 'path' FROM tl WHERE event_type = 'error' UNION ALL SELECT event_id, '2001:DB8::1', 'ip' FROM tl WHERE n % 50 = 0 UNION ALL SELECT event_id, 'MYSQLDUMP all', 'literal' FROM tl WHERE command = 'mysqldump all'"""
)
def match_iocs(spark, d):
    """Addresses of both kinds, words, phrases, and parts of paths, the source's among them; a host's name is not searched."""
    n = F.substring("event_id", 2, 20).cast("long")
    tl = timeline(spark, d).withColumn("raw", F.when(n % 50 == 0, F.concat("raw", F.lit(" from 2001:db8::1, 2001:db8::12"))).otherwise(F.col("raw")))
    ips = tl.where("event_action = 'ssh_login_failure'").select(F.col("src_ip").alias("value"), F.lit("ip").alias("kind"), F.lit("").alias("label")).distinct()
    more = spark.createDataFrame([("10.1.1.1", "ip", ""), ("/ETC/shadow", "path", ""), ("xmrig", "literal", ""), ("mrig", "literal", ""), ("LOG/err", "path", ""), ("2001:DB8::1", "ip", ""), ("MYSQLDUMP all", "literal", ""), ("ysqldump all", "literal", ""), ("h1", "domain", "")], "value string, kind string, label string")
    return k.match_iocs(tl, ips.union(more)).select("event_id", F.col("value").alias("ioc"), "kind")


@query("SELECT min(value) AS value, kind FROM (SELECT c_name AS value, 'literal' AS kind FROM customer UNION ALL SELECT lower(c_name), 'literal' FROM customer UNION ALL SELECT '10.0.0.' || (c_custkey % 250), 'ip' FROM customer) GROUP BY lower(value), kind")
def read_iocs(spark, d):
    c = table(spark, d, "customer")
    n, key = F.col("c_name"), F.col("c_custkey")
    lines = c.select((key * 10).alias("line_no"), n.alias("raw")).unionAll(c.select((key * 10 + 1).alias("line_no"), F.concat(F.lower(n), F.lit(",literal,again")).alias("raw"))).unionAll(c.select((key * 10 + 2).alias("line_no"), F.concat(F.lit(" 10.0.0."), (key % 250).cast("string")).alias("raw"))).unionAll(c.select((key * 10 + 3).alias("line_no"), F.concat(F.lit("# "), n).alias("raw")))
    return k.read_ioc_lines(lines).select("value", "kind")


@query(f"WITH {TL}, e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM tl WHERE event_type = 'error') SELECT 'Known IoC Match' AS title, count(*) AS hits, count(DISTINCT src_ip) AS iocs, count(DISTINCT event_id) AS events, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 10) AS event_ids, 'Observed ' || count(*) || ' event(s) matching ' || count(DISTINCT src_ip) || ' supplied IoC(s).' AS summary, (SELECT string_agg(src_ip, ',' ORDER BY src_ip) FROM (SELECT DISTINCT src_ip FROM e ORDER BY 1 LIMIT 50)) AS ioc_values FROM e")
def ioc_finding(spark, d):
    tl = timeline(spark, d).where("event_action = 'ssh_login_failure'")
    return k.ioc_finding(tl.select("event_id", F.col("src_ip").alias("value"))).select("title", "hits", "iocs", "events", csv("event_ids").alias("event_ids"), "summary", csv("ioc_values").alias("ioc_values"))


def _accounts(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), F.col("c_nationkey").cast("string").alias("uid"), F.col("c_mktsegment").alias("shell"), F.col("c_custkey").alias("n"))
    old = c.where("n % 10 <> 1").withColumn("shell", F.when(F.col("n") % 7 == 0, "old").otherwise(F.col("shell"))).withColumn("uid", F.when(F.col("n") % 21 == 0, "999").otherwise(F.col("uid")))
    return c.where("n % 10 <> 2"), old


@query("WITH c AS (SELECT c_custkey AS n FROM customer) SELECT 'u' || n AS user_name, CASE WHEN n % 10 = 1 THEN 'created' WHEN n % 10 = 2 THEN 'deleted' ELSE 'modified' END AS change, CASE WHEN n % 10 IN (1, 2) THEN '' WHEN n % 21 = 0 THEN 'uid,shell' ELSE 'shell' END AS changed_fields FROM c WHERE n % 10 IN (1, 2) OR n % 7 = 0")
def diff_accounts(spark, d):
    now, old = _accounts(spark, d)
    return k.diff_snapshots(now, old, "user", ("uid", "shell")).select(F.col("user").alias("user_name"), "change", csv("changed_fields").alias("changed_fields"))


@query("WITH c AS (SELECT c_custkey AS n FROM customer) SELECT 'u' || n AS user_name, CASE WHEN n % 10 = 1 THEN 'account_password_created' WHEN n % 3 = 0 AND n % 5 <> 0 THEN 'account_unlocked_since_backup' WHEN n % 3 <> 0 AND n % 5 = 0 THEN 'account_locked_since_backup' ELSE 'password_changed_since_backup' END AS change, '[masked]' AS raw FROM c WHERE n % 10 = 1 OR (n % 3 = 0) <> (n % 5 = 0) OR (n % 3 <> 0 AND n % 5 <> 0 AND n % 7 = 0)")
def diff_shadow(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), F.col("c_custkey").alias("n"))
    n = F.col("n")
    now = c.withColumn("hash", F.when(n % 5 == 0, "!").when(n % 7 == 0, "$6$new").otherwise("$6$x"))
    old = c.where("n % 10 <> 1").withColumn("hash", F.when(n % 3 == 0, "!").otherwise("$6$x"))
    return k.diff_shadow(now.select("user", "hash"), old.select("user", "hash")).select(F.col("user").alias("user_name"), "change", "raw")


@query("WITH n AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT CASE WHEN k % 5 = 0 THEN 'sudo' || k ELSE 'g' || k END AS grp, 'member_added' AS change, 'new' AS member FROM n WHERE k % 4 = 0 UNION ALL SELECT CASE WHEN k % 5 = 0 THEN 'sudo' || k ELSE 'g' || k END, 'member_removed', lower(n_name) FROM n WHERE k % 4 = 0 UNION ALL SELECT 'gone' || k, 'group_deleted', NULL FROM n WHERE k % 6 = 0")
def diff_groups(spark, d):
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    name = F.concat(F.when(key % 5 == 0, "sudo").otherwise("g"), key.cast("string"))
    base = F.array(F.lit("root"), F.lower("n_name"))
    old = n.select(name.alias("group"), base.alias("members")).unionAll(n.where("n_nationkey % 6 = 0").select(F.concat(F.lit("gone"), key.cast("string")), base))
    now = n.select(name.alias("group"), F.when(key % 4 == 0, F.array(F.lit("root"), F.lit("new"))).otherwise(base).alias("members"))
    return k.diff_groups(now, old).select(F.col("group").alias("grp"), "change", "member")


@query(f"WITH {INV}, i AS (SELECT key, relative || '-' || key AS relative FROM inv) SELECT relative, CASE WHEN key % 5 = 0 THEN 'new' WHEN key % 5 = 1 THEN 'missing' ELSE 'changed' END AS status FROM i WHERE key % 5 IN (0, 1, 2)")
def diff_inventory(spark, d):
    return k.diff_inventory(*_inventories(spark, d))


def _inventories(spark, d):
    inv = inventory(spark, d).withColumn("relative", F.concat_ws("-", "relative", "key"))
    seen = inv.where("key % 5 <> 1").withColumn("size", F.when(F.col("key") % 5 == 2, F.col("size") + 1).otherwise(F.col("size")))
    return inv.where("key % 5 <> 0"), seen


@query("SELECT 'changed_during_analysis' AS status, false AS verified, count(*) FILTER (s_suppkey % 5 = 2) AS changed, count(*) FILTER (s_suppkey % 5 = 1) AS missing, count(*) FILTER (s_suppkey % 5 = 0) AS new FROM supplier UNION ALL SELECT 'verified', true, 0, 0, 0")
def verify_inventory(spark, d):
    expected, observed = _inventories(spark, d)
    return k.verify_inventory(expected, observed).unionByName(k.verify_inventory(expected, expected))


@query(f"WITH {INV}, {SRC}, s AS (SELECT relative, bool_or(parser_status = 'error') AS e, bool_or(parser_status = 'parsed') AS p, bool_or(parser_status = 'partially_parsed') AS h FROM src GROUP BY 1) SELECT inv.relative, key, CASE WHEN s.relative IS NULL THEN coverage_status WHEN e THEN 'error' WHEN p THEN 'parsed' WHEN h THEN 'partially_parsed' ELSE 'unsupported' END AS coverage_status FROM inv LEFT JOIN s ON inv.relative = s.relative")
def sync_coverage(spark, d):
    return k.sync_coverage(inventory(spark, d), sources(spark, d)).select("relative", "key", "coverage_status")


@query("SELECT 'f' || (s_suppkey % 10) AS fingerprint, 'n' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'ref' || s_suppkey ELSE 'new_' || substr(sha256('f' || (s_suppkey % 10) || '|n' || s_suppkey || '|' || s_suppkey), 1, 16) END AS ref FROM supplier")
def assign_stable_refs(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    rows = s.select(F.concat(F.lit("f"), (key % 10).cast("string")).alias("fingerprint"), F.concat(F.lit("n"), key.cast("string")).alias("name"), key.alias("position"))
    known = rows.where("position % 2 = 0").withColumn("ref", F.concat(F.lit("ref"), F.col("position").cast("string")))
    return k.assign_stable_refs(rows, known).select("fingerprint", "name", "ref")


@query(
    f"""WITH {TL}, s AS (SELECT n % 500 AS p, ts, at_text, event_id, CASE WHEN n % 2 = 0 THEN 1 ELSE 5 END AS kind FROM tl WHERE event_type = 'click'), b AS (SELECT p, at_text, kind, row_number() OVER (PARTITION BY p ORDER BY kind, ts, event_id) AS r, string_agg(event_id, ',' ORDER BY event_id) OVER (PARTITION BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS related, count(*) OVER (PARTITION BY p) AS c FROM s)
    SELECT 's' || o_orderkey AS event_id, at_text AS found_at, CASE kind WHEN 1 THEN 'correlated_mtime' ELSE 'correlated_atime' END AS timestamp_type, 'inference' AS evidence_role, array_to_string(list_sort(string_split(related, ',')), ',') AS related, 'at ' || at_text AS timestamp_raw, 'second' AS timestamp_precision, c::VARCHAR AS matched, 'medium' AS confidence FROM orders JOIN b ON o_orderkey % 700 = b.p AND r = 1"""
)
def correlate_state_times(spark, d):
    tl = timeline(spark, d).where("event_action = 'shell_command'")
    n = F.substring("event_id", 2, 20).cast("long")
    files = tl.withColumns({"collection_id": F.lit("c"), "file_path": F.concat(F.lit("./p//"), (n % 500).cast("string")), "timestamp_type": F.when(n % 2 == 0, "mtime").otherwise("atime"), "source_type": F.lit("bodyfile"), "timestamp_raw": F.concat(F.lit("at "), at("timestamp")), "timestamp_precision": F.lit("second")})
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    state = t.to_timeline(o, {"event_id": F.concat(F.lit("s"), key.cast("string")), "collection_id": F.lit("c"), "file_path": F.concat(F.lit("/p/"), (key % 700).cast("string")), "source_type": F.lit("cron_file"), "evidence_role": F.lit("state_observation"), "confidence": F.lit("high")})
    found = k.correlate_state_times(files.unionByName(state), related=csv).where("timestamp_type like 'correlated%'")
    return found.select("event_id", at("timestamp").alias("found_at"), "timestamp_type", "evidence_role", F.col("related_event_ids").alias("related"), "timestamp_raw", "timestamp_precision", F.get_json_object("extra.correlation", "$.source_event_count").alias("matched"), "confidence")


@query("SELECT url, '/' || replace(url, '//', '/') AS path FROM pages")
def normalise_path(spark, d):
    return table(spark, d, "pages").select("url", k.normalise_path(F.concat(F.lit(" ./"), F.col("url"))).alias("path"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at_text, 'table_row' AS event_action, 'orders' AS source_path FROM orders")
def table_to_timeline(spark, d):
    tl = readers.table_to_timeline(table(spark, d, "orders"), "orders")
    return tl.select(F.get_json_object("raw", "$.o_orderkey").cast("long").alias("k"), at("timestamp").alias("at_text"), "event_action", "source_path")


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey")
def resolve_lookups(spark, d):
    names = table(spark, d, "nation").where("n_nationkey % 5 <> 0")
    return readers.resolve_lookups(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), {"nation": (names, "n_nationkey", "n_name")})


@query("SELECT o_orderpriority AS table_name, count(*) AS examined, count(*) FILTER (o_orderkey % 3 <> 0) AS emitted, count(*) FILTER (o_orderkey % 3 = 0) AS without_time FROM orders GROUP BY 1")
def table_inventory(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("table_name"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp")).alias("timestamp"))
    return readers.table_inventory(o)


@query("WITH r AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) > 7 AS truncated FROM customer) SELECT nation, c_custkey, truncated FROM r WHERE r <= 7")
def cap_rows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return readers.cap_rows(c, "nation", [F.col("c_custkey")], 7)


@query("WITH r AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) > 7 AS truncated FROM customer) SELECT nation, c_custkey, truncated FROM r WHERE r <= 7 ORDER BY nation, c_custkey LIMIT 40")
def cap_rows_in_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return readers.cap_rows(c, "nation", [F.col("c_custkey")], 7, 40)


#: Paths of files and the types that they have, for each customer in turn.
_PATHS = (
    ("logs/etc/cron.d/c{}", ("cron_file",)), ("x/var/log/auth.log.{}", ("auth_log",)), ("bodyfile{}.txt", ("bodyfile", "bodyfile_privilege")), ("var/log/kern.log.{}", ("syslog",)), ("live/ss_-tanp{}.txt", ("ss_output",)), ("live/netstat_-anp{}.txt", ("netstat_output",)),
    ("live/ps_auxwww{}.txt", ("ps_output",)), ("h{}/etc/profile", ("profile",)), ("h{}/etc/rc.local", ("rc_local",)), ("h{}/var/log/wtmp", ("login_binary",)), ("live/wtmp.txt{}", ()), ("h{}/wtmp.txt", ("login_history",)), ("var/log/zypper.log{}", ("package_log",)),
    ("var/log/nginx-{}.log", ("web_log",)), ("h{}/system.journal~", ("journal_binary",)), ("journalctl{}.txt", ("journal_text",)), ("systemctl_{}.txt", ("systemd",)), ("h{}/uac.log", ("uac_log",)), ("h{}/home/u/.ssh/known_hosts", ("known_hosts",)),
    ("h{}/home/u/deep/.ssh/known_hosts", ()), ("opt/insecure{}.txt", ()), ("opt/anacron{}", ()), ("var/log/anacron{}", ("cron",)), ("__MACOSX/etc{}/uac.log", ()), ("h{}/._auth.log", ()), ("h{}/AUTH.LOG", ()), ("h{}/.ash_history", ("shell_history",)),
)


def _listed(spark, d):
    key = F.col("c_custkey")
    path = F.element_at(F.array(*(F.lit(p) for p, _ in _PATHS)), (key % len(_PATHS) + 1).cast("int"))
    return table(spark, d, "customer").select(F.replace(path, F.lit("{}"), key.cast("string")).alias("relative"))


_LISTED = "l AS (SELECT replace(p.path, '{}', c_custkey::VARCHAR) AS relative, p.types FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{p}', {list(t)}::VARCHAR[])" for k, (p, t) in enumerate(_PATHS)) + f") p(k, path, types) ON c_custkey % {len(_PATHS)} = p.k)"


@query(f"WITH {_LISTED} SELECT DISTINCT relative, unnest(types) AS source_type FROM l")
def classify_sources(spark, d):
    return readers.classify_sources(_listed(spark, d))


@query(f"WITH {_LISTED}, t AS (SELECT DISTINCT unnest(types) AS t FROM l) SELECT c.name AS evidence_class, EXISTS (SELECT 1 FROM t WHERE list_contains(c.kinds, t.t)) AS present FROM (VALUES " + ", ".join(f"('{n}', {list(k)})" for n, k in r.EVIDENCE_CLASSES.items()) + ") c(name, kinds)")
def inventory_readiness(spark, d):
    """From paths to classes of evidence: the types of one are those of the other."""
    return r.evidence_readiness(readers.classify_sources(_listed(spark, d))).select("evidence_class", "present")


@query("SELECT 'a/._' || c_custkey AS relative, 'macos_appledouble_metadata' AS reason FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT '__MACOSX/' || c_custkey, 'macos_metadata_directory' FROM customer WHERE c_custkey % 3 = 1")
def excluded_files(spark, d):
    key = F.col("c_custkey")
    n = key.cast("string")
    files = table(spark, d, "customer").select(F.when(key % 3 == 0, F.concat(F.lit("a/._"), n)).when(key % 3 == 1, F.concat(F.lit("__MACOSX/"), n)).otherwise(F.concat(F.lit("a/b._"), n)).alias("relative"))
    return readers.excluded_files(files)


@query("WITH r AS (SELECT CASE WHEN s_suppkey % 8 = 0 THEN 'R ' || s_suppkey WHEN s_suppkey % 8 = 7 THEN 'dup' ELSE 'r' || s_suppkey END AS id, s_suppkey % 8 AS m FROM supplier), g AS (SELECT id, m, count(*) AS n FROM r GROUP BY id, m) SELECT id, list_extract(['bad_id', 'bad_severity', 'bad_technique', 'bad_namespace', 'unknown_reference', 'missing_evidence', 'repeats_match_tags', 'duplicate_id'], (m + 1)::INT) AS violation FROM g WHERE m <> 7 OR n > 1 UNION ALL SELECT 'weak', unnest(['bad_confidence_cap', 'low_evidence_count', 'no_strong_indicators', 'missing_warning']) UNION ALL SELECT 'empty', unnest(['no_literals', 'missing_category']) UNION ALL SELECT 'src2', 'bad_reference'")
def validate_rules(spark, d):
    """Each kind of fault in some rules: ids, namespaces, severities, techniques, references, texts, repeats, caps, minimums."""
    key = F.col("s_suppkey")
    at_fault = lambda r, bad, good: F.when(key % 8 == r, bad).otherwise(good)
    rule = F.to_json(F.struct(
        at_fault(3, "tool", "ttp").alias("namespace"), at_fault(5, " ", "seen").alias("evidence"), at_fault(1, "grave", "high").alias("severity"), F.lit("high").alias("confidence_when_matched"), F.array(at_fault(2, "X1", "T1003.001")).alias("mitre"), F.array(at_fault(4, "none", "src1")).alias("source_refs"), F.when(key % 8 == 6, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("match_tags"),
    ))
    ids = F.when(key % 8 == 0, F.concat(F.lit("R "), key.cast("string"))).when(key % 8 == 7, F.lit("dup")).otherwise(F.concat(F.lit("r"), key.cast("string")))
    own = table(spark, d, "supplier").select(F.lit("ttp_tags").alias("section"), ids.alias("id"), rule.alias("rule"))
    pack = {
        "source_references": {"src1": {"title": "One", "url": "https://example.org"}, "src2": {"title": "Two", "url": "http://example.org"}},
        "actor_similarity_profiles": {"weak": {"namespace": "actor_similarity", "display_name": "W", "confidence_cap": "high", "required_evidence_count": 1, "strong_indicators": []}, "fine": {"namespace": "actor_similarity", "display_name": "F", "analyst_warning": "w", "confidence_cap": "low", "required_evidence_count": 2, "strong_indicators": ["a"]}},
        "tool_tags": {"empty": {"namespace": "tool", "confidence_when_matched": "low", "match_literals": []}},
    }
    return readers.validate_rules(own.unionByName(readers.rule_table(spark, pack))).select("id", "violation")


@query("SELECT 'phase' AS kind, 'P ' || n_nationkey AS key, unnest(['bad_phase', 'bad_tactic']) AS violation FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'phase', 'p' || n_nationkey, 'missing_label' FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT 'phase', 'p' || n_nationkey, 'order_not_unique' FROM nation WHERE n_nationkey % 5 = 2 UNION ALL SELECT 'signal', 's' || n_nationkey, 'unknown_phase' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'technique', 'T' || n_nationkey, 'bad_technique' FROM nation UNION ALL SELECT 'technique', 'T' || n_nationkey, 'repeated' FROM nation WHERE n_nationkey % 5 = 3")
def validate_phases(spark, d):
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    m, text = F.col("k") % 5, F.col("k").cast("string")
    phases = n.select(F.concat(F.when(m == 0, "P ").otherwise("p"), text).alias("phase"), F.when(m == 0, "T1").otherwise("TA0001").alias("id"), F.when(m == 1, " ").otherwise("L").alias("label"), F.when(m == 2, -1).otherwise(F.col("k")).alias("place"))
    signals = n.select(F.concat(F.lit("s"), text).alias("signal"), F.concat(F.lit("p"), text).alias("phase"))
    twice = n.where("k % 5 = 3").select("k", m.alias("m"))
    techniques = n.where("k % 5 <> 0").select(F.concat(F.lit("T"), text).alias("mitre"), F.concat(F.lit("p"), text).alias("phase")).unionAll(n.where("k % 5 = 0").select(F.concat(F.lit("T"), text), F.concat(F.lit("P "), text))).unionAll(twice.select(F.concat(F.lit("T"), F.col("k").cast("string")), F.concat(F.lit("p"), F.col("k").cast("string"))))
    return readers.validate_phases(phases, signals, techniques)


@query(f"WITH {TL} SELECT event_id FROM tl WHERE severity = 'high' AND source_type = 'auth_log' AND (command LIKE '%/etc%' OR usr LIKE '%/etc%')")
def search_timeline(spark, d):
    return r.search_timeline(timeline(spark, d), "/ETC", "HIGH", "auth_log").select("event_id")


@query(f"WITH {TL} SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM tl GROUP BY 2 UNION ALL SELECT 'source_type', source_type, count(*) FROM tl GROUP BY 2 UNION ALL SELECT 'attack_phase', CASE event_type WHEN 'signup' THEN 'x' ELSE 'y' END, count(*) FROM tl WHERE event_type IN ('signup', 'error') GROUP BY 2 UNION ALL SELECT 'summary', CASE WHEN event_type = 'purchase' AND n % 2 = 0 THEN 'selected' ELSE 'unselected' END, count(*) FROM tl GROUP BY 2")
def timeline_facets(spark, d):
    a = F.col("event_action")
    tl = timeline(spark, d).withColumns({"attack_phases": F.array_compact(F.array(F.when(a == "ssh_login_success", F.lit("x")).when(a == "ssh_login_failure", F.lit("y")))), "attack_phase_candidates": F.array(F.lit("z"))})
    return r.timeline_facets(tl, r.latest_annotations(annotations(spark, d)))


@query(f"WITH {TL} SELECT event_id, (SELECT count(*) FROM tl) AS total, (SELECT count(*) > 350 FROM tl) AS has_more FROM tl ORDER BY ts, source_path, event_action, raw LIMIT 200 OFFSET 150")
def timeline_page(spark, d):
    return r.timeline_page(timeline(spark, d), 150, 1000).select("event_id", "total", "has_more")


_ANN = "ann AS (SELECT 'e' || event_id AS event_id, event_id AS n, 'tag_' || (event_id % 5) AS tags, 'note ' || event_id AS note, CASE WHEN event_id % 3 = 0 THEN 'benign' ELSE 'unreviewed' END AS disposition, event_id % 2 = 0 AS include_in_summary FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_ANN} SELECT event_id, tags, note, disposition, include_in_summary FROM ann")
def latest_annotations(spark, d):
    return r.latest_annotations(annotations(spark, d)).select("event_id", csv("tags").alias("tags"), "note", "disposition", "include_in_summary")


@query(f"WITH {TL}, {_ANN} SELECT tl.event_id, analyst_tags, analyst_note, analyst_disposition, analyst_selected, severity, raw, '' AS mitre FROM tl LEFT JOIN (SELECT event_id, tags AS analyst_tags, note AS analyst_note, disposition AS analyst_disposition, include_in_summary AS analyst_selected FROM ann) a ON tl.event_id = a.event_id")
def review_export(spark, d):
    return r.review_export(timeline(spark, d), r.latest_annotations(annotations(spark, d))).select("event_id", "analyst_tags", "analyst_note", "analyst_disposition", "analyst_selected", "severity", "raw", "mitre")


@query(f"WITH {TL}, {_ANN} SELECT tl.event_id, note, disposition FROM tl LEFT JOIN ann ON tl.event_id = ann.event_id")
def join_annotations(spark, d):
    return k.join_annotations(timeline(spark, d), r.latest_annotations(annotations(spark, d)).select("event_id", "note", "disposition")).select("event_id", "note", "disposition")


@query(f"WITH {TL} SELECT 'mini' AS asked, 'mini' AS used, count(*) FILTER (severity = 'high') AS n FROM tl UNION ALL SELECT 'mini without one', 'full', count(*) FROM tl UNION ALL SELECT 'full', 'full', count(*) FROM tl")
def select_scope(spark, d):
    tl = timeline(spark, d)
    rows = []
    for asked, mini, scope in (("mini", tl.where("severity = 'high'"), "mini"), ("mini without one", None, "mini"), ("full", tl.where("severity = 'high'"), "full")):
        df, used = r.select_scope(tl, mini, scope)
        rows.append(df.agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), F.lit(used).alias("used"), "n"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {TL}, {_ANN}, s AS (SELECT event_id FROM ann WHERE include_in_summary) SELECT (SELECT count(*) FROM tl) AS events, (SELECT count(ts) FROM tl) AS timed, (SELECT count(*) FROM s) AS selected, (SELECT count(DISTINCT host) FROM tl) AS hosts, (SELECT count(DISTINCT severity) FROM tl) AS phases, (SELECT min(at_text) FROM tl) AS first_seen, (SELECT max(at_text) FROM tl) AS last_seen, count(*) AS findings, count(*) AS high_findings, (SELECT count(*) FROM tl WHERE event_type = 'error') AS ioc_hits FROM (SELECT DISTINCT src_ip FROM tl WHERE event_type = 'signup')")
def briefing_metrics(spark, d):
    tl = timeline(spark, d).withColumns({"attack_phases": F.array("severity"), "attack_phase_candidates": F.array(F.lit("z"))})
    findings = tl.where("event_action = 'ssh_login_success'").select("src_ip").distinct().select(F.lit("critical").alias("severity"))
    out = r.briefing_metrics(tl, r.latest_annotations(annotations(spark, d)), findings, tl.where("event_action = 'ssh_login_failure'"))
    return out.withColumns({"first_seen": at("first_seen"), "last_seen": at("last_seen")})


@query(f"WITH {TL}, {_ANN} SELECT CASE event_type WHEN 'purchase' THEN 'impact' ELSE 'access' END AS phase, count(*) FILTER (event_type <> 'error') AS confirmed, count(*) FILTER (event_type = 'error') AS candidates, count(*) FILTER (include_in_summary) AS selected, min(at_text) AS first_seen, max(at_text) AS last_seen FROM tl LEFT JOIN ann USING (event_id) WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1")
def phase_breakdown(spark, d):
    a = F.col("event_action")
    tl = timeline(spark, d).withColumns({"attack_phases": F.array_compact(F.array(F.when(a == "sudo_command", F.lit("impact")).when(a == "ssh_login_success", F.lit("access")))), "attack_phase_candidates": F.array_compact(F.array(F.when(a == "ssh_login_failure", F.lit("access"))))})
    return r.phase_breakdown(tl, r.latest_annotations(annotations(spark, d))).withColumns({"first_seen": at("first_seen"), "last_seen": at("last_seen")})


@query(f"WITH {TL}, {_ANN} SELECT event_id, at_text FROM tl WHERE event_id IN (SELECT event_id FROM ann WHERE include_in_summary) ORDER BY ts, event_id LIMIT 500")
def selected_chronology(spark, d):
    return r.selected_chronology(timeline(spark, d), r.latest_annotations(annotations(spark, d))).select("event_id", at("timestamp").alias("at_text"))


@query(f"WITH {TL}, s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM tl WHERE event_type = 'purchase') SELECT count(DISTINCT usr) AS accounts, 0 AS exfiltration_events, count(*) AS impact_events, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 5) AS milestones FROM s")
def executive_rollup(spark, d):
    s = timeline(spark, d).where("event_action = 'sudo_command'").withColumn("attack_phases", F.array(F.lit("impact")))
    return r.executive_rollup(s).withColumn("milestones", csv("milestones"))


@query(f"WITH {SRC}, c AS (SELECT * FROM (VALUES ('Authentication', ['auth_log', 'login_history']), ('Audit', ['auditd']), ('Command history', ['shell_history']), ('Network state', ['ss_output', 'netstat_output']), ('Processes', ['ps_output']), ('Accounts', ['passwd', 'shadow', 'group']), ('Persistence', ['cron_file', 'systemd_unit', 'authorized_keys', 'pam_config']), ('Filesystem', ['bodyfile'])) v(evidence_class, kinds)) SELECT evidence_class, EXISTS (SELECT 1 FROM src WHERE list_contains(c.kinds, src.source_type)) AS present, count(*) FILTER (EXISTS (SELECT 1 FROM src WHERE list_contains(c.kinds, src.source_type))) OVER () || '/' || count(*) OVER () AS score FROM c")
def evidence_readiness(spark, d):
    return r.evidence_readiness(sources(spark, d))


@query(f"WITH {SRC}, g AS (SELECT * FROM (VALUES ('logins', ['auth_log', 'x']), ('files', ['bodyfile'])) v(source_group, kinds)) SELECT source_group, EXISTS (SELECT 1 FROM src WHERE list_contains(g.kinds, src.source_type)) AS available FROM g")
def profile_coverage(spark, d):
    return r.profile_coverage(sources(spark, d), {"logins": ("auth_log", "x"), "files": ("bodyfile",)})


def _findings(spark, d):
    tl = timeline(spark, d)
    return tl.where("event_action in ('ssh_login_success', 'sudo_command')").groupBy("user").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids")).select(F.col("user").alias("title"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"), "event_ids")


@query(f"WITH {TL}, f AS (SELECT usr AS title, bool_or(command LIKE '%nmap%') AS a, bool_or(command LIKE '%shadow%') AS b FROM tl WHERE event_type IN ('signup', 'purchase') GROUP BY 1) SELECT title, 'high' AS severity, (4 + least(5, 2 * (CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END)))::INT AS score, coalesce(a, false) OR coalesce(b, false) AS is_primary FROM f")
def rank_findings(spark, d):
    return r.rank_findings(_findings(spark, d), timeline(spark, d), ["nmap", "shadow"], ["T9999"]).withColumnRenamed("primary", "is_primary")


@query(f"WITH {TL}, q AS (SELECT *, CASE WHEN command LIKE '%nmap%' OR command LIKE '%rclone%' THEN 'scan' END AS question, row_number() OVER (PARTITION BY command LIKE '%nmap%' OR command LIKE '%rclone%' ORDER BY ts, event_id) AS r FROM tl) SELECT question, count(*) AS events, 'nmap,rclone' AS terms, string_agg(event_id, ',' ORDER BY r) FILTER (r <= 20) AS event_ids FROM q WHERE question IS NOT NULL GROUP BY 1")
def checklist(spark, d):
    return r.checklist(timeline(spark, d), {"scan": ("nmap", "rclone"), "none": ("no such term",)}).withColumns({"terms": csv("terms"), "event_ids": csv("event_ids")})


@query(f"WITH {TL} SELECT event_action AS signal, count(*) AS n FROM tl WHERE event_action IN ('sudo_command', 'http_request') GROUP BY 1")
def focus_signals(spark, d):
    return r.focus_signals(timeline(spark, d), ("sudo_command", "http_request", "nothing"))


@query(f"WITH {TL} SELECT event_id, CASE WHEN n % 4 = 0 THEN 'no_time' ELSE 'no_locator_or_raw' END AS reason FROM tl WHERE n % 4 = 0 OR n % 4 = 1")
def omission_ledger(spark, d):
    n = F.substring("event_id", 2, 20).cast("long")
    tl = timeline(spark, d).withColumns({"timestamp": F.when(n % 4 != 0, F.col("timestamp")), "source_path": F.when(n % 4 != 1, F.col("source_path")), "raw": F.when(n % 4 != 1, F.col("raw"))})
    return r.omission_ledger(tl).select("event_id", "reason")


@query(f"WITH {TL}, {INV} SELECT event_id, substr(sha256(collection_id || chr(0) || source_path), 1, 24) AS member_id, CASE confidence WHEN 'high' THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence, 'suspicious' AS assessment FROM tl WHERE severity IN ('high', 'medium') AND event_type <> 'signup'")
def timeline_candidates(spark, d):
    tl = timeline(spark, d).withColumn("source_sha256", F.sha2("source_path", 256))
    files = tl.where("event_action <> 'ssh_login_success'").select("collection_id", F.col("source_path").alias("relative"), F.col("source_sha256").alias("sha256")).distinct()
    return r.timeline_candidates(tl, files).select("event_id", "member_id", "confidence", "assessment")


@query(f"WITH {TL} SELECT event_id, CASE WHEN event_type = 'error' THEN substr(sha256(collection_id || chr(0) || 'var/log/signup'), 1, 24) WHEN event_type = 'signup' THEN substr(sha256(collection_id || chr(0) || source_path), 1, 24) END AS member_id FROM tl")
def resolve_source_member(spark, d):
    """By path and hash; a row derived from two files takes the first that is known; another hash is no match."""
    a = F.col("event_action")
    path = F.when(a == "ssh_login_failure", "var/log/none#3 vs /var/log/signup").when(a == "ssh_login_success", F.concat(F.lit("/"), "source_path", F.lit("#7"))).otherwise(F.col("source_path"))
    tl = timeline(spark, d).withColumns({"source_sha256": F.when(a == "http_request", "other").otherwise(F.sha2("source_path", 256)), "source_path": path})
    files = timeline(spark, d).where("event_action in ('ssh_login_success', 'http_request')").select("collection_id", F.col("source_path").alias("relative"), F.sha2("source_path", 256).alias("sha256")).distinct()
    every = timeline(spark, d).select("collection_id").distinct().select("collection_id", F.lit("var/log/signup").alias("relative"), F.sha2(F.lit("var/log/signup"), 256).alias("sha256"))
    return k.resolve_source_member(tl, files.unionByName(every).distinct()).select("event_id", "member_id")


@query(f"WITH {TL} SELECT usr AS title, 'high' AS severity, 'medium' AS confidence, count(*) AS events, 'T1' AS techniques FROM tl WHERE event_type = 'signup' GROUP BY 1")
def finding_candidates(spark, d):
    exported = timeline(spark, d).where("event_action = 'ssh_login_success'").select("event_id", F.array(F.lit("T1")).alias("mitre"))
    return r.finding_candidates(_findings(spark, d), exported).withColumn("techniques", csv("techniques"))


@query(f"WITH {TL}, c AS (SELECT n, event_id, 'can_' || substr(sha256(concat_ws(chr(31), at_text, '', '', host, source_type, event_category, event_action, usr, src_ip, '', port, '', coalesce(command, ''), '', raw)), 1, 24) AS canonical_id FROM tl) SELECT a.event_id, a.canonical_id, coalesce(b.canonical_id, 'e' || (a.n // 2)) AS related FROM c a LEFT JOIN c b ON b.event_id = 'e' || (a.n // 2)")
def canonical_events(spark, d):
    half = F.floor(F.substring("event_id", 2, 20).cast("long") / 2).cast("string")
    tl = timeline(spark, d).withColumn("related_event_ids", F.array(F.concat(F.lit("e"), half)))
    return r.canonical_ids(tl).select("event_id", "canonical_id", csv("related_event_ids").alias("related"))


@query("SELECT s_suppkey, 'SUPPLIER-' || s_suppkey || '-' || upper(substr(sha256(s_suppkey::VARCHAR), 1, 8)) AS reference FROM supplier")
def case_reference(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    return s.select("s_suppkey", r.case_reference(F.concat(F.lit("supplier "), key), key).alias("reference"))


@query(f"WITH {INV} SELECT key, substr(sha256(collection_id || chr(0) || relative), 1, 24) AS member_id FROM inv")
def member_ids(spark, d):
    return inventory(spark, d).select("key", k.member_id())


def _chain(spark, d):
    o = table(spark, d, "orders")
    order = F.row_number().over(t.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    base = o.select(F.col("o_custkey").alias("chain"), order.cast("long").alias("sequence"), F.lit("1").alias("schema_version"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.lit("note").alias("action"), F.lit("a").alias("actor"), F.col("o_orderkey").cast("string").alias("event_id"), F.lit("").alias("before"), F.col("o_orderstatus").alias("after"))
    return base, base.join(r.append_chain(base), ["chain", "sequence"])


_CHAIN = """RECURSIVE o AS (SELECT o_custkey AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at_text, o_orderkey, o_orderstatus FROM orders),
  l AS (SELECT chain, sequence, repeat('0', 64) AS previous_hash, sha256(concat_ws(chr(31), '1', sequence, at_text, 'note', 'a', o_orderkey, '', o_orderstatus, repeat('0', 64))) AS record_hash FROM o WHERE sequence = 1
    UNION ALL SELECT o.chain, o.sequence, l.record_hash, sha256(concat_ws(chr(31), '1', o.sequence, at_text, 'note', 'a', o_orderkey, '', o_orderstatus, l.record_hash)) FROM l JOIN o ON o.chain = l.chain AND o.sequence = l.sequence + 1)"""


@query(f"WITH {_CHAIN} SELECT chain, sequence, previous_hash, record_hash FROM l")
def append_chain(spark, d):
    base, _ = _chain(spark, d)
    return r.append_chain(base).select("chain", "sequence", "previous_hash", "record_hash")


@query("SELECT o_custkey AS chain, 2 AS sequence, 'record_hash' AS problem FROM orders GROUP BY 1 HAVING count(*) >= 2")
def verify_chain(spark, d):
    _, linked = _chain(spark, d)
    altered = linked.withColumn("after", F.when(F.col("sequence") == 2, "altered").otherwise(F.col("after")))
    return r.verify_chain(altered)


@query(f"WITH {TL}, {SRC} SELECT 'setting' AS section, 'mode' AS name, 'full' AS value UNION ALL SELECT 'totals', 'events', count(*)::VARCHAR FROM tl UNION ALL SELECT 'totals', 'timed', count(ts)::VARCHAR FROM tl UNION ALL SELECT 'sources', parser_status, count(*)::VARCHAR FROM src GROUP BY 2")
def run_manifest(spark, d):
    return sinks.run_manifest(timeline(spark, d), sources(spark, d), {"mode": "full"})


@query(f"WITH {TL} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text, '' AS tags, '{{}}' AS extra FROM tl")
def flat_timeline(spark, d):
    return sinks.flat(timeline(spark, d)).select("event_id", F.col("timestamp").alias("ts_text"), "tags", "extra")
