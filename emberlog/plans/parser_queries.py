"""Round trips: lines rendered from driver tables, parsed, and compared with what they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import times
from emberlog.plans.bindings import at, csv, query, table
from emberlog.sources import parsers as p


def _lines(df: DataFrame, raw: Column, path: Column | str = "var/log/x", number: Column | None = None) -> DataFrame:
    source = F.lit(path) if isinstance(path, str) else path
    return df.select(source.alias("source_path"), (F.lit(1) if number is None else number).cast("long").alias("line_no"), raw.alias("raw"))


def _events(spark, d):
    e = table(spark, d, "events")
    return e.withColumns({"ts": F.date_trunc("second", F.col("ts").cast("timestamp")), "n": F.col("event_id"), "year": F.year(F.col("ts"))})


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


_EV = "e AS (SELECT event_id AS n, user_id, event_type, value, date_trunc('second', ts) AS t, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at_text FROM events)"
_STAMP = lambda: F.date_format("ts", "MMM d HH:mm:ss")


@query(
    f"""WITH {_EV} SELECT n, at_text, CASE n % 6 WHEN 0 THEN 'ssh_login_success' WHEN 1 THEN 'ssh_login_failure' WHEN 2 THEN 'sudo_command' WHEN 3 THEN 'password_changed' WHEN 4 THEN 'user_created' ELSE 'ssh_invalid_user' END AS event_action,
    'u' || user_id AS user_name, CASE WHEN n % 6 IN (0, 1, 5) THEN '10.0.0.' || (user_id % 200) END AS src_ip, CASE n % 6 WHEN 2 THEN 'ls /x' || n END AS command, CASE n % 6 WHEN 4 THEN n::VARCHAR END AS uid, 'host' || (n % 3) AS host, n::VARCHAR AS pid FROM e"""
)
def parse_auth(spark, d):
    e = _events(spark, d)
    n, u = F.col("n"), F.col("user_id")
    ip = _text("10.0.0.", u % 200)
    body = (
        F.when(n % 6 == 0, _text("Accepted publickey for u", u, " from ", ip, " port 22")).when(n % 6 == 1, _text("Failed password for invalid user u", u, " from ", ip, " port 22"))
        .when(n % 6 == 2, _text("  u", u, " : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=ls /x", n)).when(n % 6 == 3, _text("password changed for u", u))
        .when(n % 6 == 4, _text("new user: name=u", u, ", UID=", n, ", GID=5, home=/h, shell=/bin/sh")).otherwise(_text("Invalid user u", u, " from ", ip, " port 22"))
    )
    proc = F.when(n % 6 == 2, "sudo").otherwise("sshd")
    e = e.withColumn("raw", F.concat(_STAMP(), _text(" host", n % 3, " "), proc, _text("[", n, "]: "), body))
    found = p.parse_auth(e.select(_text("log", F.col("year")).alias("source_path"), n.alias("line_no"), "raw", "year"), 2024)
    return found.select(F.col("pid").cast("long").alias("n"), at("timestamp").alias("at_text"), "event_action", F.col("user").alias("user_name"), "src_ip", "command", "uid", "host", "pid")


@query(f"WITH {_EV} SELECT n, at_text, CASE n % 4 WHEN 0 THEN 'service_started' WHEN 1 THEN 'service_stopped' WHEN 2 THEN 'session_opened' END AS event_action FROM e WHERE n % 4 <> 3")
def parse_syslog(spark, d):
    e = _events(spark, d)
    n = F.col("n")
    body = F.when(n % 4 == 0, "Started unit").when(n % 4 == 1, "Stopping unit").when(n % 4 == 2, "session opened").otherwise("nothing")
    lines = e.select(F.lit("syslog").alias("source_path"), n.alias("line_no"), F.concat(_STAMP(), _text(" h systemd[", n, "]: "), body).alias("raw"), "year")
    return p.parse_syslog(lines, 2024).select(F.col("pid").cast("long").alias("n"), at("timestamp").alias("at_text"), "event_action")


@query(f"WITH {_EV} SELECT n, at_text, CASE n % 3 WHEN 0 THEN 'journal_message' WHEN 1 THEN 'process_crash' ELSE 'cron_execution' END AS event_action, 'source_offset' AS timezone_confidence FROM e")
def parse_journal(spark, d):
    e = _events(spark, d)
    n = F.col("n")
    body = F.when(n % 3 == 0, "hello").when(n % 3 == 1, "x SegFault at 0").otherwise("(root) CRON job")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), _text("+00:00 h app[", n, "]: "), body)
    return p.parse_journal(_lines(e, raw, "journal.txt", n), 2024).select(F.col("pid").cast("long").alias("n"), at("timestamp").alias("at_text"), "event_action", "timezone_confidence")


@query(f"WITH {_EV} SELECT at_text, 'cron_execution' AS event_action, 'cron line ' || n AS tail FROM e")
def parse_cron_log(spark, d):
    e = _events(spark, d)
    lines = e.select(F.lit("cron").alias("source_path"), F.col("n").alias("line_no"), F.concat(_STAMP(), _text(" cron line ", F.col("n"))).alias("raw"), "year")
    return p.parse_cron_log(lines, 2024).select(at("timestamp").alias("at_text"), "event_action", F.regexp_extract("raw", "(cron line .*)$", 1).alias("tail"))


@query(f"WITH {_EV} SELECT 'cmd ' || n AS command, CASE WHEN n % 3 = 0 THEN NULL ELSE at_text END AS at_text, CASE WHEN n % 3 = 0 THEN 'missing' ELSE 'source_epoch' END AS timezone_confidence FROM e")
def parse_shell_history(spark, d):
    e = _events(spark, d)
    n = F.col("n")
    path = _text("h", F.col("user_id"), "/.bash_history")
    three = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.when(n % 3 != 0, _text("#", F.unix_seconds("ts"))).otherwise("").alias("raw")), F.struct(F.lit(1).alias("k"), F.lit("  ").alias("raw")), F.struct(F.lit(2).alias("k"), _text("cmd ", n, " ").alias("raw"))))
    e = e.select(path.alias("source_path"), "n", three.alias("x")).select("source_path", (F.col("n") * 3 + F.col("x.k")).alias("line_no"), F.col("x.raw").alias("raw"))
    return p.parse_shell_history(e).select("command", at("timestamp").alias("at_text"), "timezone_confidence")


@query(f"WITH {_EV} SELECT n, at_text, CASE n % 4 WHEN 0 THEN 'package_installed' WHEN 1 THEN 'package_removed' WHEN 2 THEN 'package_updated' ELSE 'package_activity' END AS event_action FROM e")
def parse_package_log(spark, d):
    e = _events(spark, d)
    n = F.col("n")
    verb = F.when(n % 4 == 0, " install ").when(n % 4 == 1, " removed ").when(n % 4 == 2, " Upgrade ").otherwise(" status ")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"), verb, _text("pkg ", n))
    return p.parse_package_log(_lines(e, raw, "dpkg.log", n), 2024).select(F.regexp_extract("raw", r"(\d+)$", 1).cast("long").alias("n"), at("timestamp").alias("at_text"), "event_action")


@query("SELECT page_id, '10.0.0.' || (page_id % 99) AS src_ip, url AS uri, '2024-03-04 05:06:07' AS at_text, CASE WHEN regexp_matches(lower(url), 'cmd=|shell|upload|\\.php|\\.\\./|%2e%2e') THEN 'medium' ELSE 'informational' END AS severity FROM pages")
def parse_web_log(spark, d):
    pages = table(spark, d, "pages")
    raw = _text("10.0.0.", F.col("page_id") % 99, ' - - [04/Mar/2024:07:06:07 +0200] "GET ', F.col("url"), ' HTTP/1.1" 200 ', F.col("page_id"))
    found = p.parse_web_log(_lines(pages, raw, "access.log", F.col("page_id")), 2024)
    return found.select(F.regexp_extract("raw", r"(\d+)$", 1).cast("long").alias("page_id"), "src_ip", F.col("extra.uri").alias("uri"), at("timestamp").alias("at_text"), "severity")


@query(f"WITH {_EV} SELECT n, 'u' || user_id AS user_name, strftime(t, '%Y-%m-%d %H:%M') || ':00' AS at_text, CASE WHEN n % 2 = 0 THEN 'login_failed' ELSE 'login_session' END AS event_action FROM e")
def parse_login_history(spark, d):
    e = _events(spark, d)
    n = F.col("n")
    raw = F.concat(_text("u", F.col("user_id"), " tty", n, " 10.0.0.1 Mon "), F.date_format("ts", "MMM d HH:mm yyyy"))
    found = p.parse_login_history(_lines(e, raw, F.when(n % 2 == 0, "lastb.txt").otherwise("last.txt"), n), 1999)
    return found.select(F.substring("extra.tty", 4, 20).cast("long").alias("n"), F.col("user").alias("user_name"), at("timestamp").alias("at_text"), "event_action")


@query(f"WITH {_EV} SELECT '/f/' || n AS file_path, 'atime' AS timestamp_type, at_text FROM e UNION ALL SELECT '/f/' || n, 'mtime', strftime(t + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') FROM e WHERE n % 2 = 0 UNION ALL SELECT '/f/' || n, 'birthtime', at_text FROM e")
def parse_bodyfile(spark, d):
    e = _events(spark, d)
    n, s = F.col("n"), F.unix_seconds("ts")
    raw = _text("0|/f/", n, "|1|0644|0|0|9|", s, "|", F.when(n % 2 == 0, s + 3600).otherwise(0), "|-5|", s)
    return p.parse_bodyfile(_lines(e, raw, "bodyfile", n)).select("file_path", "timestamp_type", at("timestamp").alias("at_text"))


@query(f"WITH {_EV} SELECT n, at_text, 'run -x n' || n AS command, '/bin/r' || n AS file_path, 'process_execution' AS event_action, CASE WHEN n % 2 = 0 THEN 'audit_exec_from_tmp' ELSE '' END AS detections, 'node' || (n % 4) AS host FROM e")
def parse_auditd(spark, d):
    e = _events(spark, d)
    n = F.col("n")
    head = lambda kind: _text("node=node", n % 4, f" type={kind} msg=audit(", F.unix_seconds("ts"), ".123:", n, "): ")
    key = F.when(n % 2 == 0, "key=\"exec_from_tmp\"").otherwise("key=(null)")
    lines = F.explode(F.array(F.concat(head("SYSCALL"), _text("uid=0 comm=\"c\" "), key), F.concat(head("EXECVE"), _text('argc=3 a0="run" a1=2D78 a2="n', n, '"')), F.concat(head("PATH"), _text('item=0 name="/bin/r', n, '"'))))
    e = e.select("n", lines.alias("raw")).withColumn("line_no", F.monotonically_increasing_id())
    found = p.parse_auditd(e.select(F.lit("audit.log").alias("source_path"), "line_no", "raw"))
    return found.select(F.col("extra.audit_id").cast("long").alias("n"), at("timestamp").alias("at_text"), "command", "file_path", "event_action", csv("detection_names").alias("detections"), "host")


@query("SELECT c_custkey, 'u' || c_custkey AS user_name, CASE WHEN c_custkey % 50 = 0 THEN 'uid0_non_root_account' WHEN c_custkey % 2000 BETWEEN 1 AND 999 AND c_custkey % 3 = 0 THEN 'interactive_shell_for_system_account' ELSE '' END AS detections, CASE WHEN c_custkey % 50 = 0 THEN 'high' WHEN c_custkey % 2000 BETWEEN 1 AND 999 AND c_custkey % 3 = 0 THEN 'medium' ELSE 'informational' END AS severity FROM customer")
def parse_passwd(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = _text("u", key, ":x:", F.when(key % 50 == 0, 0).otherwise(key % 2000), ":5:", key, ":/home:", F.when(key % 3 == 0, "/bin/bash").otherwise("/usr/sbin/nologin"))
    return p.parse_passwd(_lines(c, raw, "etc/passwd", key)).select(F.col("extra.comment").cast("long").alias("c_custkey"), F.col("user").alias("user_name"), csv("detection_names").alias("detections"), "severity")


@query("SELECT 'u' || c_custkey AS user_name, CASE c_custkey % 3 WHEN 0 THEN 'MD5' WHEN 1 THEN 'SHA-512' ELSE 'locked_or_disabled' END AS hash_type, strftime(DATE '1970-01-01' + (c_custkey % 900 + 1)::INT, '%Y-%m-%d 00:00:00') AS at_text, '[shadow hash redacted]' AS raw FROM customer")
def parse_shadow(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = _text("u", key, ":", F.when(key % 3 == 0, "$1$a").when(key % 3 == 1, "$6$a").otherwise("!"), ":", key % 900 + 1, ":0:")
    return p.parse_shadow(_lines(c, raw, "etc/shadow", key)).select(F.col("user").alias("user_name"), F.col("extra.hash_type").alias("hash_type"), at("timestamp").alias("at_text"), "raw")


@query("SELECT c_custkey::VARCHAR AS gid, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 <> 0 THEN 'privileged_group_membership,container_group_privilege_risk' ELSE '' END AS detections FROM customer")
def parse_group(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = _text(F.when(key % 4 == 0, "docker").otherwise("users"), ":x:", key, ":", F.when(key % 3 == 0, ",").otherwise("a,b"))
    return p.parse_group(_lines(c, raw, "etc/group", key)).select("gid", csv("detection_names").alias("detections"))


@query("SELECT c_custkey AS n, CASE c_custkey % 3 WHEN 0 THEN 'sudoers_rule_observed,nopasswd_sudo_rule,broad_nopasswd_sudo_rule' WHEN 1 THEN 'sudoers_rule_observed,nopasswd_sudo_rule,dangerous_sudo_rule_candidate' ELSE 'sudoers_rule_observed' END AS detections, CASE c_custkey % 3 WHEN 2 THEN 'low' ELSE 'high' END AS severity FROM customer")
def parse_sudoers(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.when(key % 3 == 0, _text("u", key, " ALL=(ALL) NOPASSWD: ALL")).when(key % 3 == 1, _text("u", key, " h=(root) NOPASSWD: /usr/bin/vim")).otherwise(_text("u", key, " h=(root) /usr/bin/id"))
    return p.parse_sudoers(_lines(c, raw, "etc/sudoers", key)).select(F.col("extra.line").cast("long").alias("n"), csv("detection_names").alias("detections"), "severity")


@query("SELECT '/opt/f' || c_custkey AS file_path, CASE c_custkey % 3 WHEN 0 THEN 'suid_file_observed' WHEN 1 THEN 'sgid_file_observed,world_writable_sensitive_file' END AS detections, CASE c_custkey % 3 WHEN 0 THEN 'medium' ELSE 'high' END AS severity FROM customer WHERE c_custkey % 3 <> 2")
def parse_bodyfile_privilege(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = _text("0|/opt/f", key, "|1|", F.when(key % 3 == 0, "4755").when(key % 3 == 1, "2777").otherwise("0644"), "|0|0|9|1|1|1|1")
    return p.parse_bodyfile_privilege(_lines(c, raw, "bodyfile", key)).select("file_path", csv("detection_names").alias("detections"), "severity")


@query("SELECT '/bin/f' || c_custkey AS file_path, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM customer")
def parse_capabilities(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return p.parse_capabilities(_lines(c, _text("/bin/f", key, " = ", F.when(key % 2 == 0, "cap_setuid+ep").otherwise("cap_net_raw+ep")), "getcap.txt", key)).select("file_path", "severity")


@query("SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM customer WHERE c_custkey % 5 <> 0")
def parse_cron_file(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.when(key % 5 == 0, "PATH=/usr/bin").otherwise(_text("* * * * * root ", F.when(key % 2 == 0, "curl http://x").otherwise("/usr/bin/job a=b")))
    return p.parse_cron_file(_lines(c, raw, "etc/cron.d/x", key)).select(F.col("extra.line").cast("long").alias("n"), "severity")


@query("SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'informational' END AS severity FROM customer WHERE c_custkey % 7 <> 0")
def parse_profile(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.when(key % 7 == 0, "# x").otherwise(F.when(key % 2 == 0, "export LD_PRELOAD=/x.so").otherwise("export A=1"))
    return p.parse_profile(_lines(c, raw, "etc/profile", key)).select(F.col("extra.line").cast("long").alias("n"), "severity")


@query("SELECT '/lib/x' || c_custkey || '.so' AS file_path, 'high' AS severity FROM customer")
def parse_ld_preload(spark, d):
    c = table(spark, d, "customer")
    return p.parse_ld_preload(_lines(c, _text(" /lib/x", F.col("c_custkey"), ".so"), "etc/ld.so.preload")).select("file_path", "severity")


@query("SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'pam_backdoor_candidate' ELSE '' END AS detections FROM customer")
def parse_pam_config(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return p.parse_pam_config(_lines(c, F.when(key % 2 == 0, "auth optional pam_exec.so x").otherwise("auth required pam_unix.so"), "etc/pam.d/x", key)).select(F.col("extra.line").cast("long").alias("n"), csv("detection_names").alias("detections"))


@query("SELECT c_custkey AS n, 'ssh-ed25519' AS key_type, 'me@' || c_custkey AS comment, CASE WHEN c_custkey % 2 = 0 THEN 'ssh,authorized_keys,persistence_candidate,restricted_key' ELSE 'ssh,authorized_keys,persistence_candidate,unrestricted_key' END AS tags FROM customer")
def parse_authorized_keys(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.concat(F.when(key % 2 == 0, 'command="x",no-pty ').otherwise(""), _text("ssh-ed25519 AAAA", key, " me@", key))
    return p.parse_authorized_keys(_lines(c, raw, "authorized_keys", key)).select(F.col("extra.line").cast("long").alias("n"), F.col("extra.key_type").alias("key_type"), F.col("extra.comment").alias("comment"), csv("tags").alias("tags"))


@query("SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || c_custkey END AS dst_ip FROM customer")
def parse_known_hosts(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.concat(F.when(key % 2 == 0, _text("10.0.0.", key)).otherwise("host"), F.lit(" ssh-rsa AAAA"))
    return p.parse_known_hosts(_lines(c, raw, "known_hosts", key)).select(F.col("extra.line").cast("long").alias("n"), "dst_ip")


@query("SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'risky_sshd_permitrootlogin' ELSE '' END AS detections FROM customer")
def parse_sshd_config(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return p.parse_sshd_config(_lines(c, F.concat(F.lit("PermitRootLogin "), F.when(key % 2 == 0, "Yes").otherwise("no")), "sshd_config", key)).select(F.col("extra.line").cast("long").alias("n"), csv("detection_names").alias("detections"))


@query("SELECT 'unit' || c_custkey || '.timer' AS file_path, CASE WHEN c_custkey % 2 = 0 THEN '/usr/bin/curl x' END AS command, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM customer")
def parse_systemd_unit(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.concat(F.lit("[Service]\n"), F.when(key % 2 == 0, "  ExecStart=/usr/bin/curl x\nExecStart=/b\n").otherwise("Type=x\n"))
    return p.parse_systemd_unit(_lines(c, raw, _text("unit", key, ".timer"))).select("file_path", "command", "severity")


@query(
    """SELECT 'f' || c_custkey AS source_path, 'listening_port' AS event_action, '22' AS port, '' AS src_ip, 'informational' AS severity FROM customer
    UNION ALL SELECT 'f' || c_custkey, 'inbound_connection', '22', '10.9.9.9', 'informational' FROM customer
    UNION ALL SELECT 'f' || c_custkey, 'outbound_connection', '4444', '10.0.0.1', 'high' FROM customer"""
)
def classify_sockets(spark, d):
    c = table(spark, d, "customer")
    rows = F.explode(F.array(F.lit('LISTEN 0 128 0.0.0.0:22 0.0.0.0:* users:(("sshd",pid=7,fd=3))'), F.lit("ESTAB 0 0 10.0.0.1:22 10.9.9.9:50000"), F.lit("ESTAB 0 0 10.0.0.1:40000 10.8.8.8:4444")))
    lines = c.select(_text("f", F.col("c_custkey")).alias("source_path"), rows.alias("raw")).withColumn("line_no", F.lit(1).cast("long"))
    return p.parse_ss(lines).select("source_path", "event_action", "port", F.coalesce("src_ip", F.lit("")).alias("src_ip"), "severity")


@query("SELECT 'f' || c_custkey AS source_path, 'outbound_connection' AS event_action, '443' AS port, 'curl' AS process FROM customer")
def parse_netstat(spark, d):
    c = table(spark, d, "customer")
    lines = _lines(c, F.lit("tcp 0 0 10.0.0.1:40000 1.2.3.4:443 ESTABLISHED 99/curl"), _text("f", F.col("c_custkey")))
    return p.parse_netstat(lines).select("source_path", "event_action", "port", "process")


@query("SELECT c_custkey::VARCHAR AS pid, CASE WHEN c_custkey % 3 = 0 THEN 'process_observed,suspicious_process' ELSE 'process_observed,process_from_suspicious_path,root_process_from_unusual_path' END AS detections FROM customer WHERE c_custkey % 3 <> 2")
def parse_ps(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = _text(F.when(key % 3 == 1, "root").otherwise("u"), " ", key, " 0.0 0.1 100 200 ? S 10:00 0:01 ", F.when(key % 3 == 0, "xmrig -o x").when(key % 3 == 1, "/tmp/a b").otherwise("/usr/bin/x"))
    return p.parse_ps(_lines(c, raw, "ps.txt", key)).select("pid", csv("detection_names").alias("detections"))


@query("SELECT o_orderkey AS n, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at_text FROM orders")
def resolve_years(spark, d):
    """One line an order in files of a customer, in order of date, with months only: the last year is known, as dates of one year apart."""
    o = table(spark, d, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    lines = o.select(_text("f", F.year(ts)).alias("source_path"), F.col("o_orderkey").alias("n"), (F.dayofyear(ts).cast("long") * 100_000_000 + F.col("o_orderkey")).alias("line_no"), F.concat(F.date_format(ts, "MMM d HH:mm:ss"), F.lit(" x")).alias("raw"), F.year(ts).alias("y"))
    dated = p.resolve_years(lines, 0)
    return dated.select("n", at(times.parse_syslog(F.col("raw"), F.col("year") + F.col("y"))).alias("at_text"))


@query(f"WITH {_EV} SELECT n, at_text AS epoch, at_text AS iso, at_text AS mail, at_text AS apache, at_text AS millis, strftime(t - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS shifted FROM e")
def time_functions(spark, d):
    e = _events(spark, d)
    s = F.unix_seconds("ts").cast("string")
    mail = F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return e.select(
        "n", at(times.parse_epoch(F.concat(s, F.lit(".9")))).alias("epoch"), at(times.parse_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("iso"), at(times.parse_iso(mail)).alias("mail"), at(times.parse_apache(F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")))).alias("apache"),
        at(times.parse_numeric_or_text(F.concat(s, F.lit("000")), 1970)).alias("millis"), at(times.parse_iso(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")))).alias("shifted"),
    )
