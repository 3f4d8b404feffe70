"""Parsers of evidence lines (``source_path``, ``line_no``, ``raw``, and ``host`` if known) into timelines.

All are column expressions; only parsers that need other lines of a file or group shuffle. Lines
that do not parse are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions import times
from emberlog.operators.timeline import to_timeline

# The form of a syslog line.
_PREFIX = r"^\w{3}\s+\d+\s+\d\d:\d\d:\d\d\s+(\S+)\s+([\w./-]+)(?:\[(\d+)\])?:\s+(.*)$"


def _x(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where it is empty or the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


_CUT = "\x01"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns made in a step of their own (a row of one made from an array of one), so that the optimizer does not copy them to every place that uses them."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", made.alias("_made")).select(*(c for c in df.columns if c not in columns), "_made.*")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of a pattern's first match in one search, as an array of one text where it does not match."""
    return F.split(F.regexp_replace(F.translate(text, _CUT, " "), f"(?s)^.*?(?:{pattern}).*$", _CUT.join(f"${k}" for k in range(1, n + 1))), _CUT)


def _texts(*values: str | Column) -> Column:
    return F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)).cast("array<string>")


def _some(*pairs: tuple[Column, str]) -> Column:
    """The names whose tests hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in pairs)))


def _host(df: DataFrame, found: Column | None = None) -> Column:
    given = F.nullif("host", F.lit("")) if "host" in df.columns else F.lit(None)
    return F.coalesce(given, found, F.lit("")) if found is not None else F.coalesce(given, F.lit(""))


def _state(df: DataFrame, source_type: str, parser: str, category: str, action: str, **more: Column) -> DataFrame:
    """Undated observations of state."""
    fixed = {"timestamp_type": "state_observed", "evidence_role": "state_observation", "timezone_confidence": "missing", "source_type": source_type, "parser": parser, "event_category": category, "event_action": action, "confidence": "medium"}
    mapping = {k: F.lit(v) for k, v in fixed.items()} | {"host": _host(df), "source_path": F.col("source_path"), "raw": F.col("raw")} | more
    if "detection_names" in more:
        mapping.setdefault("ttp_flags", more["detection_names"])
    return to_timeline(df, mapping)


def resolve_years(lines: DataFrame, year: int, segment_lines: int = 100_000) -> DataFrame:
    """Add ``year`` to lines with dates that have none.

    In a file, a month that falls by six or more against the dated line before starts a new year; a
    file in which that happens begins in the year before ``year``. A file is cut into segments of
    ``segment_lines``, so a large log is many tasks: turns are counted in each, and one row a
    segment tells the next ones how many there were and which month came last.
    """
    month = times.month(F.regexp_extract("raw", r"^([A-Za-z]{3})\s+\d{1,2}\s", 1))
    keys = ["source_path", "segment"]
    inside = Window.partitionBy(*keys).orderBy("line_no")
    df = lines.withColumns({"month": month, "segment": F.floor(F.col("line_no") / segment_lines)})
    before = F.last("month", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("turn", F.when(before - F.col("month") >= 6, 1).otherwise(0))
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"turns": F.sum("turn").over(until), "dated": F.count("month").over(until) > 0})
    at = F.when(F.col("month").isNotNull(), F.col("line_no"))
    ends = df.groupBy(*keys).agg(F.min_by("month", at).alias("first_month"), F.max_by("month", at).alias("last_month"), F.sum("turn").alias("own"))
    file = Window.partitionBy("source_path").orderBy("segment")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("head", F.when(F.last("last_month", ignorenulls=True).over(earlier) - F.col("first_month") >= 6, 1).otherwise(0))
    ends = ends.withColumns({"before": F.coalesce(F.sum(F.col("own") + F.col("head")).over(earlier), F.lit(0)), "any_turn": F.sum(F.col("own") + F.col("head")).over(Window.partitionBy("source_path")) > 0})
    joined = df.join(ends.select(*keys, "head", "before", "any_turn"), keys)
    turns = F.col("before") + F.col("turns") + F.when(F.col("dated"), F.col("head")).otherwise(0)
    return joined.withColumn("year", F.lit(year) - F.when(F.col("any_turn"), 1).otherwise(0) + turns.cast("int")).select(*lines.columns, "year")


def _with_year(lines: DataFrame, year: int) -> DataFrame:
    return lines if "year" in lines.columns else resolve_years(lines, year)


def _dated(lines: DataFrame, year: int, tz: str) -> DataFrame:
    """Lines that begin with a syslog time, with ``ts``; the time is searched for once."""
    df = _once(_with_year(lines, year), clock=_groups(F.col("raw"), times.SYSLOG, 5)).where("size(clock) = 5")
    return _once(df, ts=times.from_syslog([F.get("clock", k) for k in range(5)], F.col("year"), tz)).drop("clock").where("ts is not null")


# Forms of the messages of logins, sudo, su and accounts.
_AUTH = {
    "accepted": (r"Accepted \S+ for (\S+) from (\S+) port (\d+)", 3),
    "failed": (r"Failed \S+ for (?:invalid user )?(\S+) from (\S+) port (\d+)", 3),
    "sudo": (r"(\S+)\s*:\s*(?:TTY=([^;]+)\s*;\s*)?PWD=([^;]+)\s*;\s*USER=([^;]+)\s*;\s*COMMAND=(.*)", 5),
    "su": (r"session opened for user (\S+)", 1),
    "password": (r"password changed for (\S+)", 1),
    "useradd": (r"new user: name=([^,\s]+)(?:,\s*UID=(\d+))?(?:,\s*GID=(\d+))?(?:,\s*home=([^,\s]+))?(?:,\s*shell=([^,\s]+))?", 5),
    "groupadd": (r"new group: name=([^,\s]+)(?:,\s*GID=(\d+))?", 2),
    "delete": (r"delete user '(\S+?)'", 1),
    "modify": (r"change user '(\S+?)'", 1),
    "lock": (r"user (\S+) account (locked|unlocked)", 2),
    "invalid": (r"Invalid user (\S+) from (\S+) port (\d+)", 3),
}


def parse_auth(lines: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """Login, sudo, su and account messages; the first of eleven kinds that fits, other lines go.

    A line is taken apart once, then its kind is told, then the groups of that kind alone are cut.
    """
    df = _dated(lines, year, tz)
    head = _once(df, head=_groups(F.col("raw"), _PREFIX, 4))
    part = lambda k: F.when(F.size("head") == 4, F.nullif(F.get("head", k), F.lit("")))
    df = _once(head, h=part(0), proc=part(1), pid_=part(2), msg=F.coalesce(part(3), "raw")).drop("head")
    msg, proc = F.col("msg"), F.coalesce("proc", F.lit(""))
    fits = lambda word, form: msg.contains(word) & msg.rlike(_AUTH[form][0])
    tests = {
        "accepted": fits("Accepted ", "accepted"), "failed": fits("Failed ", "failed"), "sudo": proc.contains("sudo") & msg.rlike(_AUTH["sudo"][0]), "su": proc.contains("su") & msg.contains("session opened"), "password": fits("password changed for", "password"),
        "useradd": fits("new user:", "useradd"), "groupadd": fits("new group:", "groupadd"), "delete": fits("delete user", "delete"), "modify": fits("change user", "modify"), "lock": fits("account ", "lock"), "invalid": fits("Invalid user", "invalid"),
    }
    places = {form: k for k, form in enumerate(tests)}
    df = _once(df, kind=F.coalesce(*(F.when(test, F.lit(places[form])) for form, test in tests.items()))).where("kind is not null")
    is_ = lambda form: F.col("kind") == places[form]
    df = _once(df, cut=F.coalesce(*(F.when(is_(form), _groups(msg, *_AUTH[form])) for form in tests)))
    g = lambda k: F.when(F.size("cut") >= k, F.nullif(F.get("cut", k - 1), F.lit("")))
    # a session without a user does not fit its form
    g1 = F.when(~is_("su") | msg.contains("session opened for user "), g(1))

    def say(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("?")) for p in parts))

    def each(default, **values) -> Column:
        """A field's value by kind."""
        out = None
        for form, value in values.items():
            value = value if isinstance(value, Column) else _texts(*value) if isinstance(value, tuple) else F.lit(value)
            out = F.when(is_(form), value) if out is None else out.when(is_(form), value)
        return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))

    locked = F.concat(F.lit("account_"), g(2))
    account = lambda name: ("account_management", name)
    action = each(None, accepted="ssh_login_success", failed="ssh_login_failure", sudo="sudo_command", su="su_session_opened", password="password_changed", useradd="user_created", groupadd="group_created", delete="user_deleted", modify="user_modified", lock=locked, invalid="ssh_invalid_user")
    tags = each(None, accepted=("ssh", "remote_access", "valid_account"), failed=("ssh", "bruteforce", "authentication_failure"), sudo=("sudo", "privilege_escalation", "command"), su=("su", "session"), password=("password_change", "credential"), useradd=account("user_created"), groupadd=account("group_created"), delete=account("user_deleted"), modify=account("user_modified"), lock=_texts("account_management", locked), invalid=("ssh", "bruteforce", "invalid_user"))
    mitre = each(None, accepted=("T1078", "T1021.004"), failed=("T1110",), sudo=("T1548.003",), su=("T1078",), password=("T1098",), useradd=("T1136.001",), groupadd=("T1136.001",), delete=("T1531",), modify=("T1098",), lock=F.when(g(2) == "unlocked", _texts("T1098")).otherwise(_texts("T1531")), invalid=("T1110",))
    names = each(_texts(), password=_some((F.lit(True), "auth_password_changed"), (g1 == "root", "root_password_changed")), useradd=("auth_user_created",), groupadd=("auth_group_created",), delete=("auth_user_deleted",), modify=("auth_user_modified",), lock=_texts(F.concat(F.lit("auth_account_"), g(2))), invalid=("ssh_invalid_user_attempt",))
    summary = each(
        None, accepted=say("Successful SSH login for ", g1, " from ", g(2)), failed=say("Failed SSH login for ", g1, " from ", g(2)), sudo=say(g1, " ran sudo command: ", F.trim(g(5))), su=F.concat(F.lit("su session opened for "), F.coalesce(g1, F.lit("unknown user"))), password=say("Password changed for ", g1), useradd=say("New user created: ", g1, " uid=", g(2)),
        groupadd=say("New group created: ", g1, " gid=", g(2)), delete=say("User deleted: ", g1), modify=say("User modified: ", g1), lock=say("Account ", g(2), ": ", g1), invalid=say("Invalid user ", g1, " from ", g(2)),
    )
    none = F.lit(None).cast("string")
    address = lambda k: each(none, accepted=g(k), failed=g(k), invalid=g(k))
    pairs = lambda **v: F.create_map(*(x for n, c in v.items() for x in (F.lit(n), c)))
    extra = each(F.create_map().cast("map<string,string>"), sudo=pairs(pwd=F.trim(g(3)), runas=F.trim(g(4))), useradd=pairs(home=g(4), shell=g(5)), groupadd=pairs(group=g1))
    category = each(None, accepted="authentication", failed="authentication", sudo="privilege", su="privilege", password="credential_change", useradd="persistence", groupadd="persistence", delete="persistence", modify="persistence", lock="credential_change", invalid="authentication")
    severity = each("medium", failed="low", su="low", password=F.when(g1 == "root", "high").otherwise("medium"), useradd="high", delete="high", invalid="low")
    df = _once(df, names=names, extra_=F.map_filter(extra, lambda _, v: v.isNotNull()))
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.substring("raw", 1, 15), "timezone": F.lit(tz), "timezone_confidence": F.lit("assumed_local"), "timestamp_type": F.lit("log_time"), "host": _host(df, F.col("h")), "source_path": F.col("source_path"), "source_type": F.lit("auth_log"), "parser": F.lit("auth"), "process": F.col("proc"), "pid": F.col("pid_"), "raw": F.col("raw"),
        "event_action": action, "event_category": category, "severity": severity, "tags": tags, "mitre": mitre, "summary": summary, "user": F.when(~is_("groupadd"), g1), "src_ip": address(2), "port": address(3), "command": F.when(is_("sudo"), F.trim(g(5))), "uid": F.when(is_("useradd"), g(2)), "gid": each(none, useradd=g(3), groupadd=g(2)), "detection_names": F.col("names"), "ttp_flags": F.col("names"), "confidence": each("high", su="medium"), "extra": F.col("extra_")})


def parse_syslog(lines: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """Services started and stopped, sessions, cron runs; other lines go."""
    df = _dated(lines, year, tz)
    proc, msg = _x(F.col("raw"), _PREFIX, 2), F.coalesce(_x(F.col("raw"), _PREFIX, 4), "raw")
    action = F.when(msg.rlike("Started |Starting "), "service_started").when(msg.rlike("Stopped |Stopping "), "service_stopped").when(msg.contains("session opened"), "session_opened").when(F.col("raw").contains("CRON"), "cron_execution")
    df = df.withColumns({"action": action, "proc": proc, "msg": msg}).where("action is not null")
    a = F.col("action")
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.substring("raw", 1, 15), "timezone": F.lit(tz), "timezone_confidence": F.lit("assumed_local"), "timestamp_type": F.lit("log_time"), "host": _host(df, _x(F.col("raw"), _PREFIX, 1)), "source_path": F.col("source_path"), "source_type": F.lit("syslog"), "parser": F.lit("syslog"), "process": F.col("proc"), "pid": _x(F.col("raw"), _PREFIX, 3), "raw": F.col("raw"), "summary": F.col("msg"),
        "event_action": a, "event_category": F.when(a == "session_opened", "authentication").when(a == "cron_execution", "persistence").otherwise("system"), "mitre": F.when(a == "cron_execution", _texts("T1053.003")).otherwise(_texts()), "tags": F.when(a.startswith("service"), _texts("syslog", "service")).when(a == "cron_execution", _texts("syslog", "cron", "scheduled_task")).otherwise(_texts("syslog"))})


def parse_journal(lines: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """Journal text with full or short times; every line that parses stays, some with a class of their own."""
    tail = r"\s+(\S+)\s+([^\s:]+?)(?:\[(\d+)\])?:\s*(.*)$"
    iso, short = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}))" + tail, r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})" + tail
    raw, full = F.col("raw"), F.col("raw").rlike(iso)
    df = _once(lines.where(full | raw.rlike(short)), full=full)
    df = _once(df, head=F.when(F.col("full"), _groups(raw, iso, 5)).otherwise(_groups(raw, short, 5)))
    df = _once(df, t=F.get("head", 0), h=F.get("head", 1), proc=F.get("head", 2), pid_=F.nullif(F.get("head", 3), F.lit("")), msg=F.get("head", 4)).drop("head")
    df = df.withColumn("ts", F.coalesce(times.parse_iso(F.col("t")), times.parse_syslog(F.col("t"), year, tz))).where("ts is not null")
    msg, low = F.col("msg"), F.lower("msg")
    ok, bad, sudo = r"Accepted \S+ for (\S+) from (\S+) port (\d+)", r"Failed \S+ for (?:invalid user )?(\S+) from (\S+) port (\d+)", r"USER=([^;]+)\s*;\s*COMMAND=(.*)"
    tests = ((msg.rlike(ok), "ssh_login_success"), (msg.rlike(bad), "ssh_login_failure"), (msg.rlike(sudo), "sudo_command"), (msg.rlike("Started |Starting "), "service_started"), (msg.rlike("Stopped |Stopping "), "service_stopped"), (msg.contains("CRON") | (F.col("proc") == "CRON"), "cron_execution"), (low.rlike("out of memory|oom-killer"), "out_of_memory"), (low.contains("segfault"), "process_crash"))
    df = _once(df, a=F.coalesce(*(F.when(t, F.lit(n)) for t, n in tests), F.lit("journal_message")))
    df = _once(df, cut=F.when(F.col("a") == "ssh_login_success", _groups(msg, ok, 3)).when(F.col("a") == "ssh_login_failure", _groups(msg, bad, 3)))
    # Category, severity, confidence, tags and techniques by action.
    table = {
        "ssh_login_success": ("authentication", "medium", "high", ("ssh", "login_success"), ("T1078",)), "ssh_login_failure": ("authentication", "low", "high", ("ssh", "login_failure"), ("T1110",)), "sudo_command": ("privilege", "medium", "high", ("sudo", "privilege"), ("T1548.003",)),
        "service_started": ("system", "informational", "medium", ("service",), ()), "service_stopped": ("system", "informational", "medium", ("service",), ()), "cron_execution": ("persistence", "informational", "medium", ("cron", "scheduled_task"), ("T1053.003",)),
        "out_of_memory": ("availability", "medium", "medium", ("resource_exhaustion",), ()), "process_crash": ("process", "medium", "medium", ("crash",), ()), "journal_message": ("system", "informational", "medium", (), ()),
    }
    col = lambda f: F.coalesce(*(F.when(F.col("a") == n, f(v)) for n, v in table.items()))
    from_ = lambda k: F.nullif(F.get("cut", k - 1), F.lit(""))
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.col("t"), "timezone": F.lit(tz), "timezone_confidence": F.when(F.col("full"), "source_offset").otherwise("assumed_local"), "timestamp_type": F.lit("log_time"), "host": _host(df, F.col("h")), "source_path": F.col("source_path"), "source_type": F.lit("journal_text"), "parser": F.lit("journal"), "event_action": F.col("a"), "event_category": col(lambda v: F.lit(v[0])), "severity": col(lambda v: F.lit(v[1])), "confidence": col(lambda v: F.lit(v[2])), "tags": col(lambda v: _texts("journal", *v[3])), "mitre": col(lambda v: _texts(*v[4])), "process": F.col("proc"), "pid": F.col("pid_"), "user": from_(1), "src_ip": from_(2), "port": from_(3), "command": F.when(F.col("a") == "sudo_command", _x(msg, sudo, 2)), "summary": msg, "raw": F.col("raw"), "extra": F.create_map(F.lit("line"), F.col("line_no").cast("string"))})


def parse_cron_log(lines: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    df = _dated(lines, year, tz)
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.substring("raw", 1, 15), "timezone": F.lit(tz), "timezone_confidence": F.lit("assumed_local"), "timestamp_type": F.lit("log_time"), "host": _host(df), "source_path": F.col("source_path"), "source_type": F.lit("cron"), "parser": F.lit("cron"), "event_category": F.lit("persistence"), "event_action": F.lit("cron_execution"), "mitre": _texts("T1053.003"), "severity": F.lit("low"), "tags": _texts("cron", "scheduled_task"), "summary": F.col("raw"), "raw": F.col("raw")})


def parse_shell_history(lines: DataFrame) -> DataFrame:
    """Commands; a ``#epoch`` line dates the next one, past blank lines."""
    text = F.trim("raw")
    df = lines.withColumn("text", text).where("text <> ''").withColumn("epoch", _x(F.col("text"), r"^#(\d{9,11})$"))
    before = F.lag("epoch").over(Window.partitionBy("source_path").orderBy("line_no"))
    df = df.withColumn("ts", times.parse_epoch(before)).where("epoch is null")
    dated = F.col("ts").isNotNull()
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.when(dated, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("line_no").cast("string")), "timezone_confidence": F.when(dated, "source_epoch").otherwise("missing"), "timestamp_type": F.when(dated, "command_time").otherwise("unknown"), "host": _host(df), "source_path": F.col("source_path"), "source_type": F.lit("shell_history"), "parser": F.lit("shell_history"), "event_category": F.lit("execution"), "event_action": F.lit("shell_command"), "command": F.col("text"), "severity": F.lit("low"), "confidence": F.when(dated, "medium").otherwise("low"), "tags": _texts("shell_history", "command"), "summary": F.concat(F.lit("Shell command: "), "text"), "raw": F.col("raw"), "extra": F.create_map(F.lit("line"), F.col("line_no").cast("string"))})


def parse_package_log(lines: DataFrame, year: int) -> DataFrame:
    raw, low = F.col("raw"), F.lower("raw")
    ts = F.coalesce(times.parse_any(F.trim(F.substring("raw", 1, 25)), year), times.parse_any(F.regexp_extract(raw, r"^\s*(\S+)", 1), year))
    df = lines.withColumn("ts", ts).where("ts is not null")
    action = F.when(low.rlike(" install | installed "), "package_installed").when(low.rlike(" remove | removed "), "package_removed").when(low.rlike(" upgrade | upgraded "), "package_updated").otherwise("package_activity")
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.substring("raw", 1, 25), "timezone_confidence": F.lit("assumed"), "timestamp_type": F.lit("log_time"), "host": _host(df), "source_path": F.col("source_path"), "source_type": F.lit("package_log"), "parser": F.lit("package_log"), "event_category": F.lit("software"), "event_action": action, "tags": _texts("package", "software"), "summary": raw, "raw": raw})


def parse_web_log(lines: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """Common log format; suspicious addresses raise the severity."""
    web = r"(\S+) \S+ \S+ \[([^\]]+)\] \"(\S+) (\S+) [^\"]+\" (\d{3}) (\S+)"
    raw = F.col("raw")
    df = lines.where(raw.rlike(web)).withColumns({n: F.regexp_extract(raw, web, k) for k, n in enumerate(("ip", "t", "method", "uri", "status"), 1)})
    df = df.withColumn("ts", times.parse_any(F.col("t"), year, tz)).where("ts is not null")
    odd = F.lower("uri").rlike(r"cmd=|shell|upload|\.php|\.\./|%2e%2e")
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.col("t"), "timezone_confidence": F.lit("source_or_assumed"), "timestamp_type": F.lit("log_time"), "host": _host(df), "source_path": F.col("source_path"), "source_type": F.lit("web_log"), "parser": F.lit("web_log"), "event_category": F.lit("web"), "event_action": F.lit("http_request"), "src_ip": F.col("ip"), "severity": F.when(odd, "medium").otherwise("informational"), "tags": F.when(odd, _texts("web", "http", "web_attack_candidate")).otherwise(_texts("web", "http")), "summary": F.concat("method", F.lit(" "), "uri", F.lit(" returned "), "status"), "raw": raw, "extra": F.create_map(F.lit("method"), F.col("method"), F.lit("uri"), F.col("uri"), F.lit("status"), F.col("status"))})


def parse_login_history(lines: DataFrame, year: int, tz: str = "UTC") -> DataFrame:
    """Rows of ``last`` and ``lastb``; the path says whether they failed, a year in the row comes first."""
    row = r"^(\S+)\s+(\S+)\s+(\S+)\s+[A-Z][a-z]{2}\s+([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2})(?:\s+(\d{4}))?"
    raw = F.col("raw")
    df = lines.where(raw.rlike(row) & ~raw.rlike("^(wtmp|btmp|reboot|shutdown)"))
    g = lambda k: _x(raw, row, k)
    failed = F.lower("source_path").rlike("lastb|btmp|failed")
    ts = times.parse_last_style(g(4), g(5), g(6), F.coalesce(times.number(g(7)), F.lit(year)), tz)
    df = df.withColumns({"ts": ts, "failed": failed})
    pick = lambda a, b: F.when(F.col("failed"), a).otherwise(b)
    names = pick(_texts("failed_login_history"), _texts())
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.concat_ws(" ", g(4), g(5), g(6), F.coalesce(g(7), F.lit(str(year)))), "timezone": F.lit(tz), "timezone_confidence": F.when(F.col("ts").isNotNull(), "assumed_local").otherwise("missing"), "timestamp_type": F.when(F.col("ts").isNotNull(), "log_time").otherwise("unknown"), "host": _host(df), "source_path": F.col("source_path"), "source_type": F.lit("login_history"), "parser": F.lit("login"), "event_category": F.lit("authentication"), "event_action": pick("login_failed", "login_session"), "user": g(1), "src_ip": g(3), "severity": pick("medium", "low"), "tags": pick(_texts("login_history", "btmp"), _texts("login_history", "wtmp")), "detection_names": names, "ttp_flags": names, "mitre": pick(_texts("T1110"), _texts("T1078")), "summary": F.concat(pick(F.lit("Failed login for "), F.lit("Login session for ")), g(1), F.lit(" from "), g(3)), "raw": raw, "extra": F.create_map(F.lit("tty"), g(2))})


def parse_bodyfile(lines: DataFrame) -> DataFrame:
    """Up to four events a line, one for each of its times; times from 0 down are none."""
    p = F.split("raw", r"\|")
    df = lines.where((F.trim("raw") != "") & ~F.col("raw").startswith("#")).withColumn("p", p).where("size(p) >= 11")
    kinds = (("atime", "file_accessed", 7), ("mtime", "file_modified", 8), ("ctime", "metadata_changed", 9), ("birthtime", "file_created", 10))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(a).alias("action"), F.get("p", k).alias("value")) for t, a, k in kinds)))
    df = df.withColumn("e", each).withColumn("ts", times.parse_epoch(F.col("e.value"))).where("ts is not null")
    at = lambda k: F.get("p", k)
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.col("e.value"), "timezone_confidence": F.lit("source_epoch"), "timestamp_type": F.col("e.type"), "host": _host(df), "source_path": F.col("source_path"), "source_type": F.lit("bodyfile"), "parser": F.lit("bodyfile"), "event_category": F.lit("filesystem"), "event_action": F.col("e.action"), "uid": at(4), "gid": at(5), "file_path": at(1), "tags": _texts("bodyfile", "filesystem", F.col("e.type")), "summary": F.concat(F.initcap(F.translate("e.action", "_", " ")), F.lit(": "), at(1)), "raw": F.col("raw"), "extra": F.create_map(*(x for n, k in (("inode", 2), ("mode", 3), ("uid", 4), ("gid", 5), ("size", 6)) for x in (F.lit(n), at(k))))})


# Record types, the one that names a group first; detections by part of a rule key.
AUDIT_ORDER = ("EXECVE", "USER_CMD", "SYSCALL", "PATH", "USER_LOGIN", "USER_AUTH", "SERVICE_START", "SERVICE_STOP")
AUDIT_KEYS = {
    "credential_access": "audit_credential_access", "cron_persistence": "audit_cron_persistence", "ssh_key_tampering": "audit_ssh_key_tampering", "kernel_module_load": "audit_kernel_module_load", "kernel_module_remove": "audit_kernel_module_remove",
    "log_tampering": "audit_log_tampering", "privilege_escalation": "audit_privilege_escalation", "exec_from_tmp": "audit_exec_from_tmp", "exec_from_shm": "audit_exec_from_shm",
}


def _decoded(value: Column) -> Column:
    """Values that look like hex are text in hex."""
    text = F.trim(F.translate(F.make_valid_utf8(F.unhex(value).cast("string")), "\x00", " "))
    return F.when(value.rlike("^([0-9A-Fa-f]{2})+$"), F.coalesce(F.nullif(text, F.lit("")), value)).otherwise(value)


def parse_auditd(lines: DataFrame) -> DataFrame:
    """One event for each audit id of a node: fields of its records merged, later ones over earlier, arguments put together, hex decoded."""
    head = r"type=(\w+)\s+msg=audit\((\d+\.\d+):(\d+)\):\s*(.*)"
    raw = F.col("raw")
    df = _once(lines.where(raw.contains("msg=audit(")), cut=_groups(raw, head, 4)).where("size(cut) = 4")
    df = df.withColumns({n: F.get("cut", k) for k, n in enumerate(("type", "epoch", "id", "body"))}).withColumn("node", F.regexp_extract(raw, r"(?:^|\s)node=(\S+)", 1)).drop("cut")
    hosts = [F.first("host").alias("host")] if "host" in lines.columns else []
    # lines move as they are; their fields are taken apart in the many tasks of the groups
    groups = df.groupBy("source_path", "node", "epoch", "id").agg(F.array_sort(F.collect_list(F.struct("line_no", "type", "body", "raw"))).alias("r"), *hosts)

    def taken_apart(body: Column) -> Column:
        pairs = F.regexp_extract_all(body, F.lit(r"(\w+=(?:\"[^\"]*\"|\S+))"), 1)
        return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.trim(p.substr(F.instr(p, "=") + 1, F.length(p)), F.lit('"')).alias("v")))

    df = groups.withColumn("ts", times.parse_epoch(F.col("epoch"))).where("ts is not null")
    df = _once(df, r=F.transform("r", lambda r: F.struct(r["type"].alias("type"), taken_apart(r["body"]).alias("fields"), r["raw"].alias("raw"))))
    df = _once(df, types=F.array_distinct(F.col("r.type")), f=F.flatten(F.col("r.fields")), x=F.flatten(F.filter("r", lambda r: r["type"] == "EXECVE")["fields"]))
    df = _once(df, **{c: F.struct(F.array_distinct(F.col(f"{c}.k")).alias("keys"), F.reverse(F.col(f"{c}.k")).alias("k"), F.reverse(F.col(f"{c}.v")).alias("v")) for c in ("f", "x")})

    def merged(c: str) -> Column:
        """The last value of each key: the first one of the fields in reverse."""
        return F.map_from_arrays(F.col(f"{c}.keys"), F.transform(f"{c}.keys", lambda k: F.get(F.col(f"{c}.v"), (F.array_position(F.col(f"{c}.k"), k) - 1).cast("int"))))

    df = _once(df, f=merged("f"), x=merged("x"))
    df = df.withColumn("t", F.coalesce(*(F.when(F.array_contains("types", n), F.lit(n)) for n in AUDIT_ORDER), F.get("types", 0)))
    f = lambda k: F.nullif(F.try_element_at("f", F.lit(k)), F.lit(""))
    argc = F.coalesce(F.try_element_at("x", F.lit("argc")).try_cast("int"), F.lit(0))
    args = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(argc, F.lit(1)) - 1), lambda i: _decoded(F.try_element_at("x", F.concat(F.lit("a"), i.cast("string"))))), lambda a: a.isNotNull() & (a != ""))
    command = F.coalesce(F.when(argc > 0, F.nullif(F.array_join(args, " "), F.lit(""))), _decoded(f("proctitle")), f("cmd"))
    path = F.get(F.filter(F.flatten(F.transform(F.filter("r", lambda r: r["type"] == "PATH"), lambda r: F.filter(r["fields"], lambda p: p["k"] == "name"))), lambda p: p["v"] != ""), 0)["v"]
    df = _once(df, command_=command, path_=path)
    t = F.col("t")
    account, anomaly = t.isin("USER_CHAUTHTOK", "USER_ACCT", "ADD_USER", "DEL_USER", "USER_MGMT"), t.isin("ANOM_ABEND", "ANOM_PROMISCUOUS", "ANOM_LOGIN_FAILURES")
    run, service, login = t.isin("EXECVE", "USER_CMD"), t.isin("SERVICE_START", "SERVICE_STOP"), t.isin("USER_LOGIN", "USER_AUTH")
    refused = F.coalesce(f("success") == "no", F.lit(False))
    key = F.coalesce(f("key"), F.lit(""))
    names = F.array_sort(F.array_distinct(_some((account, "audit_user_account_change"), (login & (F.coalesce(f("res") == "failed", F.lit(False)) | refused), "audit_authentication_failure"), (anomaly, "audit_anomaly"), *((key.contains(k), v) for k, v in AUDIT_KEYS.items()))))
    tags = F.array_compact(F.array(F.lit("auditd"), F.lower("t"), F.when(refused, F.lit("failed")), F.when(key != "", F.concat(F.lit("audit_key:"), key))))
    return to_timeline(df, {"timestamp": F.col("ts"), "timestamp_raw": F.col("epoch"), "timezone_confidence": F.lit("source_epoch"), "timestamp_type": F.lit("log_time"), "host": _host(df, F.col("node")), "source_path": F.col("source_path"), "source_type": F.lit("auditd"), "parser": F.lit("auditd"), "event_category": F.when(run, "execution").when(account, "persistence").when(service, "system").when(login, "authentication").when(anomaly, "anomaly").otherwise("audit"), "event_action": F.when(run, "process_execution").when(account, "user_account_change").when(service | login | anomaly, F.lower("t")).otherwise("audit_event"), "severity": F.when(run | login, "low").when(account | anomaly, "medium").otherwise("informational"), "uid": f("uid"), "user": F.coalesce(f("acct"), f("auid")), "process": F.coalesce(f("comm"), f("exe")), "pid": f("pid"), "src_ip": f("addr"), "file_path": F.col("path_"), "command": F.col("command_"), "mitre": F.when(run, _texts("T1059.004")).when(account, _texts("T1136.001")).when(login, _texts("T1078")).otherwise(_texts()), "tags": tags, "detection_names": names, "ttp_flags": names, "summary": F.trim(F.concat(F.lit("Audit "), "t", F.lit(": "), F.coalesce("command_", "path_", f("exe"), F.lit("")))), "raw": F.array_join(F.transform("r", lambda r: r["raw"]), "\n"), "extra": F.map_concat(F.create_map(F.lit("audit_id"), F.col("id"), F.lit("audit_node"), F.col("node"), F.lit("record_types"), F.array_join(F.array_sort("types"), ",")), F.create_map(F.lit("fields"), F.to_json("f")))})


# Shells that allow a login; groups that give privileges.
LOGIN_SHELLS = ("/bin/bash", "/bin/sh", "/bin/zsh", "/bin/dash", "/usr/bin/bash", "/usr/bin/zsh")
STRONG_GROUPS = ("root", "sudo", "wheel", "admin", "docker", "lxd")


def _fields(lines: DataFrame, least: int) -> DataFrame:
    return lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#")).withColumn("p", F.split("raw", ":")).where(F.size("p") >= least)


def parse_passwd(lines: DataFrame) -> DataFrame:
    df = _fields(lines, 7).withColumns({n: F.get("p", k) for n, k in (("user", 0), ("uid", 2), ("gid", 3), ("comment", 4), ("home", 5), ("shell", 6))})
    root = (F.col("uid") == "0") & (F.col("user") != "root")
    low = F.col("uid").rlike("^[0-9]+$") & F.col("uid").try_cast("long").between(1, 999) & F.col("shell").isin(*LOGIN_SHELLS)
    low = F.coalesce(low, F.lit(False))
    names = _some((root, "uid0_non_root_account"), (low, "interactive_shell_for_system_account"))
    return _state(df, "passwd", "accounts", "account", "account_observed", user=F.col("user"), uid=F.col("uid"), gid=F.col("gid"), file_path=F.lit("/etc/passwd"), severity=F.when(low, "medium").when(root, "high").otherwise("informational"), tags=F.when(root, _texts("account", "passwd", "privilege_risk")).otherwise(_texts("account", "passwd")), detection_names=names, mitre_candidates=F.when(F.size(names) > 0, _texts("T1136.001")).otherwise(_texts()), summary=F.concat(F.lit("Account observed: "), "user", F.lit(" uid="), "uid", F.lit(" shell="), "shell"), extra=F.create_map(F.lit("comment"), F.col("comment"), F.lit("home"), F.col("home"), F.lit("shell"), F.col("shell")))


def hash_class(value: Column) -> Column:
    return F.when(value.startswith("$1$"), "MD5").when(value.startswith("$5$"), "SHA-256").when(value.startswith("$6$"), "SHA-512").when(value.startswith("$y$"), "yescrypt").when(value.isin("*", "!", "!!", "x", ""), "locked_or_disabled").otherwise("unknown")


def parse_shadow(lines: DataFrame) -> DataFrame:
    """The class of each hash and the day of its change; the hash itself is never kept."""
    df = _fields(lines, 2).withColumns({"user": F.get("p", 0), "hash": F.get("p", 1), "days": F.coalesce(F.get("p", 2), F.lit(""))}).withColumn("ts", times.shadow_days(F.col("days")))
    weak, dated = F.col("hash").startswith("$1$"), F.col("ts").isNotNull()
    pick = lambda a, b: F.when(dated, a).otherwise(b)
    return _state(df, "shadow", "accounts", "account", "password_state_observed", timestamp=F.col("ts"), timestamp_raw=F.col("days"), timestamp_type=pick("password_change_time", "state_observed"), timestamp_precision=pick("day", "not_applicable"), timestamp_confidence=pick("high", "not_applicable"), timezone_confidence=pick("source_epoch", "missing"), user=F.col("user"), file_path=F.lit("/etc/shadow"), severity=F.when(weak, "medium").otherwise("informational"), tags=_texts("account", "shadow"), detection_names=_some((weak, "weak_md5_password_hash")), summary=F.concat(F.lit("Password state observed for "), "user", F.lit(" (last changed: "), "days", F.lit("d)")), raw=F.lit("[shadow hash redacted]"), extra=F.create_map(F.lit("last_change_day"), F.col("days"), F.lit("hash_type"), hash_class(F.col("hash"))))


def parse_group(lines: DataFrame) -> DataFrame:
    df = _fields(lines, 4).withColumns({"group": F.get("p", 0), "gid": F.get("p", 2), "members": F.get("p", 3)})
    some = F.size(F.filter(F.split("members", ","), lambda m: m != "")) > 0
    strong, container = F.col("group").isin(*STRONG_GROUPS) & some, F.col("group").isin("docker", "lxd") & some
    return _state(df, "group", "accounts", "account", "group_observed", gid=F.col("gid"), file_path=F.lit("/etc/group"), severity=F.when(container, "high").when(strong, "medium").otherwise("informational"), tags=_texts("account", "group"), detection_names=_some((strong, "privileged_group_membership"), (container, "container_group_privilege_risk")), mitre_candidates=F.when(strong | container, _texts("T1611", "T1548")).otherwise(_texts()), summary=F.concat(F.lit("Group observed: "), "group", F.lit(" members="), "members"), extra=F.create_map(F.lit("group"), F.col("group"), F.lit("members"), F.col("members")))


def _entries(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", F.trim("raw")).where((F.col("text") != "") & ~F.col("text").startswith("#"))


def _line() -> Column:
    return F.create_map(F.lit("line"), F.col("line_no").cast("string"))


def _where(text: str) -> Column:
    return F.concat(F.lit(text), "source_path", F.lit(":"), F.col("line_no").cast("string"))


def parse_sudoers(lines: DataFrame) -> DataFrame:
    df = _entries(lines).where(~F.col("text").startswith("Defaults"))
    t = F.col("text")
    free = t.contains("NOPASSWD")
    broad = free & t.rlike(r"\bALL\s*(?:,|$)")
    risky = t.rlike(r"(?i)\b(vim|vi|nano|less|more|find|bash|sh|python|perl|ruby|tar|zip|rsync|scp|docker|systemctl|service|journalctl)\b")
    severity = F.when(risky, F.when(free, "high").otherwise("medium")).when(broad, "high").when(free, "medium").otherwise("low")
    return _state(df, "sudoers", "privilege", "privilege", "sudoers_rule_observed", command=t, file_path=F.col("source_path"), severity=severity, tags=_texts("sudo", "privilege"), detection_names=_some((F.lit(True), "sudoers_rule_observed"), (free, "nopasswd_sudo_rule"), (broad, "broad_nopasswd_sudo_rule"), (risky, "dangerous_sudo_rule_candidate")), mitre_candidates=_texts("T1548.003"), summary=_where("Sudoers rule observed in "), extra=_line())


def parse_bodyfile_privilege(lines: DataFrame) -> DataFrame:
    """Files with the set-uid or set-gid bit, and sensitive ones that all may write."""
    df = lines.withColumn("p", F.split("raw", r"\|")).where("size(p) >= 11").withColumns({"path": F.get("p", 1), "mode": F.get("p", 3)})
    df = df.where(F.col("mode").rlike("^[0-7]+$")).withColumn("bits", F.conv("mode", 8, 10).cast("long"))
    bit = lambda n: F.col("bits").bitwiseAND(F.lit(n)) != 0
    open_ = bit(0o2) & F.col("path").rlike("^(/etc/cron|/etc/systemd/system|/etc/init.d|/etc/profile|/etc/pam.d|/usr/local/bin|/usr/local/sbin|/opt)")
    names = _some((bit(0o4000), "suid_file_observed"), (bit(0o2000), "sgid_file_observed"), (open_, "world_writable_sensitive_file"))
    df = df.withColumn("names", names).where("size(names) > 0")
    severity = F.when(open_ | F.col("path").rlike("^(/tmp/|/var/tmp/|/dev/shm/|/home/)"), "high").otherwise("medium")
    return _state(df, "bodyfile_privilege", "privilege", "privilege", "privileged_file_observed", uid=F.get("p", 4), gid=F.get("p", 5), file_path=F.col("path"), severity=severity, tags=_texts("suid_sgid", "privilege"), detection_names=F.col("names"), mitre_candidates=_texts("T1548.001"), summary=F.concat(F.lit("Privileged file mode observed: "), "mode", F.lit(" "), "path"), extra=F.create_map(F.lit("mode"), F.col("mode"), F.lit("size"), F.get("p", 6)))


def parse_capabilities(lines: DataFrame) -> DataFrame:
    df = lines.withColumn("text", F.trim("raw")).where(F.col("text").contains("="))
    strong = F.col("text").rlike("cap_setuid|cap_dac_override")
    return _state(df, "capabilities", "privilege", "privilege", "file_capability_observed", file_path=F.trim(F.regexp_extract("text", r"^([^=]*)=", 1)), severity=F.when(strong, "high").otherwise("medium"), tags=_texts("capabilities", "privilege"), detection_names=_some((F.lit(True), "file_capability_observed"), (strong, "dangerous_file_capability")), mitre_candidates=_texts("T1548"), summary=F.concat(F.lit("File capability observed: "), "text"))


# What makes an entry that runs by itself suspicious; risky modules of authentication.
SUSPICIOUS = r"(?i)(curl|wget|nc|ncat|bash\s+-i|/dev/tcp|python\s+-c|perl\s+-e|base64|/tmp/|/var/tmp/|/dev/shm|rclone|xmrig)"
RISKY_PAM = r"(?i)(pam_exec|pam_python|pam_permit|pam_unix\.so\s+.*nullok|/tmp/|/dev/shm)"


def parse_cron_file(lines: DataFrame) -> DataFrame:
    df = _entries(lines).where(~F.col("text").contains("=") | F.col("text").rlike(r"^(@|\S+\s+\S+\s+\S+\s+\S+\s+\S+)"))
    odd = F.col("text").rlike(SUSPICIOUS)
    return _state(df, "cron_file", "persistence", "persistence", "cron_entry_observed", command=F.col("text"), file_path=F.col("source_path"), severity=F.when(odd, "high").otherwise("low"), tags=_texts("cron", "persistence"), detection_names=_some((F.lit(True), "cron_entry_observed"), (odd, "suspicious_cron_entry")), mitre_candidates=_texts("T1053.003"), summary=_where("Cron entry observed in "), extra=_line())


def parse_systemd_unit(files: DataFrame) -> DataFrame:
    """Whole unit files (``raw``): the first command they start."""
    command = F.nullif(F.trim(F.regexp_extract("raw", r"(?im)^\s*execstart=(.*)$", 1)), F.lit(""))
    df = files.withColumn("cmd", command)
    some, odd, timer = F.col("cmd").isNotNull(), F.coalesce(F.col("cmd").rlike(SUSPICIOUS), F.lit(False)), F.col("source_path").contains(".timer")
    return _state(df, "systemd_unit", "persistence", "persistence", "systemd_unit_observed", command=F.col("cmd"), file_path=F.col("source_path"), severity=F.when(odd, "high").when(some, "medium").otherwise("low"), tags=_texts("systemd", "persistence"), detection_names=_some((F.lit(True), "systemd_unit_observed"), (some, "systemd_service_definition"), (odd, "suspicious_systemd_execstart"), (timer, "systemd_timer_observed")), mitre_candidates=_texts("T1543.002"), summary=F.concat(F.lit("Systemd unit observed: "), "source_path"), raw=F.substring("raw", 1, 8000))


def parse_systemd_listing(files: DataFrame) -> DataFrame:
    made = F.col("raw").rlike(r"\[Service\]|\[Timer\]") & F.col("raw").contains("ExecStart=")
    return _state(files, "systemd", "systemd", "persistence", "systemd_unit_observed", event_action=F.when(made, "systemd_service_definition").otherwise("systemd_unit_observed"), timestamp_type=F.lit("file_observed"), file_path=F.col("source_path"), severity=F.when(made, "medium").otherwise("low"), tags=_texts("systemd"), mitre_candidates=_texts("T1543.002"), summary=F.concat(F.lit("Systemd unit observed: "), "source_path"), raw=F.substring("raw", 1, 4000))


def parse_profile(lines: DataFrame) -> DataFrame:
    df = _entries(lines)
    odd = F.col("text").rlike(SUSPICIOUS) | F.col("text").contains("LD_PRELOAD")
    return _state(df, "shell_profile", "persistence", "persistence", "shell_profile_entry_observed", command=F.col("text"), file_path=F.col("source_path"), severity=F.when(odd, "high").otherwise("informational"), tags=_texts("shell_profile", "persistence"), detection_names=_some((F.lit(True), "shell_profile_entry_observed"), (odd, "suspicious_shell_profile_entry")), mitre_candidates=_texts("T1546.004"), summary=_where("Shell profile entry observed in "), extra=_line())


parse_rc_local = parse_profile


def parse_ld_preload(lines: DataFrame) -> DataFrame:
    return _state(_entries(lines), "ld_preload", "persistence", "persistence", "ld_preload_entry_observed", file_path=F.col("text"), severity=F.lit("high"), tags=_texts("ld_preload", "persistence", "hijack_execution_flow"), detection_names=_texts("ld_so_preload_modified"), mitre_candidates=_texts("T1574.006"), summary=F.concat(F.lit("LD_PRELOAD entry observed: "), "text"), extra=_line())


def parse_pam_config(lines: DataFrame) -> DataFrame:
    df = _entries(lines)
    odd = F.col("text").rlike(RISKY_PAM)
    return _state(df, "pam_config", "persistence", "configuration", "pam_config_entry_observed", command=F.col("text"), file_path=F.col("source_path"), severity=F.when(odd, "high").otherwise("informational"), tags=_texts("pam", "authentication"), detection_names=_some((odd, "pam_backdoor_candidate")), mitre_candidates=F.when(odd, _texts("T1556")).otherwise(_texts()), summary=_where("PAM config entry observed in "), extra=_line())


def parse_authorized_keys(lines: DataFrame) -> DataFrame:
    df = _entries(lines)
    t = F.col("text")
    key = r"^(?:(?:[^ ]+,)*[^ ]+\s+)?(ssh-[a-z0-9-]+|ecdsa-[a-z0-9-]+|sk-[a-z0-9-]+)\s+\S+(?:\s+(.*))?$"
    tags = F.array_compact(F.array(F.lit("ssh"), F.lit("authorized_keys"), F.lit("persistence_candidate"), F.when(t.startswith("command=") | t.contains("from="), F.lit("restricted_key")), F.when(~t.contains("no-pty") & ~t.contains("command="), F.lit("unrestricted_key"))))
    return _state(df, "authorized_keys", "ssh", "persistence", "authorized_key_observed", file_path=F.col("source_path"), severity=F.lit("informational"), tags=tags, detection_names=_texts("authorized_key_present"), mitre_candidates=_texts("T1098.004"), summary=_where("SSH authorized key observed in "), extra=F.map_concat(_line(), F.create_map(F.lit("key_type"), F.regexp_extract(t, key, 1), F.lit("comment"), F.regexp_extract(t, key, 2))))


def parse_known_hosts(lines: DataFrame) -> DataFrame:
    df = _entries(lines).withColumn("h", F.regexp_extract("text", r"^(\S+)", 1))
    return _state(df, "known_hosts", "ssh", "lateral_movement", "known_host_observed", evidence_role=F.lit("context"), dst_ip=F.when(F.col("h").rlike("[0-9]"), F.col("h")), file_path=F.col("source_path"), severity=F.lit("low"), confidence=F.lit("low"), tags=_texts("ssh", "known_hosts"), detection_names=_texts("ssh_known_host_observed"), mitre_candidates=_texts("T1021.004"), summary=F.concat(F.lit("SSH known host observed: "), "h"), extra=_line())


def parse_sshd_config(lines: DataFrame) -> DataFrame:
    df = _entries(lines).where(F.col("text").rlike(r"^\S+\s+\S")).withColumns({"k": F.regexp_extract("text", r"^(\S+)\s+(.*)$", 1), "v": F.regexp_extract("text", r"^(\S+)\s+(.*)$", 2)})
    key, value = F.lower("k"), F.lower(F.trim("v"))
    risky = ((key == "permitrootlogin") & value.isin("yes", "without-password", "prohibit-password")) | (key.isin("passwordauthentication", "permitemptypasswords") & (value == "yes"))
    return _state(df, "sshd_config", "ssh", "configuration", "sshd_config_observed", file_path=F.col("source_path"), severity=F.when(risky, "medium").otherwise("informational"), tags=_texts("ssh", "configuration"), detection_names=F.array_compact(F.array(F.when(risky, F.concat(F.lit("risky_sshd_"), key)))), mitre_candidates=F.when(risky, _texts("T1021.004")).otherwise(_texts()), summary=F.concat(F.lit("sshd config "), "k", F.lit("="), "v"), extra=F.map_concat(_line(), F.create_map(F.lit("key"), key, F.lit("value"), value)))


def ss_rows(lines: DataFrame) -> DataFrame:
    row = r"^(\S+)\s+\d+\s+\d+\s+(\S+):(\d+)\s+(\S+):(\d+|\*)\s*(?:users:\((.+)\))?"
    procs = F.regexp_extract("raw", row, 6)
    g = lambda k: F.regexp_extract("raw", row, k)
    return lines.where(F.col("raw").rlike(row)).withColumns({"state": g(1), "local": F.trim(g(2), F.lit("[]")), "lport": g(3), "peer": F.trim(g(4), F.lit("[]")), "pport": g(5), "proc": F.regexp_extract(procs, r'"([^"]+)",pid=(\d+)', 1), "pid_": F.regexp_extract(procs, r'"([^"]+)",pid=(\d+)', 2)})


def netstat_rows(lines: DataFrame) -> DataFrame:
    row = r"^(tcp6?|udp6?)\s+\d+\s+\d+\s+(\S+):(\d+)\s+(\S+):(\S+)\s+(\S+)?\s*(.*)"
    g = lambda k: F.regexp_extract("raw", row, k)
    return lines.where(F.col("raw").rlike(row)).withColumns({"state": F.trim(g(6)), "local": F.trim(g(2), F.lit("[]")), "lport": g(3), "peer": F.trim(g(4), F.lit("[]")), "pport": g(5), "proc": F.regexp_extract(g(7), r"(\d+)/(\S+)", 2), "pid_": F.regexp_extract(g(7), r"(\d+)/(\S+)", 1)})


# Ports and processes that tell the direction or the risk of a connection.
SUSPICIOUS_OUT = ("4444", "4445", "5555", "6666", "6667", "6668", "6669", "1337", "31337", "8888", "9001", "9090", "1234")
KNOWN_OUT = ("22", "25", "53", "80", "443", "465", "587", "993", "995", "123", "514", "4505", "4506", "8443", "8080", "9443")
KNOWN_LISTEN = ("22", "25", "80", "443", "8080", "8443", "3306", "5432", "6379", "27017", "53", "111", "123", "514", "9090", "4505", "4506")
SUSPICIOUS_LISTEN = ("4444", "5555", "1337", "31337", "6666", "8888", "1234")
SERVERS = ("sshd", "nginx", "apache2", "httpd", "mysqld", "postgres", "redis-server")
CLIENTS = ("ssh", "scp", "sftp", "curl", "wget", "rclone", "nc", "ncat", "socat")


def classify_sockets(rows: DataFrame) -> DataFrame:
    """Listeners and connections of socket rows, with the direction of each connection.

    A connection whose local end a listener of the same file has is inbound; the listeners of a file
    and port are one row after a partial group, so the join adds no rows.
    """
    listens = F.col("peer").isin("*", "0.0.0.0", "::", "[::]") | (F.col("state") == "LISTEN")
    rows = rows.withColumn("listens", listens)
    ends = rows.where("listens").groupBy("source_path", "lport").agg(F.collect_set("local").alias("ends"))
    df = rows.join(ends, ["source_path", "lport"], "left")
    met = F.coalesce(F.array_contains("ends", F.col("local")) | F.arrays_overlap("ends", _texts("0.0.0.0", "::", "*")), F.lit(False))
    proc, lport, pport = F.lower("proc"), F.col("lport").try_cast("int"), F.col("pport").try_cast("int")
    far = (lport >= 32768) & ((pport < 1024) | F.col("pport").isin(*SUSPICIOUS_OUT))
    direction = F.when(met, "inbound").when(proc.isin(*SERVERS), "inbound").when(proc.isin(*CLIENTS), "outbound").when(F.coalesce(far, F.lit(False)), "outbound").otherwise("unknown")
    sure = F.when(met, "high").when(proc.isin(*SERVERS, *CLIENTS) | F.coalesce(far, F.lit(False)), "medium").otherwise("low")
    reason = F.when(met, "local endpoint matches an observed listener").when(proc.isin(*SERVERS), F.concat("proc", F.lit(" is acting as a server process"))).when(proc.isin(*CLIENTS), F.concat("proc", F.lit(" is acting as a client process"))).when(pport.isNull() | lport.isNull(), "socket endpoints do not establish direction").when(far, "ephemeral local port connects to remote service").otherwise("no listener or process-role evidence establishes direction")
    df = df.withColumns({"dir": F.when(~F.col("listens"), direction), "sure": F.when(F.col("listens"), "medium").otherwise(sure), "reason": F.when(~F.col("listens"), reason)})
    out = F.coalesce(F.col("dir") == "outbound", F.lit(False))
    odd_listen, bad_listen = F.col("listens") & ~F.col("lport").isin(*KNOWN_LISTEN) & (lport > 1024), F.col("listens") & F.col("lport").isin(*SUSPICIOUS_LISTEN)
    ssh, bad = out & (F.col("pport") == "22"), out & F.col("pport").isin(*SUSPICIOUS_OUT)
    rare = out & ~F.col("pport").isin(*SUSPICIOUS_OUT, *KNOWN_OUT)
    names = _some((F.col("listens"), "listening_port"), (odd_listen, "unexpected_listening_port"), (bad_listen, "suspicious_listening_port"), (~F.col("listens"), "active_connection"), (ssh, "outbound_ssh_connection"), (bad, "outbound_suspicious_port"), (rare, "outbound_uncommon_port"), (~F.col("listens") & F.col("state").isin("ESTAB", "ESTABLISHED"), "established_connection"))
    tags = F.when(F.col("listens"), _texts("network", "listening")).otherwise(F.array_compact(F.array(F.lit("network"), F.lit("connection"), F.col("dir"), F.when(ssh, F.lit("lateral_movement")), F.when(bad, F.lit("c2_candidate")))))
    inbound = F.col("dir") == "inbound"
    suffix = F.when(F.col("proc") != "", F.concat(F.lit(" ("), "proc", F.lit(")"))).otherwise("")
    summary = F.when(F.col("listens"), F.concat(F.lit("Listening on "), "local", F.lit(":"), "lport", suffix)).otherwise(F.concat(F.initcap("dir"), F.lit(" "), "state", F.lit(" "), "local", F.lit(":"), "lport", F.lit(" -> "), "peer", F.lit(":"), "pport", suffix))
    return _state(df, "network_state", "network", "network", "", event_action=F.when(F.col("listens"), "listening_port").when(F.col("dir").isin("inbound", "outbound"), F.concat("dir", F.lit("_connection"))).otherwise("connection_observed"), src_ip=F.when(out, F.col("local")).when(inbound, F.col("peer")), dst_ip=F.when(out, F.col("peer")).when(inbound, F.col("local")), port=F.when(out, F.col("pport")).otherwise(F.col("lport")), process=F.nullif("proc", F.lit("")), pid=F.nullif("pid_", F.lit("")), severity=F.when(bad_listen | ssh | bad, "high").when(odd_listen | rare, "medium").otherwise("informational"), confidence=F.col("sure"), tags=tags, detection_names=names, mitre_candidates=F.when(ssh, _texts("T1021.004")).when(bad | bad_listen, _texts("T1571")).otherwise(_texts()), summary=summary, extra=F.map_filter(F.create_map(F.lit("state"), F.col("state"), F.lit("direction"), F.col("dir"), F.lit("direction_reason"), F.col("reason")), lambda _, v: v.isNotNull()))


def parse_ss(lines: DataFrame) -> DataFrame:
    return classify_sockets(ss_rows(lines))


def parse_netstat(lines: DataFrame) -> DataFrame:
    return classify_sockets(netstat_rows(lines))


def parse_ps(lines: DataFrame) -> DataFrame:
    """Processes that look wrong by name, by path, or as root from an odd path; the others go."""
    row = r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)$"
    g = lambda k: F.regexp_extract("raw", row, k)
    df = lines.where(F.col("raw").rlike(row)).withColumns({"user": g(1), "pid_": g(2), "cmd": F.trim(g(11))}).withColumn("exe", F.regexp_extract("cmd", r"^(\S+)", 1))
    named = F.col("cmd").rlike(r"(?i)\b(xmrig|kinsing|minerd|xmr-stak|cryptonight|chisel|frpc?|ngrok|cloudflared|nc\s+-[el]|ncat\s+-[el]|socat\s+tcp|bash\s+-i|python.*pty\.spawn|perl.*socket|rclone|megacmd)\b")
    placed = F.col("cmd").rlike(r"(?i)(/tmp/|/var/tmp/|/dev/shm/|/run/user/\d+/|/home/[^/]+/\.cache/)")
    root = (F.col("user") == "root") & ~F.col("cmd").contains("[") & ~F.col("exe").rlike(r"^(/usr/|/sbin/|/bin/|/lib/|/opt/|\[)") & F.col("exe").rlike("/tmp/|/var/tmp/|/dev/shm/|/home/")
    df = df.where(named | placed | root)
    names = _some((F.lit(True), "process_observed"), (named, "suspicious_process"), (placed, "process_from_suspicious_path"), (root, "root_process_from_unusual_path"))
    tags = F.array_compact(F.array(F.lit("process"), F.when(named, F.lit("suspicious")), F.when(placed, F.lit("tmp_execution")), F.when(root, F.lit("privilege_risk"))))
    return _state(df, "process_list", "processes", "execution", "process_running", user=F.col("user"), pid=F.col("pid_"), command=F.col("cmd"), process=F.col("exe"), severity=F.when(named | root, "high").otherwise("medium"), tags=tags, detection_names=names, mitre_candidates=F.when(named, _texts("T1059")).when(placed, _texts("T1059.004")).otherwise(_texts()), summary=F.concat(F.lit("Process running: "), "user", F.lit(" pid="), "pid_", F.lit(" "), F.substring("cmd", 1, 120)), extra=F.create_map(F.lit("stat"), g(8), F.lit("cpu"), g(3), F.lit("mem"), g(4)))
