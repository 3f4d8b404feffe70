"""Detection rules and attack phases as column expressions over whole timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import has_token, severity_of, severity_rank, sorted_set

# Patterns of the rules on executed text, with their tags and techniques. "guarded" rules skip hunts for indicators.
EXECUTION_RULES = (
    ("download_execute_chain", r"(curl|wget)\b.*\|\s*(bash|sh|zsh)|base64\b.*(-d|--decode).*\|\s*(bash|sh)", "high", ("download", "shell", "ingress_tool_transfer"), ("T1105", "T1059.004"), True),
    ("chmod_executable", r"\bchmod\s+\+?x\b", "medium", ("chmod", "execution_prep"), (), False),
    ("account_or_privilege_change", r"\b(sudo\s+-l|sudo\s+su|su\s+-|usermod|useradd|adduser|groupmod|gpasswd)\b", "medium", ("account_change", "privilege"), ("T1136.001", "T1548.003"), False),
    ("cron_modified", r"\b(crontab|/etc/cron|cron\.d)\b", "medium", ("persistence", "cron"), ("T1053.003",), False),
    ("systemd_persistence_or_service_change", r"\b(systemctl\s+(enable|start|restart)|/etc/systemd/system|\.service)\b", "medium", ("persistence", "systemd"), ("T1543.002",), False),
    ("log_or_history_tampering", r"\b(history\s+-c|cat\s+/dev/null\s*>\s*.*history|truncate\s+-s\s+0|rm\s+.*(auth\.log|secure|syslog|messages|audit\.log))\b", "high", ("defense_evasion", "log_tampering"), ("T1070",), False),
    ("archive_creation_candidate", r"\b(tar|zip|7z|rar|gzip|xz)\b.*\b(/home|/var/www|/etc|/root|/opt|/srv)\b", "medium", ("collection", "archive"), ("T1560.001",), False),
    ("database_dump", r"\b(mysqldump|pg_dump|mongodump|redis-cli\s+save)\b", "high", ("collection", "database"), ("T1005",), False),
    ("destructive_command", r"\b(rm\s+-rf|shred|wipe|dd\s+if=)\b", "high", ("impact", "destructive"), ("T1485",), False),
    ("esxi_or_vmware_admin_command", r"\b(vim-cmd|esxcli)\b", "high", ("ransomware", "esxi"), ("T1486",), False),
    ("reverse_shell_or_tunnel_pattern", r"\b(ssh\s+-[rld]|/dev/tcp/|bash\s+-i|pty\.spawn|mkfifo)\b", "high", ("c2", "reverse_shell"), ("T1095", "T1059.004"), True),
    ("cloud_metadata_access", r"\b(curl|wget)\b.*(169\.254\.169\.254|metadata\.google\.internal)", "high", ("cloud", "credential_access"), ("T1552.005",), False),
    ("outbound_ssh_command", r"\bssh\s+(?!-[vVT])\S+@\S+|\bssh\s+\S+\s+\S+@", "high", ("lateral_movement", "ssh"), ("T1021.004",), True),
    ("outbound_file_transfer_command", r"\b(scp|rsync)\s+.*\S+@\S+:", "high", ("lateral_movement", "file_transfer"), ("T1021.004", "T1105"), False),
    ("network_connectivity_test", r"\b(telnet|nc\s+-[zvw])\s+\S+\s+\d+", "medium", ("reconnaissance", "network_probe"), ("T1046",), False),
)
# Groups of tools by name, with severity and techniques.
TOOL_GROUPS = (
    ("exfil_tool_usage", ("rclone", "megacmd", "aws", "gsutil", "azcopy", "scp", "rsync", "sftp"), "high", ("T1567", "T1105")),
    ("tunnel_or_proxy_tool", ("chisel", "frp", "ngrok", "cloudflared", "socat", "ncat", "nc"), "high", ("T1090",)),
    ("miner_execution", ("xmrig", "kinsing", "minerd", "xmr-stak"), "high", ("T1496",)),
    ("network_scanner", ("nmap", "masscan", "zmap"), "medium", ("T1046",)),
    ("cloud_container_tool", ("kubectl", "docker", "crictl", "ctr", "nerdctl"), "medium", ("T1613",)),
)
# Paths of credentials, and beginnings of lines that are commands and no passwords.
SECRET_PATHS = ("/etc/shadow", "id_rsa", "id_ed25519", ".aws/credentials", ".kube/config", "authorized_keys")
COMMAND_STARTS = (
    "echo ", "cat ", "ls ", "cd ", "vi ", "vim ", "nano ", "grep ", "find ", "sudo ", "chmod ", "chown ", "mv ", "cp ", "rm ", "mkdir ", "touch ", "export ", "source ", ".", "alias ", "unalias ", "#", "man ", "help ",
    "systemctl ", "service ", "yum ", "apt ", "dnf ", "pip ", "git ", "docker ", "kubectl ", "curl ", "wget ", "ssh ", "scp ", "rsync ", "tar ", "zip ", "unzip ", "gzip ", "passwd ", "useradd ", "adduser ", "groupadd ",
    "usermod ", "groupmod ", "chage ", "mount ", "umount ", "fdisk ", "df ", "du ", "free ", "top ", "ps ", "kill ", "pkill ", "iptables ", "firewall", "hostname", "ifconfig", "ip ", "route ", "netstat ", "ss ", "ping ",
    "traceroute ", "dig ", "nslookup ", "history", "exit", "logout", "reboot", "shutdown", "poweroff", "uname ", "whoami", "id ", "who ", "w ", "last ", "uptime", "date ", "cal ", "head ", "tail ", "less ", "more ", "wc ",
    "sort ", "awk ", "sed ", "cut ", "tr ", "diff ", "stat ", "file ", "type ", "which ", "whereis ", "locate ",
)
# Characters that count as special in a password, and text of hunts for indicators.
_SPECIAL = r"""[!@#$%^&*()_+\-=\[\]{}|;':",./<>?~`]"""
_HUNT = r"\b(grep|egrep|fgrep|rg)\b.*(curl\|wget|bash -i|python\.\*connect|exec\.\*socket|/dev/tcp|nc \|)"


# Paths of temporary files, and commands that set a password.
_TMP_PATH = r"(/tmp|/var/tmp|/dev/shm|/run)/[^\s;|&]+"
_SET_PASSWORD = r"\bpasswd\s+\S+"


def event_text() -> Column:
    """All searchable text of an event in lower case; empty parts are left out."""
    return F.lower(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("command", "file_path", "summary", "raw"))))


def executed_text() -> Column:
    """What an event ran: its command, else path and text of an execution, else nothing."""
    ran = (F.col("event_category") == "execution") | F.col("event_action").isin("sudo_command", "process_execution", "shell_command")
    other = F.concat_ws(" ", F.nullif("file_path", F.lit("")), F.nullif("raw", F.lit("")))
    return F.lower(F.when(F.coalesce("command", F.lit("")) != "", F.col("command")).when(ran, other).otherwise(F.lit("")))


def indicator_search() -> Column:
    """Whether an event is a hunt for indicators, not their use."""
    text = F.lower(F.concat_ws(" ", F.nullif("command", F.lit("")), F.nullif("raw", F.lit(""))))
    return text.rlike(_HUNT) | (text.contains("profile tampering") & text.contains("grep -e"))


def plaintext_password() -> Column:
    """One token of 4 to 64 characters, of three classes or more, that begins like no command; in shell histories."""
    cmd = F.trim(F.coalesce("command", F.lit("")))
    classes = sum((F.when(cmd.rlike(p), 1).otherwise(0) for p in ("[A-Z]", "[a-z]", "[0-9]", _SPECIAL)), F.lit(0))
    starts = F.lit(False)
    for p in COMMAND_STARTS:
        starts = starts | cmd.startswith(p)
    return (F.col("source_type") == "shell_history") & ~starts & ~cmd.contains(" ") & F.length(cmd).between(4, 64) & (classes >= 3)


def _hit(name: str, severity: str, tags: tuple[str, ...], mitre: tuple[str, ...]) -> Column:
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), texts(tags).alias("tags"), texts(mitre).alias("mitre"))


def builtin_hits() -> Column:
    """All rules that an event meets, as an array of (name, severity, tags, mitre). Needs columns ``text``, ``ran`` and ``hunt``."""
    text, ran, hunt = F.col("text"), F.col("ran"), F.col("hunt")
    tests = [(ran.rlike(pattern) & ~hunt if guarded else ran.rlike(pattern), _hit(name, severity, tags, mitre)) for name, pattern, severity, tags, mitre, guarded in EXECUTION_RULES]
    secret = F.lit(False)
    for p in SECRET_PATHS:
        secret = secret | text.contains(p)
    tests += [
        (text.rlike(_TMP_PATH), _hit("execution_or_artifact_from_tmp", "medium", ("suspicious_path", "tmp_execution"), ("T1059.004",))),
        ((F.col("evidence_role") == "behavior") & secret, _hit("credential_material_access", "high", ("credential_access", "secrets"), ("T1552.001",))),
        (text.contains("docker.sock"), _hit("docker_socket_access", "high", ("container", "privilege"), ("T1611",))),
        (ran.rlike(_SET_PASSWORD) & ~ran.contains("change"), _hit("password_set_command", "medium", ("credential_change", "account_management"), ("T1098",))),
        (plaintext_password(), _hit("plaintext_password_in_history", "critical", ("credential_exposure", "password_leak"), ("T1552.001",))),
    ]
    for name, tools, severity, mitre in TOOL_GROUPS:
        any_tool = F.lit(False)
        for tool in tools:
            any_tool = any_tool | has_token(ran, tool)
        tests.append((any_tool, _hit(name, severity, ("tooling", name), mitre)))
    return F.array_compact(F.array(*(F.when(test, hit) for test, hit in tests)))


def add_hits(events: DataFrame, hits: Column) -> DataFrame:
    """Add rule hits to an event: names, flags, tags, the higher severity, and techniques, which are candidates for what is no behaviour."""
    kept = events.columns
    df = events.withColumn("hits", hits)
    each = lambda field: F.transform("hits", lambda h: h[field])
    mitre = F.flatten(each("mitre"))
    behaviour = F.col("evidence_role") == "behavior"
    rank = F.greatest(severity_rank(F.col("severity")), F.coalesce(F.array_max(F.transform("hits", lambda h: severity_rank(h["severity"]))), F.lit(0)))
    new = {
        "detection_names": sorted_set(F.col("detection_names"), each("name")),
        "ttp_flags": sorted_set(F.col("ttp_flags"), each("name")),
        "tags": sorted_set(F.col("tags"), F.flatten(each("tags"))),
        "severity": F.when(rank > severity_rank(F.col("severity")), severity_of(rank)).otherwise(F.col("severity")),
        "mitre": F.when(behaviour, sorted_set(F.col("mitre"), mitre)).otherwise(F.col("mitre")),
        "mitre_candidates": F.when(~behaviour, sorted_set(F.col("mitre_candidates"), mitre)).otherwise(F.col("mitre_candidates")),
    }
    new = {k: F.when(F.size("hits") > 0, v).otherwise(F.col(k)) for k, v in new.items()}
    return df.withColumns(new).select(*kept)


#: Words of which a text has one if any built-in rule on text fits it, and parts of words.
_NEEDED_WORDS = (
    "chmod", "sudo", "su", "usermod", "useradd", "adduser", "groupmod", "gpasswd", "crontab", "cron.d", "systemctl", "history", "cat", "truncate", "rm", "tar", "zip", "7z", "rar", "gzip", "xz", "mysqldump", "pg_dump", "mongodump", "redis-cli", "shred", "wipe", "dd", "vim-cmd",
    "esxcli", "ssh", "bash", "pty.spawn", "mkfifo", "scp", "rsync", "telnet", "nc", "passwd", *(tool for _, tools, *_ in TOOL_GROUPS for tool in tools),
)
_NEEDED_PARTS = ("curl", "wget", "base64", "/etc/cron", "/etc/systemd/system", ".service", "/dev/tcp/", "docker.sock", *SECRET_PATHS, "/tmp/", "/dev/shm/", "/run/")  # noqa: S108
_NEEDED = r"(?<![a-z0-9_])(" + "|".join(sorted({w.replace(".", r"\.") for w in _NEEDED_WORDS})) + r")(?![a-z0-9_])|" + "|".join(p.replace(".", r"\.") for p in _NEEDED_PARTS)


def may_hit() -> Column:
    """Whether any built-in rule can fit: one search for the words that their patterns need, and the rule on passwords by its source."""
    return F.col("text").rlike(_NEEDED) | F.col("ran").rlike(_NEEDED) | (F.col("source_type") == "shell_history") & ~F.coalesce("command", F.lit("")).contains(" ")


def apply_builtin_rules(events: DataFrame) -> DataFrame:
    """All built-in rules in one projection over the timeline; no shuffle, no join. Most events of a timeline hold no word that a rule needs, and one search tells them."""
    texts = events.withColumns({"text": event_text(), "ran": executed_text()}).withColumn("hunt", indicator_search())
    hits, none = builtin_hits(), F.array().cast("array<struct<name:string,severity:string,tags:array<string>,mitre:array<string>>>")
    return add_hits(texts, F.when(F.coalesce(may_hit(), F.lit(True)), hits).otherwise(none)).select(*events.columns)


def tag_tools(events: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Tools of a rule pack by id: executed if the event ran anything and is no hunt, else observed.

    Rules have ``match_literals``, ``category``, ``confidence_when_matched`` and ``mitre``. Literals of
    word characters are tokens, others substrings, in any case. A pack is of bounded size; all of it
    becomes one expression.
    """
    texts = events.withColumns({"text": event_text(), "ran": executed_text(), "hunt": indicator_search()})
    executed = (F.col("ran") != "") & ~F.col("hunt")
    hits = []
    for tool, rule in tools.items():
        sure = rule.get("confidence_when_matched") or "medium"
        tags = ("tooling", f"tool.{tool}", f"tool_category.{rule.get('category') or 'tooling'}", f"tool_confidence.{sure}")
        level = {"high": "high", "medium": "medium"}.get(sure, "low")
        mitre = tuple(rule.get("mitre", ()))
        found = _any(F.col("text"), [x.lower() for x in rule.get("match_literals", []) if x.strip()])
        hits.append(F.when(found & executed, _hit(f"tool_{tool}_executed", level, tags, mitre)).when(found, _hit(f"tool_{tool}_observed", "low", tags, mitre)))
    return add_hits(texts, F.array_compact(F.array(*hits))).select(*events.columns)


def _any(text: Column, literals: list[str]) -> Column:
    found = F.lit(False)
    for literal in literals:
        simple = literal and all(c.isalnum() or c in "_.+-" for c in literal)
        found = found | (has_token(text, literal) if simple else text.contains(literal))
    return found


def tag_ttps(events: DataFrame, ttps: dict[str, dict]) -> DataFrame:
    """Rules of a pack by id on an event's detections, action or tags as they were before.

    Rules have ``match_detection_names``, ``match_event_actions``, ``match_tags``, ``severity``,
    ``confidence_when_matched`` and ``mitre``.
    """
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    hits = []
    for ttp, rule in ttps.items():
        test = F.lit(False)
        if rule.get("match_detection_names"):
            test = test | F.arrays_overlap("detection_names", texts(rule["match_detection_names"]))
        if rule.get("match_event_actions"):
            test = test | F.col("event_action").isin(*rule["match_event_actions"])
        if rule.get("match_tags"):
            test = test | F.arrays_overlap("tags", texts(rule["match_tags"]))
        tags = ("ttp", f"ttp.{ttp}", f"ttp_confidence.{rule.get('confidence_when_matched', 'medium')}")
        hits.append(F.when(test, _hit(ttp, rule.get("severity", "medium"), tags, tuple(rule.get("mitre", ())))))
    return add_hits(events, F.array_compact(F.array(*hits)))


def classify_attack_phases(events: DataFrame, techniques: DataFrame, signals: DataFrame, order: DataFrame) -> DataFrame:
    """Phases of an event from its techniques.

    A confirmed technique of behaviour gives the phases that its signals hint at, else its only
    phase; all phases of any other technique, and of techniques of what is no behaviour, are
    candidates. Signals are category, action, tags, detections and flags, in any case. Tables:
    ``techniques`` (mitre, phase), ``signals`` (signal, phase), ``order`` (phase, place); all are
    rule tables and become maps in the expression, so no event is shuffled.
    """
    listed = lambda df, key: {r[key]: sorted(r["phases"]) for r in df.groupBy(key).agg(F.collect_set("phase").alias("phases")).collect()}
    by_technique, by_signal = listed(techniques, "mitre"), listed(signals, "signal")
    places = [r["phase"] for r in order.orderBy("place").collect()]
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if d else F.create_map().cast("map<string,array<string>>")
    none = F.array().cast("array<string>")
    look = lambda table_, names: F.transform(F.coalesce(names, none), lambda n: F.coalesce(F.try_element_at(table_, n), none))
    own = F.concat(F.array("event_category", "event_action"), *(F.coalesce(c, none) for c in ("tags", "detection_names", "ttp_flags")))
    hints = F.flatten(look(table(by_signal), F.transform(F.array_compact(own), lambda n: F.lower(F.trim(n)))))
    df = events.withColumns({"hints": hints, "sure": look(table(by_technique), F.col("mitre")), "maybe": F.flatten(look(table(by_technique), F.col("mitre_candidates")))})
    behaviour = F.coalesce(F.col("evidence_role") == "behavior", F.lit(False))

    def confirmed(p: Column) -> Column:
        hinted = F.array_intersect(p, F.col("hints"))
        return F.when(~behaviour, none).when(F.size(hinted) > 0, hinted).when(F.size(p) == 1, p).otherwise(none)

    def possible(p: Column) -> Column:
        return F.when((F.size(confirmed(p)) == 0), p).otherwise(none)

    ordered = lambda names: F.filter(F.array(*map(F.lit, places)).cast("array<string>"), lambda p: F.array_contains(names, p))
    found = F.flatten(F.transform("sure", confirmed))
    rest = F.concat(F.flatten(F.transform("sure", possible)), F.col("maybe"))
    return df.withColumn("attack_phases", ordered(found)).withColumn("attack_phase_candidates", F.array_except(ordered(rest), F.col("attack_phases"))).select(*events.columns)


def fill_attack_phases(events: DataFrame, techniques: DataFrame, signals: DataFrame, order: DataFrame) -> DataFrame:
    """Classify events that have neither phases nor candidates; others keep theirs."""
    empty = (F.coalesce(F.size("attack_phases"), F.lit(0)) <= 0) & (F.coalesce(F.size("attack_phase_candidates"), F.lit(0)) <= 0)
    kept = events.withColumns({"had": F.col("attack_phases"), "might": F.col("attack_phase_candidates"), "empty": empty})
    new = classify_attack_phases(kept, techniques, signals, order)
    back = {c: F.when(F.col("empty"), F.col(c)).otherwise(F.col(o)) for c, o in (("attack_phases", "had"), ("attack_phase_candidates", "might"))}
    return new.withColumns(back).select(*events.columns)


def phase_counts(events: DataFrame) -> DataFrame:
    """Confirmed and candidate events per phase."""
    sure = events.select(F.explode("attack_phases").alias("phase"), F.lit(1).alias("c"), F.lit(0).alias("m"))
    maybe = events.select(F.explode("attack_phase_candidates").alias("phase"), F.lit(0).alias("c"), F.lit(1).alias("m"))
    return sure.unionAll(maybe).groupBy("phase").agg(F.sum("c").alias("confirmed"), F.sum("m").alias("candidates"))
