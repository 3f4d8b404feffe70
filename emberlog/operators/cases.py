"""Across collections: shared values, duplicates, fingerprints, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import SEVERITIES, has_token, severity_rank
from emberlog.operators.behaviour import iso
from emberlog.operators.timeline import assign_event_ids, dedupe_events, first_ids, first_n, union_sources

# Tools looked for across hosts, and those of high severity.
SHARED_TOOLS = ("rclone", "anydesk", "teamviewer", "rustdesk", "screenconnect", "logmein", "chisel", "frp", "ngrok", "cloudflared", "xmrig", "kubectl", "docker", "aws", "gsutil", "azcopy")
HIGH_TOOLS = ("rclone", "anydesk", "xmrig", "chisel", "frp", "ngrok")
SENSITIVE_PATHS = r"^(/tmp|/var/tmp|/dev/shm|/run|/etc/ssh|/root/.ssh|/home/.+/.ssh)"
SHARED_ACTIONS = ("ssh_login_success", "sudo_command", "password_changed", "user_created", "user_modified", "account_unlocked")


def collection_of() -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in ("collection_id", "collection_host", "host")))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def summarise(events: DataFrame, kind: str, value: Column, high: Column | None = None, ids: int = 30) -> DataFrame:
    """A row for each value of a kind and collection: counts, times and the first ids, which add up.

    Rows of a collection depend on that collection alone, so summaries may be kept as a table, and a
    new collection is summarised without the others. Groups are partial first, ids are cut before they meet.
    """
    used = events.withColumn("value", value).where("value <> ''").withColumn("collection", collection_of())
    keys = ["value", "collection"]
    each = used.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.coalesce(high, F.lit(False)) if high is not None else F.lit(False)).alias("high"), F.count_if(F.col("event_action") == "ssh_login_failure").alias("failed"), F.count_if(F.col("event_action") == "ssh_login_success").alias("won"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    order = F.struct(F.col("timestamp").isNull().alias("undated"), "timestamp", "event_id")
    firsts = first_n(used, keys, [F.col("timestamp").asc_nulls_last(), F.col("event_id")], ids).groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("ids"))
    same = [each[k].eqNullSafe(firsts[k]) for k in keys]
    return each.join(firsts, same[0] & same[1]).select(F.lit(kind).alias("type"), each["value"], each["collection"], "n", "high", "failed", "won", "first", "last", "ids")


def correlations(summaries: DataFrame, least: int = 2, ids: int = 20, many: int = 30) -> DataFrame:
    """Values that ``least`` collections or more have, from their summaries: title, summary, counts, collections and the first ids."""
    keys = ["type", "value"]
    found = summaries.groupBy(*keys).agg(F.count("*").alias("collections"), F.sum("n").alias("events"), F.bool_or("high").alias("high"), F.sum("failed").alias("failures"), F.sum("won").alias("successes"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.array_sort(F.collect_set("collection")).alias("collection_names"))
    found = found.where(F.col("collections") >= least)
    each = summaries.select(*keys, F.explode("ids").alias("i")).select(*keys, F.col("i"), F.col("i.event_id").alias("event_id"))
    firsts = first_ids(each, keys, [F.col("i")], many)
    c, value, n = F.col, F.col("value"), F.col("collections")
    # Texts of the correlations.
    titles = {
        "shared_source_ip": _text("Shared authentication source IP across ", n, " collections"),
        "shared_user_activity": _text("Shared suspicious user activity: ", value),
        "shared_tooling": _text("Shared tool observed: ", value),
        "shared_suspicious_path": _text("Shared suspicious path: ", value),
        "cross_host_high_signal_timeline": F.lit("Cross-collection high-signal activity timeline"),
    }
    summary_of = {
        "shared_source_ip": _text(value, " appears in authentication activity across ", n, " collections with ", c("failures"), " failure(s) and ", c("successes"), " success(es). Treat as shared activity observed unless outbound host-to-host evidence exists."),
        "shared_user_activity": _text("User ", value, " appears in suspicious authentication, sudo, or account activity across ", n, " collections."),
        "shared_tooling": _text(value, " appears across ", n, " collections. Treat as shared tooling observed pending raw-line validation."),
        "shared_suspicious_path": _text(value, " appears in suspicious path activity across ", n, " collections."),
        "cross_host_high_signal_timeline": _text(c("events"), " high-signal event(s) span ", n, " collections between ", iso(c("first_seen")), " and ", iso(c("last_seen")), ". This is a possible campaign-level pattern, not lateral movement by itself."),
    }
    by_type = lambda texts: F.coalesce(*(F.when(c("type") == t, x) for t, x in texts.items()))
    cut = F.when(c("type") == "cross_host_high_signal_timeline", c("event_ids")).otherwise(F.slice("event_ids", 1, ids))
    return found.join(firsts, keys).select("type", F.when(c("high"), "high").otherwise("medium").alias("severity"), by_type(titles).alias("title"), by_type(summary_of).alias("summary"), "value", "collections", "events", "failures", "successes", "first_seen", "last_seen", "collection_names", cut.alias("event_ids"))


def _source_ips(events: DataFrame) -> DataFrame:
    used = events.where((F.col("event_category") == "authentication") | F.array_join("tags", ",").contains("bruteforce"))
    return summarise(used, "shared_source_ip", F.col("src_ip"), F.col("event_action") == "ssh_login_success")


def _users(events: DataFrame, actions: tuple[str, ...] = SHARED_ACTIONS) -> DataFrame:
    return summarise(events.where(F.col("event_action").isin(*actions)), "shared_user_activity", F.col("user"))


def _tools(events: DataFrame, tools: tuple[str, ...] = SHARED_TOOLS, high: tuple[str, ...] = HIGH_TOOLS) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "command", "file_path", "summary", "raw"))
    found = F.array_compact(F.array(*(F.when(has_token(text, t), F.lit(t)) for t in tools)))
    return summarise(events.withColumn("tool", F.explode(found)), "shared_tooling", F.col("tool"), F.col("tool").isin(*high))


def _paths(events: DataFrame, sensitive: str = SENSITIVE_PATHS) -> DataFrame:
    text = F.concat_ws(" ", "command", "summary", "raw")
    path = F.coalesce(F.nullif("file_path", F.lit("")), F.nullif(F.regexp_extract(text, r"((?:/tmp|/var/tmp|/dev/shm|/run)/[^\s;|&]+)", 1), F.lit("")))
    return summarise(events, "shared_suspicious_path", F.when(path.rlike(sensitive), path))


def _high_signal(events: DataFrame) -> DataFrame:
    used = events.where((severity_rank(F.col("severity")) >= 3) & F.col("timestamp").isNotNull())
    return summarise(used, "cross_host_high_signal_timeline", F.lit("high_signal_timeline"))


def case_summaries(events: DataFrame) -> DataFrame:
    """What ``correlations`` needs of collections, all kinds in one table. Summaries of other collections are appended to it."""
    return union_sources(*(f(events) for f in (_source_ips, _users, _tools, _paths, _high_signal)))


_PLAIN = ("failures", "successes", "first_seen", "last_seen")


def shared_source_ip(events: DataFrame) -> DataFrame:
    """Addresses of logins in several collections, with how many failed and succeeded; high if any succeeded."""
    return correlations(_source_ips(events)).drop("first_seen", "last_seen")


def shared_user(events: DataFrame, actions: tuple[str, ...] = SHARED_ACTIONS) -> DataFrame:
    return correlations(_users(events, actions)).drop(*_PLAIN)


def shared_tool(events: DataFrame, tools: tuple[str, ...] = SHARED_TOOLS, high: tuple[str, ...] = HIGH_TOOLS) -> DataFrame:
    """Each tool once an event, as a token of its command, path, summary or text."""
    return correlations(_tools(events, tools, high)).drop(*_PLAIN)


def shared_path(events: DataFrame, sensitive: str = SENSITIVE_PATHS) -> DataFrame:
    """Sensitive paths: the event's own, else the first one under a temporary folder in its text."""
    return correlations(_paths(events, sensitive)).drop(*_PLAIN)


def cross_host_high_signal(events: DataFrame, ids: int = 30) -> DataFrame:
    """One row on dated events of high or critical severity, if two collections have them."""
    return correlations(_high_signal(events), many=ids).drop("failures", "successes")


def correlations_to_findings(correlations: DataFrame) -> DataFrame:
    """Correlations as findings, with their own titles, summaries and collections; those without a title or summary get none of their own."""
    own = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return correlations.select(own("title", "Case Correlation"), own("severity", "medium"), F.lit("medium").alias("confidence"), "event_ids", own("summary", ""), F.array(F.lit("case_correlation"), F.col("type")).alias("tags"), F.col("collection_names").alias("collections"))


def case_source_index(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Per collection: events, dated ones, findings-worthy ones, and its sources by status."""
    counts = events.groupBy("collection_id").agg(F.count("*").alias("events"), F.count("timestamp").alias("timed"), F.count_if(severity_rank(F.col("severity")) >= 3).alias("high_events"))
    files = sources.groupBy("collection_id").agg(F.count("*").alias("sources"), F.count_if(F.col("parser_status") == "error").alias("errors"))
    return counts.join(files, "collection_id", "full")


def source_coverage(sources: DataFrame) -> DataFrame:
    return sources.groupBy("parser_status").agg(F.count("*").alias("sources"), F.count_distinct("source_type").alias("source_types"), F.sum("event_count").alias("events"))


def evidence_coverage(inventory: DataFrame) -> DataFrame:
    """Files by coverage status, with the first ten of each."""
    counts = inventory.groupBy("coverage_status").agg(F.count("*").alias("files"))
    return counts.join(first_ids(inventory, ["coverage_status"], [F.col("relative")], 10, "relative", "first_files"), "coverage_status")


def collection_fingerprint(inventory: DataFrame, header: str = "", columns: tuple[str, ...] = ("relative", "size", "sha256")) -> DataFrame:
    """Per collection, SHA-256 of its sorted distinct ``path|size|hash`` lines.

    A collection's list of files is one value by definition; lines are made distinct in partial groups first.
    """
    lines = inventory.select("collection_id", F.concat_ws("|", *columns).alias("line")).distinct()
    text = F.concat(F.lit(header), F.array_join(F.array_sort(F.collect_list("line")), "\n"))
    return lines.groupBy("collection_id").agg(F.sha2(text, 256).alias("fingerprint"))


def duplicate_collections(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints that two or more collections share; the smallest id is canonical."""
    return fingerprints.groupBy("fingerprint").agg(F.min("collection_id").alias("canonical"), F.array_sort(F.collect_set("collection_id")).alias("collections")).where(F.size("collections") > 1)


def exclude_duplicates(events: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Events without those of collections that repeat another."""
    groups = fingerprints.groupBy("fingerprint").agg(F.min("collection_id").alias("canonical"))
    repeats = fingerprints.join(groups, "fingerprint").where("collection_id <> canonical").select("collection_id")
    return events.join(repeats, "collection_id", "left_anti")


def duplicate_finding(fingerprints: DataFrame, n: int = 50) -> DataFrame:
    """One finding if collections repeat others: how many, and the first ``n`` of them. Their events stay in the timeline."""
    groups = fingerprints.groupBy("fingerprint").agg(F.min("collection_id").alias("canonical"))
    repeats = fingerprints.join(groups, "fingerprint").where("collection_id <> canonical").select("collection_id", F.lit(1).alias("one"))
    ids = first_ids(repeats, ["one"], [F.col("collection_id")], n, "collection_id", "collections")
    total = repeats.groupBy("one").agg(F.count("*").alias("repeated"))
    summary = F.concat(F.lit("Detected "), F.col("repeated").cast("string"), F.lit(" byte-equivalent repeated collection(s)."))
    tags = F.array(*map(F.lit, ("duplicate_collection", "evidence_quality", "case_control")))
    return total.join(ids, "one").select(F.lit("Duplicate Collection Evidence Detected").alias("title"), F.lit("medium").alias("severity"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("event_ids"), summary.alias("summary"), tags.alias("tags"), "repeated", "collections")


def summary_header(events: DataFrame, findings: DataFrame, storylines: DataFrame | None = None) -> DataFrame:
    a = events.agg(F.count("*").alias("events"), F.count("timestamp").alias("timed"), F.count_distinct(collection_of()).alias("collections"))
    b = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin(*SEVERITIES[3:])).alias("high_findings"))
    c = events.limit(0).agg(F.count("*").alias("storylines")) if storylines is None else storylines.agg(F.count("*").alias("storylines"))
    return a.crossJoin(b).crossJoin(c)


def account_summary(changes: DataFrame, n: int = 10) -> DataFrame:
    """Per kind of change: how many users, and the first of them."""
    each = changes.select("change", "user").distinct()
    return each.groupBy("change").agg(F.count("*").alias("users")).join(first_ids(each, ["change"], [F.col("user")], n, "user", "first_users"), "change")


def case_timeline(*collections: DataFrame) -> DataFrame:
    """The timelines of all collections as one: united, without duplicates, with ids."""
    united = union_sources(*collections).withColumn("event_id", F.lit(None).cast("string"))
    return assign_event_ids(dedupe_events(united))


def network_state_summary(events: DataFrame, n: int = 10) -> DataFrame:
    """One row on socket snapshots: listeners, connections by direction, undated rows, first suspicious ones."""
    used = events.where(F.col("source_type") == "network_state")
    totals = used.agg(F.count_if(F.col("event_action") == "listening_port").alias("listeners"), F.count_if(F.col("event_action").contains("inbound")).alias("inbound"), F.count_if(F.col("event_action").contains("outbound")).alias("outbound"), F.count_if(F.col("timestamp").isNull()).alias("untimed"), F.count_if(severity_rank(F.col("severity")) >= 2).alias("suspicious"))
    first = used.where(severity_rank(F.col("severity")) >= 2).orderBy("summary").limit(n).agg(F.array_sort(F.collect_list("summary")).alias("first_suspicious"))
    return totals.crossJoin(first)


def exchange_fingerprint(inventory: DataFrame, header: str = "exchange-v1\n") -> DataFrame:
    return collection_fingerprint(inventory, header, ("relative", "sha256", "size"))
