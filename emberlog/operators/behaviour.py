"""Behaviour over time: failures before success, campaigns, sequences, findings by policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.text import severity_rank, sorted_set
from emberlog.operators.correlate import ioc_finding
from emberlog.operators.ranges import flag, next_rows, ordered_ranges, positions, with_halo
from emberlog.operators.timeline import first_ids, first_n

# Names of actions and detections that make a finding.
FINDING_POLICIES = (
    "download_execute_chain", "credential_material_access", "log_or_history_tampering", "cloud_metadata_access", "docker_socket_access", "exfil_tool_usage", "miner_execution", "destructive_command",
    "reverse_shell_or_tunnel_pattern", "uid0_non_root_account", "container_group_privilege_risk", "nopasswd_sudo_rule", "broad_nopasswd_sudo_rule", "dangerous_sudo_rule_candidate", "suspicious_cron_entry",
    "suspicious_systemd_execstart", "ld_so_preload_modified", "pam_backdoor_candidate", "dangerous_file_capability", "suid_file_observed", "sgid_file_observed", "audit_exec_from_tmp", "audit_credential_access",
    "audit_ssh_key_tampering", "audit_kernel_module_load", "world_writable_sensitive_file", "failed_login_history", "audit_authentication_failure", "audit_anomaly", "plaintext_password_in_history",
    "outbound_ssh_command", "outbound_file_transfer_command", "outbound_ssh_connection", "account_created_since_backup", "account_deleted_since_backup", "account_unlocked_since_backup", "root_password_changed",
    "privileged_group_member_added", "password_changed_since_backup", "auth_user_created", "auth_user_deleted", "auth_password_changed",
)
# Those of them that are of medium severity.
MEDIUM_POLICIES = ("suid_file_observed", "sgid_file_observed", "container_group_privilege_risk", "failed_login_history", "audit_authentication_failure", "audit_anomaly")


def text(*parts: Column | str) -> Column:
    """Parts joined; a column without a value is ``unknown``."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts))


def iso(ts: Column) -> Column:
    """A time as ISO 8601 in UTC, with a fraction where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""), F.lit("Z"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def success_after_failures(events: DataFrame, window_seconds: int = 1800, least: int = 5, failure: str = "ssh_login_failure", success: str = "ssh_login_success", last: int = 5) -> DataFrame:
    """Successes with ``least`` failures or more of the same user and address in the time before, both ends included; null keys are equal.

    ``failure_ids`` are the ``last`` of them, in order of time.

    Time is cut into buckets of the window's length, and failures go to their own and the next one,
    so a bucket holds all that its successes need and a hot pair of user and address is many groups.
    Failures are numbered in each, and a success asks for the ``last`` numbers before it: an
    equi-join of a few rows a hit.
    """
    failed = F.col("event_action") == failure
    bucket = F.floor(F.unix_seconds("timestamp") / window_seconds)
    timed = events.where(F.col("event_action").isin(failure, success) & F.col("timestamp").isNotNull())
    used = timed.select("event_id", "user", "src_ip", "timestamp", failed.alias("failed"), F.explode(F.when(failed, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))).alias("bucket"))
    group = Window.partitionBy("user", "src_ip", "bucket")
    by_time = group.orderBy(micros(F.col("timestamp")))
    counted = used.withColumns({"failures": F.count_if("failed").over(by_time.rangeBetween(-window_seconds * 1_000_000, 0)), "until": F.count_if("failed").over(by_time.rangeBetween(Window.unboundedPreceding, 0))})
    hits = counted.where(~F.col("failed") & (F.col("failures") >= least)).drop("failed")
    wanted = hits.withColumn("number", F.explode(F.sequence(F.col("until") - F.least(F.col("failures"), F.lit(last)) + 1, F.col("until"))))
    number = F.row_number().over(group.orderBy("timestamp", "event_id")).cast("long")
    fails = used.where("failed").select(F.col("user").alias("u"), F.col("src_ip").alias("s"), F.col("bucket").alias("k"), number.alias("n"), F.col("event_id").alias("failure_id"))
    met = wanted.join(fails, F.col("user").eqNullSafe(F.col("u")) & F.col("src_ip").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")) & (F.col("number") == F.col("n")))
    return met.groupBy("event_id", "user", "src_ip", "timestamp", "failures").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "failure_id"))), lambda s: s["failure_id"]).alias("failure_ids"))


def policy_findings(events: DataFrame, policies: tuple[str, ...] = FINDING_POLICIES, medium: tuple[str, ...] = MEDIUM_POLICIES) -> DataFrame:
    """One finding for each policy that an action or a detection names.

    The count takes both, so an event can count twice; its id is listed once. Evidence of state
    alone makes the severity medium and the confidence low. Events without an id count each.
    """
    none = F.array().cast("array<string>")
    names = F.filter(F.concat(F.array("event_action"), F.coalesce("detection_names", none)), lambda n: n.isin(*policies))
    used = events.select("event_id", "timestamp", "evidence_role", "confidence", names.alias("names")).where(F.size("names") > 0)
    each = used.withColumn("policy", F.explode(F.array_distinct("names"))).withColumn("n", F.size(F.filter("names", lambda x: x == F.col("policy"))))
    totals = each.groupBy("policy").agg(F.sum("n").alias("hits"), F.bool_and(~F.col("evidence_role").eqNullSafe(F.lit("behavior"))).alias("state_only"), F.bool_and(F.col("confidence").eqNullSafe(F.lit("high"))).alias("sure"), F.collect_set("evidence_role").alias("roles"))
    ids = first_ids(each, ["policy"], [F.col("timestamp").asc_nulls_last(), F.col("event_id")], 10)
    text = F.concat(F.lit("Observed "), F.col("hits").cast("string"), F.when(F.col("state_only"), " state or inferred").otherwise(""), F.lit(" event(s) matching "), F.col("policy"), F.when(F.col("state_only"), "; this shows no execution or action of an attacker without corroboration.").otherwise("."))
    return totals.join(ids, "policy").select(
        F.initcap(F.translate("policy", "_", " ")).alias("title"),
        F.when(F.col("state_only") | F.col("policy").isin(*medium), "medium").otherwise("high").alias("severity"),
        F.when(F.col("state_only"), "low").when(F.col("sure"), "high").otherwise("medium").alias("confidence"),
        F.col("hits"),
        "event_ids",
        F.when(F.col("state_only"), F.array(F.col("policy"), F.lit("contextual_evidence"), F.lit("requires_corroboration"))).otherwise(F.array("policy")).alias("tags"),
        F.array_sort("roles").alias("evidence_roles"),
        text.alias("summary"),
    )


def bruteforce_campaigns(events: DataFrame, least: int = 20, failures: tuple[str, ...] = ("ssh_login_failure",)) -> DataFrame:
    """Addresses (none is one of them) with ``least`` failures or more: users, first and last time, first ten users, first five ids."""
    used = events.where(F.col("event_action").isin(*failures))
    per_user = used.groupBy("src_ip", "user").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    totals = per_user.groupBy("src_ip").agg(F.sum("n").alias("failures"), F.count(F.nullif("user", F.lit(""))).alias("users"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen")).where(F.col("failures") >= least)
    names = first_ids(per_user.where("user <> ''"), ["src_ip"], [F.col("user")], 10, "user", "first_users").withColumnRenamed("src_ip", "s")
    ids = first_ids(used, ["src_ip"], [F.col("timestamp").asc_nulls_last(), F.col("event_id")], 5).withColumnRenamed("src_ip", "i")
    same = lambda c: F.col("src_ip").eqNullSafe(F.col(c))
    return totals.join(names, same("s"), "left").join(ids, same("i"), "left").drop("s", "i")


def account_changes(events: DataFrame) -> DataFrame:
    """Account events with the kind of change, if any."""
    # Actions of accounts, and those of each kind.
    logged = ("user_created", "user_deleted", "user_modified", "password_changed", "account_unlocked", "account_locked")
    kinds = {
        "created": ("account_created_since_backup", "user_created", "password_set_new_account"),
        "deleted": ("account_deleted_since_backup", "user_deleted"),
        "password": ("password_changed", "account_unlocked"),
        "group": ("group_member_added", "group_member_removed"),
    }
    kind = None
    for name, actions in kinds.items():
        test = F.col("event_action").isin(*actions)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return events.where((F.col("source_type") == "account_diff") | F.col("event_action").isin(*logged)).select("event_id", "timestamp", F.nullif("user", F.lit("")).alias("user"), kind.alias("kind"))


def account_lifecycle(events: DataFrame) -> DataFrame:
    """Distinct users, their names and events for each kind of change of accounts; an empty user is no user."""
    each = account_changes(events).where("kind is not null").groupBy("kind", "user").agg(F.count("*").alias("n"))
    return each.groupBy("kind").agg(F.count("user").alias("users"), F.sum("n").alias("events"), F.array_sort(F.collect_list("user")).alias("names"))


def account_finding(events: DataFrame) -> DataFrame:
    """One finding on changes of accounts, if there are any: each kind with its users, and the first 15 ids of all account events."""
    changes = account_changes(events)
    kinds = account_lifecycle(events).select("kind", "users", "events", F.array_join("names", ", ").alias("names"))
    c = F.col
    # Texts of the finding, in the order of kinds.
    named = lambda what: text(c("users"), f" unique account(s) {what} (", c("names"), ") across ", c("events"), " supporting event(s)")
    part = (
        F.when(c("kind") == "created", F.when(c("users") > 0, named("observed as created")).otherwise(text(c("events"), " account-creation event(s) without a parsed username")))
        .when(c("kind") == "deleted", F.when(c("users") > 0, named("observed as deleted")).otherwise(text(c("events"), " account-deletion event(s) without a parsed username")))
        .when(c("kind") == "password", F.when(c("users") > 0, named("with password changes or unlocks")).otherwise(text(c("events"), " password-change or unlock event(s) without a parsed username")))
        .otherwise(text(c("events"), " group membership change(s)"))
    )
    place = F.array_position(F.array(*map(F.lit, ("created", "deleted", "password", "group"))), c("kind"))
    parts = kinds.agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), part.alias("part")))).alias("parts")).where(F.size("parts") > 0)
    ids = changes.orderBy(c("timestamp").asc_nulls_last(), "event_id").limit(15).agg(F.transform(F.array_sort(F.collect_list(F.struct(c("timestamp").isNull().alias("undated"), "timestamp", "event_id"))), lambda s: s["event_id"]).alias("event_ids"))
    summary = text("Account changes detected via backup file diffing and log analysis: ", F.array_join(F.transform("parts", lambda p: p["part"]), "; "), ".")
    return parts.crossJoin(ids).select(F.lit("Account Lifecycle Changes Detected").alias("title"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"), "event_ids", summary.alias("summary"), F.array(F.lit("account_lifecycle"), F.lit("account_diff")).alias("tags"))


def indexed(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id"), weight: Column | None = None) -> DataFrame:
    """Add ``position``, the place in order of time or the sum of ``weight`` until there, without a sort in one task: by sorted ranges, written once."""
    if weight is None:
        return positions(ordered_ranges(events, order)).drop("part", "place")
    own = ordered_ranges(events.withColumn("weight", weight.cast("long")), order)
    return positions(own, "weight").drop("part", "place", "weight")


def initial_access_storylines(events: DataFrame, frame: int = 25, anchors: tuple[str, ...] = ("ssh_login_success", "http_request"), download: str = "download_execute_chain", cron: str = "cron_modified", chmod: str = "chmod_executable", miner: str = "miner_execution") -> DataFrame:
    """Logins or requests that a chain of execution follows within the next ``frame`` dated events, with the first 15 ids of medium severity or more among them.

    What a frame needs is sorted by range of time and written once. Each range gets the ``frame - 1``
    rows after it, so one window a range answers all frames, and ranges grow with the timeline.
    """
    names = F.concat(F.array("event_action"), F.coalesce("detection_names", F.array().cast("array<string>")))
    wanted = sorted((download, cron, chmod, miner))
    signals = [flag(F.array_contains(names, s)).alias(f"s{k}") for k, s in enumerate(wanted)]
    # Texts of the storyline.
    title, summary = "Initial access followed by suspicious execution or persistence", "A login or web request is followed by high-signal Linux attack behaviors."
    narrow = events.where("timestamp is not null").select("event_id", "timestamp", flag(F.col("event_action").isin(*anchors)).alias("anchor"), flag(severity_rank(F.col("severity")) >= 2).alias("grave"), *signals)
    rows = with_halo(ordered_ranges(narrow, ("timestamp", "event_id")), frame - 1)
    near = next_rows(frame)
    seen = rows.select(
        "event_id", F.col("timestamp").alias("start"), "anchor", "halo", F.last("timestamp").over(near).alias("end"), F.collect_list(F.when(F.col("grave"), F.col("event_id"))).over(near).alias("ids"), *(F.max(f"s{k}").over(near).alias(f"s{k}") for k in range(len(wanted)))
    )
    has = {s: F.col(f"s{k}") for k, s in enumerate(wanted)}
    kept = seen.where(F.col("anchor") & ~F.col("halo") & (has[download] | has[cron] | (has[chmod] & has[miner])))
    found = F.array_compact(F.array(*(F.when(has[s], F.lit(s)) for s in wanted)))
    return kept.select("event_id", F.lit(title).alias("title"), "start", "end", F.lit("medium").alias("confidence"), found.alias("signals"), F.slice("ids", 1, 15).alias("event_ids"), F.lit(summary).alias("summary"))


# Actions of note after a login.
FOLLOWING = ("sudo_command", "shell_command", "password_changed", "user_created", "user_modified", "account_unlocked")


def bruteforce_storylines(events: DataFrame, least: int = 10, prior: int = 5, follow: tuple[str, ...] = FOLLOWING) -> DataFrame:
    """Per address (none is one of them) with ``least`` failures: its first success with ``prior`` of them until then.

    A line goes from the address's first failure to the last event of the story: the three failures
    before the success, the success, and the first ten events of ``follow`` by anyone from then on.
    The time of an address's ``prior``-th failure decides which success counts, so no window holds
    all events of an address.
    """
    failed, won = F.col("event_action") == "ssh_login_failure", F.col("event_action") == "ssh_login_success"
    timed = events.where(F.col("timestamp").isNotNull()).withColumn("address", F.coalesce("src_ip", F.lit("\x00")))
    fails = timed.where(failed).select("address", F.col("event_id").alias("failure_id"), F.col("timestamp").alias("failed_at"))
    totals = fails.groupBy("address").agg(F.count("*").alias("all_failures"), F.min("failed_at").alias("start")).where(F.col("all_failures") >= least)
    enough = first_n(fails, ["address"], [F.col("failed_at"), F.col("failure_id")], prior).where(F.col("place") == prior).select("address", F.col("failed_at").alias("enough_at"))
    wins = timed.where(won).select("address", "event_id", "src_ip", "user", "timestamp")
    first = wins.join(enough, "address").where("timestamp >= enough_at").groupBy("address").agg(F.min_by(F.struct("event_id", "src_ip", "user", "timestamp"), F.struct("timestamp", "event_id")).alias("s"))
    anchors = first.select("address", "s.*").join(totals, "address")
    near = anchors.join(fails, "address").where("failed_at <= timestamp")
    counts = near.groupBy("address").agg(F.count("*").alias("failures_before"))
    three = first_ids(near, ["address"], [F.desc("failed_at"), F.desc("failure_id")], 3, "failure_id", "failure_ids")
    after = following_events(events, anchors.select("event_id", F.col("timestamp").alias("start")), follow, 10)
    story = anchors.join(counts, "address").join(three, "address").join(after, "event_id", "left")
    none = F.array().cast("array<string>")
    address, name = F.coalesce("src_ip", F.lit("an unknown address")), F.coalesce("user", F.lit("an unknown user"))
    # Texts of the storyline.
    title = text("Brute-force from ", address, " followed by successful login as ", name)
    followed = F.size(F.coalesce("next_ids", none))
    summary = text(F.col("failures_before"), " failed attempts from ", address, " preceded a successful ", name, " login. ", followed, " post-access events followed.")
    return story.select(
        "src_ip", "event_id", "user", title.alias("title"), "start", F.greatest("timestamp", "last_at").alias("end"), F.lit("high").alias("confidence"), "failures_before", "all_failures", F.array_sort("failure_ids").alias("failure_ids"), F.coalesce("next_ids", none).alias("next_ids"),
        F.slice(F.concat(F.reverse("failure_ids"), F.array("event_id"), F.coalesce("next_ids", none)), 1, 15).alias("event_ids"), summary.alias("summary"),
    )


def following_events(events: DataFrame, anchors: DataFrame, follow: tuple[str, ...] = FOLLOWING, n: int = 10) -> DataFrame:
    """The first ``n`` events of the actions ``follow`` from each anchor on (``event_id``, ``start``), however much later, and the time of the last of them.

    Marks and anchors are put in one order of time; a mark's number is the count of marks until it,
    and an anchor asks for the ``n`` numbers after its own count: an equi-join, without a horizon.
    """
    marks = events.where(F.col("event_action").isin(*follow) & F.col("timestamp").isNotNull()).select("event_id", "timestamp", F.lit(1).alias("mark"))
    both = marks.unionByName(anchors.select("event_id", F.col("start").alias("timestamp"), F.lit(0).alias("mark")))
    counted = indexed(both, ("timestamp", "mark", "event_id"), F.col("mark"))
    asked = counted.where("mark = 0").select("event_id", F.explode(F.sequence(F.col("position") + 1, F.col("position") + n)).alias("number"))
    numbered = counted.where("mark = 1").select(F.col("position").alias("number"), F.col("event_id").alias("next_id"), F.col("timestamp").alias("next_at"))
    met = asked.join(numbered, "number").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("number", "next_id"))).alias("found"), F.max("next_at").alias("last_at"))
    return met.select("event_id", F.transform("found", lambda s: s["next_id"]).alias("next_ids"), "last_at")


def credential_storyline(events: DataFrame, actions: tuple[str, ...] = ("password_changed", "account_unlocked", "password_set_new_account"), detection: str = "root_password_changed") -> DataFrame:
    """One row over all dated changes of credentials, if there are any: first, last, the users, the first 15 ids. An empty user is no user.

    The summary names all users, as the row is meant to; they are made distinct in partial groups first.
    """
    used = events.where((F.col("event_action").isin(*actions) | F.array_contains("detection_names", detection)) & F.col("timestamp").isNotNull())
    top = used.orderBy("timestamp", "event_id").limit(15).agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "event_id"))), lambda s: s["event_id"]).alias("event_ids"))
    each = used.groupBy(F.nullif("user", F.lit("")).alias("user")).agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    totals = each.agg(F.sum("n").alias("events"), F.min("a").alias("start"), F.max("z").alias("end"), F.count("user").alias("users"), F.array_sort(F.collect_list("user")).alias("names")).where("events > 0")
    # Texts of the storyline.
    summary = text(F.col("events"), " credential change(s) detected for user(s): ", F.array_join("names", ", "), ". Review whether these changes were authorized.")
    return totals.crossJoin(top).select(F.lit("Credential modification activity").alias("title"), "start", "end", F.lit("medium").alias("confidence"), "events", "users", "event_ids", summary.alias("summary"))


def lag_gap(events: DataFrame, keys: tuple[str, ...] = ("user",)) -> DataFrame:
    """Seconds since the event before of the same keys."""
    order = Window.partitionBy(*keys).orderBy("timestamp", "event_id")
    before = F.lag("timestamp").over(order)
    return events.where("timestamp is not null").select("event_id", *keys, "timestamp", (F.unix_seconds("timestamp") - F.unix_seconds(before)).alias("gap_seconds"))


def actor_similarity(events: DataFrame, profiles: dict[str, dict]) -> DataFrame:
    """Profiles of a rule pack that the events are like; likeness, not attribution.

    Signals are tags, detections, flags, the action, and detections and flags as ``ttp.*``, of events
    with an id. Rules have ``strong_indicators``, ``supporting_indicators``,
    ``required_any_indicators``, ``required_evidence_count`` (2), ``minimum_strong_indicators`` (2),
    ``minimum_supporting_indicators`` (1), ``minimum_event_count`` (2), ``confidence_cap`` (low) and
    ``display_name``. A pack is of bounded size and broadcast.
    """
    spark = events.sparkSession
    # Minimums of a profile that names none.
    minimum = {"required_evidence_count": 2, "minimum_strong_indicators": 2, "minimum_supporting_indicators": 1, "minimum_event_count": 2}
    rows = [(p, i, kind) for p, r in profiles.items() for kind, field in enumerate(("strong_indicators", "supporting_indicators", "required_any_indicators")) for i in r.get(field, [])]
    indicators = spark.createDataFrame(rows, "profile_id string, signal string, kind int")
    heads = spark.createDataFrame([(p, r.get("display_name", p), r.get("confidence_cap", "low"), bool(r.get("required_any_indicators")), *(int(r.get(k, v)) for k, v in minimum.items())) for p, r in profiles.items()], "profile_id string, title string, cap string, some_required boolean, n_all int, n_strong int, n_supporting int, n_events int")
    none = F.array().cast("array<string>")
    named = sorted_set(F.col("detection_names"), F.col("ttp_flags"))
    signals = sorted_set(F.col("tags"), named, F.array("event_action"), F.transform(named, lambda n: F.concat(F.lit("ttp."), n)))
    met = events.where("event_id <> ''").select("event_id", "timestamp", F.explode(signals).alias("signal")).join(F.broadcast(indicators), "signal")
    seen = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("signal"))))
    found = met.groupBy("profile_id").agg(seen(0).alias("matched_strong"), seen(1).alias("matched_supporting"), F.count_if(F.col("kind") == 2).alias("required_seen"))
    listed = met.where("kind < 2").groupBy("profile_id", "event_id").agg(F.min(F.struct("kind", "signal", "timestamp")).alias("place"))
    counts = listed.groupBy("profile_id").agg(F.count("*").alias("events"))
    ids = first_ids(listed, ["profile_id"], [F.col("place"), F.col("event_id")], 15)
    out = found.join(F.broadcast(heads), "profile_id").join(counts, "profile_id").join(ids, "profile_id")
    enough = (F.size("matched_strong") >= F.col("n_strong")) & (F.size("matched_supporting") >= F.col("n_supporting")) & (F.size(F.array_union("matched_strong", "matched_supporting")) >= F.col("n_all")) & (F.col("events") >= F.col("n_events")) & (~F.col("some_required") | (F.col("required_seen") > 0))
    tags = F.concat(F.array(F.lit("actor_relevant_ttp"), F.lit("not_attribution"), F.concat(F.lit("actor_similarity."), "profile_id")), "matched_strong", "matched_supporting")
    return out.where(enough).select("profile_id", "title", F.lit("medium").alias("severity"), F.col("cap").alias("confidence"), "matched_strong", "matched_supporting", "events", F.coalesce("event_ids", none).alias("event_ids"), tags.alias("tags"))


def high_signal(events: DataFrame) -> DataFrame:
    return events.where(severity_rank(F.col("severity")) >= 3)


# Evidence of movement to other hosts, and the sources that would show it.
OUTBOUND = ("outbound_ssh_command", "outbound_file_transfer_command", "outbound_ssh_connection")
MOVEMENT_SOURCES = {"command history": ("shell_history",), "network state": ("ss_output", "netstat_output", "network_state"), "SSH host history": ("known_hosts",)}


def lateral_movement_findings(events: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One finding with counts, destinations and the first 15 ids if there is evidence; else known hosts as context, and whether the sources would have shown any.

    Sources are those given (``source_type``), or those of the events. Ids go by kind of evidence, then time.
    """
    c, none = F.col, F.array().cast("array<string>")
    known = len(OUTBOUND)
    tests = [*(F.array_contains("detection_names", d) for d in OUTBOUND), c("event_action") == "known_host_observed"]
    each = events.select("event_id", "timestamp", "dst_ip", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in enumerate(tests))))).alias("kind"))
    counts = each.groupBy("kind").agg(F.count("*").alias("n"))
    firsts = first_ids(each, ["kind"], [c("timestamp").asc_nulls_last(), c("event_id")], 15)
    kinds = counts.join(firsts, "kind").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "event_ids")))).alias("kinds"))
    reached = each.where((c("kind") < known) & (c("dst_ip") != "")).groupBy("dst_ip").agg(F.lit(1).alias("one")).orderBy("dst_ip").limit(10)
    reached = reached.agg(F.array_join(F.array_sort(F.collect_list("dst_ip")), ", ").alias("reached"))
    types = (events if sources is None else sources).agg(F.collect_set("source_type").alias("types"))
    missing = F.array_compact(F.array(*(F.when(~F.arrays_overlap("types", F.array(*map(F.lit, t)).cast("array<string>")), F.lit(g)) for g, t in MOVEMENT_SOURCES.items())))
    df = kinds.crossJoin(reached).crossJoin(types).withColumn("missing", F.array_sort(missing))
    n = [F.coalesce(F.try_element_at("kinds", F.lit(k))["n"], F.lit(0)) for k in range(known + 1)]
    ids = [F.coalesce(F.try_element_at("kinds", F.lit(k))["event_ids"], none) for k in range(known + 1)]
    df = df.withColumns({"n": n[0] + n[1] + n[2], "hosts": n[known]})
    row = lambda title, severity, sure, count, gaps, own, summary, *tags: F.struct(F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), count.alias("indicators"), F.array_join(gaps, ",").alias("missing"), own.alias("event_ids"), summary.alias("summary"), F.array(*map(F.lit, tags)).alias("tags"))
    zero = F.lit(0).cast("long")
    # Texts and tags of the findings.
    where = F.when(c("reached") != "", c("reached")).otherwise("see events")
    found = row("Outbound Lateral Movement Evidence", "high", "medium", c("n"), none, F.slice(F.concat(*ids[:known]), 1, 15), text("Found ", c("n"), " action indicator(s) of outbound lateral movement: ", n[0], " SSH commands, ", n[1], " file transfers, and ", n[2], " active SSH connections. Destinations: ", where), "lateral_movement", "outbound")
    context = row("Known SSH Destination Observed", "low", "low", c("hosts"), none, ids[known], text("Observed ", c("hosts"), " SSH known-host entr", F.when(c("hosts") == 1, "y").otherwise("ies"), ". This is historical destination context and does not establish an outbound connection or lateral movement."), "ssh", "known_hosts", "contextual_evidence", "not_lateral_movement_by_itself")
    gaps = row("Lateral Movement Assessment Has Coverage Gaps", "informational", "low", zero, c("missing"), none, text("No outbound lateral-movement evidence was observed in the available sources, but coverage is incomplete. Missing: ", F.array_join("missing", ", "), "."), "lateral_movement", "coverage_gap", "inconclusive_finding")
    absent = "No evidence of outbound lateral movement was observed in the available command history, No outbound SSH commands in shell history, no SSH connections in network state, and no scp/rsync file transfers were detected. Known-host entries, when present, are reported separately as historical context."
    negative = row("No Outbound Lateral Movement Evidence Observed", "informational", "medium", zero, none, none, F.lit(absent), "lateral_movement", "negative_finding", "coverage_sufficient")
    other = F.array_compact(F.array(F.when(c("hosts") > 0, context), F.when(F.size("missing") > 0, gaps).otherwise(negative)))
    return df.select(F.explode(F.when(c("n") > 0, F.array(found)).otherwise(other)).alias("f")).select("f.*")


def derive_findings(events: DataFrame, profiles: dict[str, dict] | None = None, sources: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """All findings as one table: ``title``, ``severity``, ``confidence``, ``event_ids``, ``summary``, ``tags``."""
    tags = lambda *names: F.array(*map(F.lit, names)).alias("tags")
    row = lambda title, severity, sure, ids, summary, own: [title.alias("title"), F.lit(severity).alias("severity") if isinstance(severity, str) else severity, F.lit(sure).alias("confidence") if isinstance(sure, str) else sure, ids.alias("event_ids"), summary.alias("summary"), own]
    c = F.col
    columns = ("title", "severity", "confidence", "event_ids", "summary", "tags")
    # Texts of the findings.
    more = F.when(c("users") > 10, text(" and ", c("users") - 10, " more")).otherwise("")
    campaign = text(c("failures"), " failed SSH attempts from ", c("src_ip"), " targeting ", c("users"), " user(s) between ", F.coalesce(iso(c("first_seen")), F.lit("")), " and ", F.coalesce(iso(c("last_seen")), F.lit("")), ". Targeted users include: ", F.coalesce(F.array_join("first_users", ", "), F.lit("")), more)
    frames = [
        success_after_failures(events).select(*row(text("Successful SSH login after repeated failures"), "high", "medium", F.concat(F.array("event_id"), "failure_ids"), text(c("user"), " logged in from ", c("src_ip"), " after ", c("failures"), " failed attempts within 30 minutes."), tags("ssh_bruteforce", "valid_account"))),
        policy_findings(events).select(*columns),
        bruteforce_campaigns(events).select(*row(text("SSH Brute-Force Campaign from ", c("src_ip")), "high", "high", c("event_ids"), campaign, tags("bruteforce_campaign", "ssh"))),
        lateral_movement_findings(events, sources).select(*columns),
        account_finding(events).select(*columns),
    ]
    if profiles:
        frames.append(actor_similarity(events, profiles).select(*row(c("title"), c("severity"), c("confidence"), c("event_ids"), text("Activity overlaps with this profile in ", c("events"), " events. This is not attribution."), c("tags"))))
    if hits is not None:
        frames.append(ioc_finding(hits).select("title", "severity", "confidence", "event_ids", "summary", "tags"))
    return reduce(DataFrame.unionByName, frames)
