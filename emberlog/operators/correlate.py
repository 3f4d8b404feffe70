"""Joins between timelines, state, indicators, snapshots and inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.patterns import finder
from emberlog.functions.text import has_token, sorted_set
from emberlog.operators.timeline import first_ids

# Kinds of time, the best first; types of state whose time may be found.
TIME_ORDER = ("mtime", "ctime", "birthtime", "log_time", "atime")
STATE_TYPES = ("authorized_keys", "cron_file", "ld_preload", "pam_config", "profile", "rc_local", "shell_profile", "sshd_config", "sudoers", "systemd_unit")
DATED_TYPES = ("bodyfile", "auditd")


def normalise_path(path: Column) -> Column:
    """Trimmed, a leading ``./`` as ``/``, well-known folders rooted, double slashes made single once; null for nothing."""
    bare = F.regexp_replace(F.trim(path), r"^\./", "/")
    rooted = F.when(bare.rlike("^(root|etc|home|var)/"), F.concat(F.lit("/"), bare)).otherwise(bare)
    return F.nullif(F.replace(rooted, F.lit("//"), F.lit("/")), F.lit(""))


def correlate_state_times(events: DataFrame, state_types: tuple[str, ...] = STATE_TYPES, order: tuple[str, ...] = TIME_ORDER, related: Callable[[Column], Column] = lambda ids: ids, most: int = 10**9) -> DataFrame:
    """Give undated state the best time that file or audit events have for its path: by kind, then the earliest.

    Equi-joins on paths: they are normalised for each distinct pair that state names, and for dated events.
    Of these, only those of a wanted path are grouped, by path first, so a path that many events share sends
    one row: the best time, and all ids, which become the related ids. Ids are put together once for each
    distinct set of paths that are found, in the form that ``related`` gives them (text, for one), and meet
    the state in the last join: no shuffle repeats them for each row, and a row copies them and no more.
    That join writes rows times ids: state of one set is dealt into parts of about ``most`` ids, and into
    all shuffle partitions, since its bytes do not tell its work. Whole rows move for undated state alone;
    all other events pass by.
    """
    events = events.withColumn("related_event_ids", related(F.col("related_event_ids")))
    state = F.coalesce(F.col("timestamp").isNull() & F.col("source_type").isin(*state_types), F.lit(False))
    kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("timestamp_type")).cast("int"), F.lit(0)), F.lit(99))
    rooted = lambda c: F.when(~F.col(c).startswith("/"), F.concat(F.lit("/"), c))
    paths = F.array_sort(F.array_distinct(F.array_compact(F.array(*(normalise_path(p) for c in ("named_file", "named_source") for p in (F.col(c), rooted(c)))))))
    own = events.where(state)
    named = own.select("collection_id", F.col("file_path").alias("named_file"), F.col("source_path").alias("named_source")).groupBy("collection_id", "named_file", "named_source").agg(F.count("*").alias("rows"))
    # With the outer form, Spark does not ask each row before the grouping whether it has paths.
    wanted = named.withColumn("wanted_paths", paths).withColumn("path", F.explode_outer("wanted_paths"))
    dated = events.where(F.col("timestamp").isNotNull() & F.col("source_type").isin(*DATED_TYPES)).withColumns({"path": normalise_path(F.col("file_path")), "kind": kind})
    dated = dated.where("path is not null").join(wanted.select("collection_id", "path").distinct(), ["collection_id", "path"], "left_semi")
    best = F.min(F.struct("kind", "timestamp", F.col("event_id").alias("found_id"), "timestamp_type", "timestamp_raw", "timestamp_precision", "timezone"))
    by_path = dated.groupBy("collection_id", "path").agg(best.alias("b"), F.count("*").alias("n"))
    lists = dated.groupBy("collection_id", "path").agg(F.collect_set("event_id").alias("ids"))
    met = wanted.join(by_path, ["collection_id", "path"]).groupBy("collection_id", "named_file", "named_source", "wanted_paths", "rows").agg(F.min("b").alias("b"), F.sum("n").alias("n"), F.array_sort(F.collect_set("path")).alias("found_in"))
    parts = F.least(F.ceil(F.sum("rows") * F.max("n").cast("double") / most), F.lit(1024))
    sets = met.groupBy("collection_id", "found_in").agg(parts.alias("parts"))
    note = F.to_json(F.struct(F.lit("bodyfile_or_audit_path_match").alias("method"), F.col("wanted_paths").alias("matched_paths"), F.col("n").alias("source_event_count"), F.col("b.timestamp_type").alias("source_timestamp_type")))
    met = met.join(sets, ["collection_id", "found_in"]).select(F.col("collection_id").alias("named_collection"), "named_file", "named_source", "b", "found_in", "parts", note.alias("note"))
    gathered = sets.withColumn("path", F.explode("found_in")).join(lists, ["collection_id", "path"]).groupBy("collection_id", "found_in", "parts").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    found = gathered.select("collection_id", "found_in", "parts", related(F.col("ids")).alias("found_ids")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    same = (F.col("collection_id") == F.col("named_collection")) & F.col("file_path").eqNullSafe(F.col("named_file")) & F.col("source_path").eqNullSafe(F.col("named_source"))
    # State without a match has no set of paths, and is dealt as well.
    part = F.pmod(F.xxhash64("event_id"), F.coalesce("parts", F.lit(1024).cast("long")))
    keys = ["collection_id", "found_in", "part"]
    dealt = own.join(met, same, "left").withColumn("part", part).repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    joined = dealt.join(found, keys, "left")
    hit = F.col("b").isNotNull()
    new = {
        "timestamp": F.col("b.timestamp"),
        "timestamp_raw": F.col("b.timestamp_raw"),
        "timestamp_type": F.concat(F.lit("correlated_"), F.col("b.timestamp_type")),
        "timestamp_precision": F.col("b.timestamp_precision"),
        "timestamp_confidence": F.lit("low"),
        "evidence_role": F.lit("inference"),
        "timezone": F.col("b.timezone"),
        "timezone_confidence": F.lit("correlated"),
        "time_start": F.col("b.timestamp"),
        "time_end": F.coalesce("time_end", "b.timestamp"),
        "confidence": F.when(F.col("confidence") == "high", "medium").otherwise(F.col("confidence")),
        "tags": sorted_set(F.col("tags"), F.array(F.lit("correlated_time"))),
        "detection_names": sorted_set(F.col("detection_names"), F.array(F.lit("state_time_correlated"))),
        "ttp_flags": sorted_set(F.col("ttp_flags"), F.array(F.lit("state_time_correlated"))),
        "related_event_ids": F.col("found_ids"),
        "extra": F.map_concat(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.create_map(F.lit("correlation"), F.col("note"))),
    }
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in events.columns)).unionByName(events.where(~state))


def read_ioc_lines(lines: DataFrame) -> DataFrame:
    """Indicators of ``value[,kind[,label]]`` lines: comments go, a missing kind is guessed, the first of (kind, value) stays. Needs ``line_no`` and ``raw``."""
    part = F.split("raw", ",", 3)
    value = F.trim(F.get(part, 0))
    given = F.lower(F.trim(F.get(part, 1)))
    guess = (
        F.when(value.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!$)|$)){4}$") | (value.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$") & value.rlike(":.*:")), "ip").when(value.rlike(r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), "hash").when(value.rlike(r"[/\\]"), "path").when(value.rlike(r"^[A-Za-z0-9_.-]+(\.[A-Za-z0-9_.-]+)+$"), "domain").otherwise("literal")
    )
    kind = F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(guess)
    rows = lines.where(~F.trim("raw").startswith("#") & (value != "")).select("line_no", value.alias("value"), kind.alias("kind"), F.trim(F.coalesce(F.get(part, 2), F.lit(""))).alias("label"))
    return rows.groupBy("kind", F.lower("value").alias("low")).agg(F.min(F.struct("line_no", "value", "label")).alias("m")).select("m.value", "kind", "m.label")


# Fields in which indicators are looked for.
SEARCHED = ("user", "src_ip", "dst_ip", "process", "command", "file_path", "summary", "raw", "source_path")


def match_iocs(events: DataFrame, iocs: DataFrame, fields: tuple[str, ...] = SEARCHED, most: int = 50_000, most_bytes: int = 8 << 20) -> DataFrame:
    """Events with the indicators they hold.

    Addresses and literals stand alone in the text, in any case; domains, paths and hashes are
    substrings. The list is counted and dealt by hash into shards of about ``most`` indicators and
    ``most_bytes`` of text; each shard becomes an automaton that reads every text once, so the time
    grows with the shards and not with the indicators of one. Only texts go to Python, and an event
    is repeated only for the indicators that it holds.
    """
    spark = events.sparkSession
    text = F.lower(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in fields)))
    trimmed = iocs.withColumn("needle", F.lower(F.trim("value"))).where("needle <> ''")
    alone = F.col("kind").isin("ip", "literal") | ~F.col("kind").isin("domain", "path", "hash")
    listed = trimmed.groupBy("value", "needle", "kind").agg(F.min("label").alias("label")).withColumn("alone", F.coalesce(alone, F.lit(True)))
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("bytes")).first()
    shards, out = max(1, -(-size["n"] // most), -(-size["bytes"] // most_bytes)), None
    base = events.withColumn("searched", text)
    for k in range(shards):
        shard = listed.where(F.pmod(F.xxhash64("value", "kind"), F.lit(shards)) == k).orderBy("value", "kind").collect()
        find = finder(spark, [r["needle"] for r in shard], [r["alone"] for r in shard])
        table = spark.createDataFrame([(i, r["value"], r["kind"], r["label"]) for i, r in enumerate(shard)], "found int, value string, kind string, label string")
        met = base.withColumn("hits", find(F.col("searched"))).select(*events.columns, F.explode("hits").alias("found"))
        own = met.join(F.broadcast(table), "found").select(*events.columns, "value", "kind", "label")
        out = own if out is None else out.unionByName(own)
    return out


def token_hits(text: Column, tokens: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(has_token(text, t), F.lit(t)) for t in tokens)))


def ioc_finding(hits: DataFrame) -> DataFrame:
    """One finding if there are hits (``event_id``, ``value``): how many, the first fifty indicators, the first ten distinct ids."""
    totals = hits.agg(F.count("*").alias("hits"), F.count_distinct("value").alias("iocs"), F.count_distinct("event_id").alias("events")).where("hits > 0")
    each = hits.where("event_id <> ''").groupBy("event_id").agg(F.lit(1).alias("one"))
    ids = first_ids(each, ["one"], [F.col("event_id")], 10).drop("one")
    values = hits.groupBy("value").agg(F.lit(1).alias("one")).orderBy("value").limit(50).agg(F.array_sort(F.collect_list("value")).alias("ioc_values"))
    summary = F.concat(F.lit("Observed "), F.col("hits").cast("string"), F.lit(" event(s) matching "), F.col("iocs").cast("string"), F.lit(" supplied IoC(s)."))
    return totals.join(ids, F.lit(True), "left").crossJoin(values).select(F.lit("Known IoC Match").alias("title"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"), "hits", "iocs", "events", "event_ids", "ioc_values", summary.alias("summary"), F.array(F.lit("known_ioc_match")).alias("tags"))


def diff_snapshots(current: DataFrame, backup: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, ``change``, ``changed_fields``) for created, deleted and modified rows of two snapshots; one full outer join."""
    a = current.select(F.col(key), F.lit(True).alias("in_a"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = backup.select(F.col(key), F.lit(True).alias("in_b"), *(F.col(f).alias(f"b_{f}") for f in fields))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    both = a.join(b, key, "full")
    change = F.when(F.col("in_b").isNull(), "created").when(F.col("in_a").isNull(), "deleted").when(F.size(changed) > 0, "modified")
    return both.withColumn("change", change).where("change is not null").select(key, "change", F.when(F.col("change") == "modified", changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


# Groups that give privileges.
PRIVILEGED_GROUPS = ("root", "sudo", "wheel", "admin", "adm", "docker", "lxd", "shadow", "disk")


def diff_groups(current: DataFrame, backup: DataFrame, privileged: tuple[str, ...] = PRIVILEGED_GROUPS) -> DataFrame:
    """Members (``group``, ``members``) added to and removed from groups, and groups made and deleted."""
    a = current.select("group", F.col("members").alias("now"), F.lit(True).alias("in_a"))
    b = backup.select("group", F.col("members").alias("then"), F.lit(True).alias("in_b"))
    none = F.array().cast("array<string>")
    both = a.join(b, "group", "full").withColumns({"now": F.coalesce("now", none), "then": F.coalesce("then", none)})
    whole = both.where("in_a is null or in_b is null").select("group", F.when(F.col("in_b").isNull(), "group_created").otherwise("group_deleted").alias("change"), F.lit(None).cast("string").alias("member"))
    moved = lambda x, y, name: both.where("in_a and in_b").select("group", F.lit(name).alias("change"), F.explode(F.array_except(x, y)).alias("member"))
    all_ = whole.unionAll(moved("now", "then", "member_added")).unionAll(moved("then", "now", "member_removed"))
    return all_.withColumn("severity", F.when(F.col("group").isin(*privileged) & (F.col("change") == "member_added"), "high").otherwise("medium"))


def diff_shadow(current: DataFrame, backup: DataFrame) -> DataFrame:
    """Changes of password entries (``user``, ``hash``), without the hashes: new, locked, unlocked, changed."""
    locked = lambda c: c.isNull() | (c == "") | c.startswith("!") | c.startswith("*")
    both = current.select("user", F.col("hash").alias("now")).join(backup.select("user", F.col("hash").alias("then"), F.lit(True).alias("old")), "user", "left")
    change = (
        F.when(F.col("old").isNull(), "account_password_created")
        .when(locked(F.col("then")) & ~locked(F.col("now")), "account_unlocked_since_backup")
        .when(~locked(F.col("then")) & locked(F.col("now")), "account_locked_since_backup")
        .when(~F.col("now").eqNullSafe(F.col("then")), F.when(F.col("user") == "root", "root_password_changed").otherwise("password_changed_since_backup"))
    )
    return both.withColumn("change", change).where("change is not null").select("user", "change", F.lit("[masked]").alias("raw"))


def diff_inventory(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Files (``relative``, ``size``, ``sha256``) that are changed, missing or new."""
    out = diff_snapshots(observed, expected, "relative", ("size", "sha256"))
    names = F.create_map(*map(F.lit, ("created", "new", "deleted", "missing", "modified", "changed")))
    return out.select("relative", names[F.col("change")].alias("status"))


def verify_inventory(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: ``status``, whether the inventory is ``verified``, and the numbers of changed, missing and new files."""
    counts = diff_inventory(expected, observed).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("changed", "missing", "new")))
    same = F.col("changed") + F.col("missing") + F.col("new") == 0
    return counts.select(F.when(same, "verified").otherwise("changed_during_analysis").alias("status"), same.alias("verified"), "changed", "missing", "new")


def sync_coverage(inventory: DataFrame, sources: DataFrame) -> DataFrame:
    """One status a file from its sources: error, then parsed or partially parsed, then unsupported; files without sources keep theirs."""
    rank = F.when(F.col("parser_status") == "error", 3).when(F.col("parser_status") == "parsed", 2).when(F.col("parser_status") == "partially_parsed", 1).otherwise(0)
    rolled = sources.groupBy("relative").agg(F.max_by("parser_status", rank).alias("rolled"), F.max(rank).alias("rank"))
    status = F.when(F.col("rank") >= 1, F.col("rolled")).when(F.col("rank") == 0, "unsupported").otherwise(F.col("coverage_status"))
    return inventory.join(rolled, "relative", "left").withColumn("coverage_status", status).select(*inventory.columns)


def join_annotations(timeline: DataFrame, annotations: DataFrame) -> DataFrame:
    return timeline.join(annotations, "event_id", "left")


def resolve_source_member(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``member_id`` of the evidence file: of the event's path and hash, and for rows derived from several files (``a vs b``) of the first listed one there is."""
    listed = F.split("source_path", " vs ")
    path = lambda p: F.regexp_replace(F.trim(F.substring_index(p, "#", 1)), "^/+", "")
    derived = F.col("source_path").contains(" vs ")
    members = inventory.select("collection_id", F.regexp_replace("relative", "^/+", "").alias("member_path"), F.col("sha256").alias("member_sha"), member_id()).dropDuplicates(["collection_id", "member_path"])
    keyed = events.withColumns({"member_path": path(F.col("source_path")), "derived": F.coalesce(derived, F.lit(False))})
    plain = keyed.where("not derived").join(members, ["collection_id", "member_path"], "left").withColumn("member_id", F.when(F.col("source_sha256") == F.col("member_sha"), F.col("member_id")))
    several = keyed.where("derived")
    places = several.select("event_id", "collection_id", F.posexplode(F.transform(listed, path)).alias("at", "member_path")).join(members, ["collection_id", "member_path"])
    first = places.groupBy("event_id", "collection_id").agg(F.min_by("member_id", "at").alias("member_id"))
    return plain.select(*events.columns, "member_id").unionByName(several.join(first, ["event_id", "collection_id"], "left").select(*events.columns, "member_id"))


def member_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", "collection_id", "relative"), 256), 1, 24).alias("member_id")


def assign_stable_refs(analyses: DataFrame, registry: DataFrame) -> DataFrame:
    """Ids of collections (``fingerprint``, ``name``, ``position``) from a registry (``fingerprint``, ``name``, ``position``, ``ref``).

    A row with the same fingerprint and name comes first, by rank among its like; then what is left
    of a fingerprint, by rank; the rest get a new id made from all they are.
    """
    exact = Window.partitionBy("fingerprint", "name").orderBy("position")
    a = analyses.withColumn("k", F.row_number().over(exact))
    r = registry.withColumn("k", F.row_number().over(exact)).select("fingerprint", "name", "k", "ref", F.col("position").alias("r_position"))
    first = a.join(r, ["fingerprint", "name", "k"], "left")
    used = first.where("ref is not null").select("ref")
    free = Window.partitionBy("fingerprint").orderBy("position")
    open_ = first.where("ref is null").select("fingerprint", "name", "position").withColumn("k", F.row_number().over(free))
    left = registry.join(used, "ref", "left_anti").withColumn("k", F.row_number().over(free)).select("fingerprint", "k", "ref")
    second = open_.join(left, ["fingerprint", "k"], "left")
    made = F.coalesce("ref", F.concat(F.lit("new_"), F.substring(F.sha2(F.concat_ws("|", "fingerprint", "name", "position"), 256), 1, 16)))
    return first.where("ref is not null").select("fingerprint", "name", "position", "ref").unionByName(second.select("fingerprint", "name", "position", made.alias("ref")))
