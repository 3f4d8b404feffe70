"""Review, assistance, exchange tables and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.patterns import finder
from emberlog.functions.text import digest, severity_rank, slug, sorted_set
from emberlog.operators.correlate import resolve_source_member
from emberlog.operators.timeline import first_ids, order_columns

# Columns in which a search looks; dispositions of annotations.
SEARCH_COLUMNS = ("timestamp", "host", "collection_host", "collection_name", "source_path", "source_type", "event_category", "event_action", "user", "src_ip", "dst_ip", "process", "command", "file_path", "summary", "raw", "severity")
SEARCH_ARRAYS = ("attack_phases", "attack_phase_candidates", "tags", "mitre", "detection_names")
DISPOSITIONS = ("unreviewed", "suspicious", "malicious", "benign", "needs_context")


def search_text() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCH_COLUMNS] + [F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",") for c in SEARCH_ARRAYS]
    return F.lower(F.concat_ws(" ", *parts))


def search_timeline(timeline: DataFrame, q: str = "", severity: str | None = None, source_type: str | None = None, phase: str | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Events that meet every filter given; ``q``, cut to 200 characters, is a part of any searched field."""
    df = timeline
    if severity:
        df = df.where(F.lower("severity") == severity.lower())
    if source_type:
        df = df.where(F.col("source_type") == source_type)
    if phase:
        df = df.where(F.array_contains("attack_phases", phase) | F.array_contains("attack_phase_candidates", phase))
    if selected is not None:
        df = df.join(selected.select("event_id"), "event_id", "left_semi")
    needle = q[:200].lower()
    return df.where(F.instr(search_text(), needle) > 0) if needle else df


def timeline_facets(timeline: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """(``facet``, ``value``, ``n``) by severity, source type and confirmed phase, in one pass over the timeline; with annotations also how many events are selected."""
    none = F.array().cast("array<string>")
    df = timeline if annotations is None else timeline.join(annotations.where("include_in_summary").select("event_id", F.lit(True).alias("chosen")), "event_id", "left")
    one = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    pairs = [one("severity", F.coalesce(F.nullif("severity", F.lit("")), F.lit("informational"))), one("source_type", F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown")))]
    if annotations is not None:
        pairs.append(one("summary", F.when(F.col("chosen"), "selected").otherwise("unselected")))
    every = F.concat(F.array(*pairs), F.transform(F.coalesce("attack_phases", none), lambda p: one("attack_phase", p)))
    return df.select(F.explode(every).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def timeline_page(timeline: DataFrame, offset: int = 0, limit: int = 80) -> DataFrame:
    """A page in timeline order, with the ``total`` of rows and whether it ``has_more``; the limit is held within 20 to 200. Spark keeps the first rows of each task only."""
    start, size = max(0, offset), min(200, max(20, limit))
    page = timeline.orderBy(*order_columns(), "event_id").offset(start).limit(size)
    total = timeline.agg(F.count("*").alias("total"))
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > start + size)


def latest_annotations(log: DataFrame) -> DataFrame:
    """The last annotation of each event, made regular; one with nothing in it deletes."""
    clean = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.regexp_replace(F.substring(F.regexp_replace(F.lower(F.trim(t)), r"\s+", "_"), 1, 40), "[^a-z0-9_.-]", "")), lambda t: t != "")), 1, 10)
    last = log.groupBy("event_id").agg(F.max_by(F.struct("tags", "note", "disposition", "include_in_summary", "updated_at"), F.struct("updated_at", F.coalesce("note", F.lit("")))).alias("a")).select("event_id", "a.*")
    df = last.withColumns({"tags": clean, "note": F.substring(F.coalesce("note", F.lit("")), 1, 2000), "disposition": F.when(F.col("disposition").isin(*DISPOSITIONS), F.col("disposition")).otherwise("unreviewed"), "include_in_summary": F.coalesce("include_in_summary", F.lit(False))})
    return df.where((F.size("tags") > 0) | (F.col("note") != "") | (F.col("disposition") != "unreviewed") | F.col("include_in_summary"))


def review_export(timeline: DataFrame, annotations: DataFrame) -> DataFrame:
    """The timeline with analysts' columns, arrays as text."""
    notes = annotations.select("event_id", F.array_join("tags", ",").alias("analyst_tags"), F.col("note").alias("analyst_note"), F.col("disposition").alias("analyst_disposition"), F.col("include_in_summary").alias("analyst_selected"), F.col("updated_at").alias("analyst_updated_at"))
    joined = timeline.join(notes, "event_id", "left")
    return joined.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in joined.dtypes))


def briefing_metrics(timeline: DataFrame, annotations: DataFrame, findings: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """One row of totals: events, dated and selected ones, hosts, confirmed phases, first and last time, findings, hits of indicators."""
    chosen = annotations.where("include_in_summary").select("event_id", F.lit(True).alias("chosen"))
    host = F.coalesce(F.nullif(F.trim("collection_host"), F.lit("")), F.nullif(F.trim("host"), F.lit("")))
    a = timeline.join(chosen, "event_id", "left").agg(F.count("*").alias("events"), F.count("timestamp").alias("timed"), F.count("chosen").alias("selected"), F.count_distinct(host).alias("hosts"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    phases = timeline.select(F.explode("attack_phases").alias("phase")).agg(F.count_distinct("phase").alias("phases"))
    found = findings.agg(F.count("*").alias("findings"), F.count_if(F.lower("severity").isin("high", "critical")).alias("high_findings"))
    met = (timeline.limit(0) if hits is None else hits).agg(F.count("*").alias("ioc_hits"))
    return a.crossJoin(phases).crossJoin(found).crossJoin(met)


def phase_breakdown(timeline: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per phase: confirmed, candidate and selected events, first and last time."""
    chosen = annotations.where("include_in_summary").select("event_id", F.lit(True).alias("chosen"))
    df = timeline.join(chosen, "event_id", "left")
    none = F.array().cast("array<string>")
    tagged = F.concat(F.transform(F.coalesce("attack_phases", none), lambda p: F.struct(p.alias("phase"), F.lit(True).alias("sure"))), F.transform(F.coalesce("attack_phase_candidates", none), lambda p: F.struct(p.alias("phase"), F.lit(False).alias("sure"))))
    each = df.select("timestamp", "chosen", F.explode(tagged).alias("p"))
    return each.groupBy("p.phase").agg(F.count_if("p.sure").alias("confirmed"), F.count_if(~F.col("p.sure")).alias("candidates"), F.count("chosen").alias("selected"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def selected_chronology(timeline: DataFrame, annotations: DataFrame, n: int = 500) -> DataFrame:
    chosen = annotations.where("include_in_summary").select("event_id")
    return timeline.join(chosen, "event_id", "left_semi").orderBy(F.col("timestamp").asc_nulls_last(), "event_id").limit(n)


def executive_rollup(selected: DataFrame, n: int = 5) -> DataFrame:
    """One row: milestones, accounts that are no numbers, and events on exfiltration and impact."""
    top = selected.orderBy(F.col("timestamp").asc_nulls_last(), "event_id").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("timestamp", F.lit("9999-12-31").cast("timestamp")), "event_id"))), lambda s: s["event_id"]).alias("milestones"))
    totals = selected.agg(F.count_distinct(F.when(~F.col("user").rlike("^[0-9]+$"), F.col("user"))).alias("accounts"), F.count_if(F.array_contains("attack_phases", "exfiltration")).alias("exfiltration_events"), F.count_if(F.array_contains("attack_phases", "impact")).alias("impact_events"))
    return totals.crossJoin(top)


def select_scope(full: DataFrame, mini: DataFrame | None, scope: str) -> tuple[DataFrame, str]:
    return (mini, "mini") if scope == "mini" and mini is not None else (full, "full")


# Source types of each class of evidence.
EVIDENCE_CLASSES = {
    "Authentication": ("auth_log", "login_history"), "Audit": ("auditd",), "Command history": ("shell_history",), "Network state": ("ss_output", "netstat_output"), "Processes": ("ps_output",), "Accounts": ("passwd", "shadow", "group"),
    "Persistence": ("cron_file", "systemd_unit", "authorized_keys", "pam_config"), "Filesystem": ("bodyfile",),
}


def evidence_readiness(sources: DataFrame, classes: dict[str, tuple[str, ...]] = EVIDENCE_CLASSES) -> DataFrame:
    """Per class of evidence whether there is any, with how many classes of all there are; a class without sources is a gap, no negative.

    Types are those of an inventory (``classify_sources``) or of events.
    """
    present = sources.agg(F.collect_set("source_type").alias("types"))
    rows = F.array(*(F.struct(F.lit(c).alias("evidence_class"), F.arrays_overlap("types", F.array(*map(F.lit, t)).cast("array<string>")).alias("present")) for c, t in classes.items()))
    score = F.concat(F.size(F.filter("rows", lambda r: r["present"])).cast("string"), F.lit("/"), F.size("rows").cast("string"))
    return present.select(rows.alias("rows")).select(F.explode("rows").alias("r"), score.alias("score")).select("r.*", "score")


def rank_findings(findings: DataFrame, events: DataFrame, terms: list[str], techniques: list[str]) -> DataFrame:
    """Findings by severity (1 to 5), terms met (2 each, 5 at most) and techniques met (3 at most); primary if any is met."""
    ids = findings.select("title", F.explode("event_ids").alias("event_id"))
    met = ids.join(events.select("event_id", search_text().alias("text"), sorted_set(F.col("mitre"), F.col("mitre_candidates")).alias("m")), "event_id")
    some = F.array(*map(F.lit, terms)).cast("array<string>")
    each = met.groupBy("title").agg(F.array_distinct(F.flatten(F.collect_set(F.filter(some, lambda t: F.col("text").contains(t))))).alias("terms"), F.array_distinct(F.flatten(F.collect_set(F.array_intersect("m", F.array(*map(F.lit, techniques)).cast("array<string>"))))).alias("techniques"))
    df = findings.join(each, "title", "left")
    n_terms, n_tech = F.coalesce(F.size("terms"), F.lit(0)), F.coalesce(F.size("techniques"), F.lit(0))
    n_terms, n_tech = F.greatest(n_terms, F.lit(0)), F.greatest(n_tech, F.lit(0))
    score = severity_rank(F.col("severity")) + 1 + F.least(F.lit(5), n_terms * 2) + F.least(F.lit(3), n_tech)
    return df.select("title", "severity", score.cast("int").alias("score"), ((n_terms > 0) | (n_tech > 0)).alias("primary"))


def profile_coverage(sources: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    return evidence_readiness(sources, groups).drop("score").withColumnsRenamed({"evidence_class": "source_group", "present": "available"})


def checklist(events: DataFrame, questions: dict[str, tuple[str, ...]], n: int = 20) -> DataFrame:
    """Per question, events whose text has any of its terms: how many, the first ids, the terms met. All terms are looked for in one pass of each text."""
    terms = list(dict.fromkeys(t for own in questions.values() for t in own))
    place = {t: k for k, t in enumerate(terms)}
    find = finder(events.sparkSession, terms)
    rows = F.array(*(F.struct(F.lit(q).alias("question"), F.array(*(F.lit(place[t]) for t in own)).cast("array<int>").alias("places")) for q, own in questions.items()))
    met = events.select("event_id", "timestamp", find(search_text()).alias("hits")).where("size(hits) > 0")
    each = met.select("event_id", "timestamp", "hits", F.explode(rows).alias("q")).select("event_id", "timestamp", "q.question", F.array_intersect("q.places", "hits").alias("places")).where("size(places) > 0")
    named = F.transform("places", lambda k: F.element_at(F.array(*map(F.lit, terms)), k + 1))
    totals = each.groupBy("question").agg(F.count("*").alias("events"), F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")).select("question", "events", F.array_sort(named).alias("terms"))
    return totals.join(first_ids(each, ["question"], [F.col("timestamp").asc_nulls_last(), F.col("event_id")], n), "question")


def focus_signals(events: DataFrame, focus: tuple[str, ...], n: int = 20) -> DataFrame:
    signals = events.select(F.explode(sorted_set(F.col("tags"), F.col("detection_names"), F.array("event_action"))).alias("signal"))
    return signals.where(F.col("signal").isin(*focus)).groupBy("signal").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signal").limit(n)


# Numbers of confidence labels, assessments of severities.
CONFIDENCE = {"none": 0.1, "low": 0.35, "medium": 0.6, "high": 0.85}
ASSESSMENT = {"medium": "suspicious", "high": "suspicious", "critical": "suspicious"}


def confidence_score(label: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(label) == k, F.lit(v)) for k, v in CONFIDENCE.items()), F.lit(0.5))


def assessment(severity: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(severity) == k, F.lit(v)) for k, v in ASSESSMENT.items()), F.lit("informational"))


def canonical_ids(events: DataFrame) -> DataFrame:
    """Add ``canonical_id``, which depends on what happened and not on path, order or collection; related ids follow."""
    fields = ("timestamp", "time_start", "time_end", "host", "source_type", "event_category", "event_action", "user", "src_ip", "dst_ip", "port", "process", "command", "file_path", "raw")
    named = events.withColumn("canonical_id", F.concat(F.lit("can_"), F.substring(digest(*(F.col(c) for c in fields)), 1, 24)))
    names = named.where("event_id <> ''").groupBy(F.col("event_id").alias("old")).agg(F.min("canonical_id").alias("new"))
    links = named.where(F.size("related_event_ids") > 0).select("event_id", F.explode("related_event_ids").alias("old")).distinct()
    moved = links.join(names, "old", "left").groupBy("event_id").agg(F.array_sort(F.collect_set(F.coalesce("new", "old"))).alias("moved"))
    return named.join(moved, "event_id", "left").withColumn("related_event_ids", F.coalesce("moved", "related_event_ids")).drop("moved")


def omission_ledger(events: DataFrame) -> DataFrame:
    """Events that cannot be exported, with the reason: no time nor interval, or neither a locator nor text."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = F.when(F.col("timestamp").isNull() & F.col("time_start").isNull(), "no_time").when(empty("source_path") & empty("raw"), "no_locator_or_raw")
    return events.withColumn("reason", reason).where("reason is not null").select("event_id", "reason")


def timeline_candidates(events: DataFrame, inventory: DataFrame) -> DataFrame:
    """Events of medium severity or with a detection or phase, and with a member of the evidence."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    used = events.where((severity_rank(F.col("severity")) >= 2) | some("detection_names") | some("ttp_flags") | some("attack_phases") | some("attack_phase_candidates"))
    return resolve_source_member(used, inventory).where("member_id is not null").select("event_id", "timestamp", "member_id", confidence_score(F.col("confidence")).alias("confidence"), assessment(F.col("severity")).alias("assessment"))


def finding_candidates(findings: DataFrame, exported: DataFrame) -> DataFrame:
    """Findings with an exported event or more (``event_id``, ``mitre``): how many, and their techniques."""
    ids = findings.select("title", "severity", "confidence", F.explode("event_ids").alias("event_id"))
    return ids.join(exported.select("event_id", "mitre"), "event_id").groupBy("title", "severity", "confidence").agg(F.count_distinct("event_id").alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("mitre")))).alias("techniques"))


def case_reference(name: Column, case_id: Column) -> Column:
    return F.concat(F.upper(slug(name, 24)), F.lit("-"), F.upper(F.substring(F.sha2(case_id, 256), 1, 8)))


AUDIT_FIELDS = ("schema_version", "sequence", "timestamp", "action", "actor", "event_id", "before", "after", "previous_hash")
GENESIS = "0" * 64


def record_hash() -> Column:
    return digest(*(F.col(c) for c in AUDIT_FIELDS))


def append_chain(changes: DataFrame, chain: str = "chain") -> DataFrame:
    """Link the changes of each chain in order of ``sequence``: each record holds the hash of the one before.

    A hash chain is a fold by nature, so a chain is one task; its records are read in order as a
    stream, and a task holds one batch of them at a time. Chains are independent.
    """
    own = [c for c in AUDIT_FIELDS if c != "previous_hash"]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"v_{c}") for c in own]
    rows = changes.select(F.col(chain).alias("chain"), "sequence", *texts).repartition("chain").sortWithinPartitions("chain", "sequence")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = None, GENESIS
        for batch in batches:
            columns = [batch.column(f"v_{c}").to_pylist() for c in own]
            previous, hashes = [], []
            for name, *values in zip(batch.column("chain").to_pylist(), *columns, strict=True):
                if name != current or not previous and current is None:
                    current, before = name, GENESIS
                previous.append(before)
                before = hashlib.sha256("\x1f".join([*values, before]).encode()).hexdigest()
                hashes.append(before)
            yield pa.RecordBatch.from_arrays([batch.column("chain"), batch.column("sequence"), pa.array(previous, pa.string()), pa.array(hashes, pa.string())], ["chain", "sequence", "previous_hash", "record_hash"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(link, f"chain {kinds['chain']}, sequence {kinds['sequence']}, previous_hash string, record_hash string")
    return out.withColumnRenamed("chain", chain)


def verify_chain(audit: DataFrame, chain: str = "chain") -> DataFrame:
    """Violations: sequence numbers that do not follow, previous hashes that differ, hashes that are not the record's."""
    order = Window.partitionBy(chain).orderBy("sequence")
    before = F.lag("record_hash").over(order)
    df = audit.withColumns({"expected_previous": F.coalesce(before, F.lit(GENESIS)), "place": F.row_number().over(order), "own": record_hash()})
    problem = F.array_compact(F.array(F.when(F.col("sequence") != F.col("place"), F.lit("sequence")), F.when(F.col("previous_hash") != F.col("expected_previous"), F.lit("previous_hash")), F.when(F.col("record_hash") != F.col("own"), F.lit("record_hash"))))
    return df.withColumn("problem", F.explode(problem)).select(chain, "sequence", "problem")
