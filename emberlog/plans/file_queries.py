"""Queries on readers and writers: Spark writes the driver's tables as files, and reads them again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from emberlog.operators import rules
from emberlog.plans.bindings import INV, TL, at, csv, inventory, query, table, timeline
from emberlog.plans.evidence_queries import _PHASES, _phase_tables, _techniques
from emberlog.session import shared_folder
from emberlog.sources import files, parsers, readers, sinks


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/emberlog-files-{uuid.uuid4().hex}/{name}"


def _logs(spark, d, compression: str = "none") -> str:
    """One text file a nation, of its customers in order."""
    folder = _folder(spark, "logs")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.concat_ws(" ", "c_custkey", "c_name").alias("value"))
    rows.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "value").write.partitionBy("nation").option("compression", compression).text(folder)
    return folder


_LINES = "SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no, c_custkey || ' ' || c_name AS raw FROM customer"
_NATION = lambda c: F.regexp_extract(c, r"nation=(\d+)", 1).cast("int")


@query(_LINES)
def read_log_lines(spark, d):
    return readers.read_log_lines(spark, _logs(spark, d)).select(_NATION("source_path").alias("nation"), "line_no", "raw")


@query(_LINES)
def read_compressed_lines(spark, d):
    got = readers.read_compressed_lines(spark, _logs(spark, d, "gzip") + "/*/*.gz")
    return got.where("problem is null").select(_NATION("source_path").alias("nation"), "line_no", "raw")


@query(_LINES)
def read_split_lines(spark, d):
    """Bzip2 files, read as splits of a few KB."""
    got = files.compressed_lines(spark, _logs(spark, d, "bzip2") + "/*/*.bz2", size=2000)
    return got.where("problem is null").select(_NATION("source_path").alias("nation"), "line_no", "raw")


@query(f"WITH l AS ({_LINES}) SELECT nation, sum(strlen(raw) + 1)::BIGINT AS size, sha256(string_agg(raw || chr(10), '' ORDER BY line_no)) AS sha256, 'unsupported' AS coverage_status, 'no parser' AS coverage_reason FROM l GROUP BY 1")
def file_inventory(spark, d):
    got = readers.file_inventory(spark, _logs(spark, d).removeprefix("file://"))
    return got.where("not startswith(relative, '_')").select(_NATION("relative").alias("nation"), "size", "sha256", "coverage_status", "coverage_reason")


@query("SELECT 'in/' || c_custkey AS path FROM customer WHERE c_custkey % 3 = 0")
def read_input_manifest(spark, d):
    folder, key = _folder(spark, "manifest"), F.col("c_custkey")
    path = F.concat(F.lit("in/"), key.cast("string"))
    table(spark, d, "customer").select(F.when(key % 3 == 0, F.concat(F.lit("  "), path)).when(key % 3 == 1, F.concat(F.lit("# "), path)).otherwise("   ")).write.text(folder)
    return readers.read_input_manifest(spark, folder)


@query("SELECT 'tool_tags' AS section, 'tool_' || s_suppkey AS id, lower(s_name) AS literal FROM supplier UNION ALL SELECT 'ttp_tags', 'all', ''")
def load_rules(spark, d):
    """A rule pack that Spark writes as one YAML file, a rule for each supplier."""
    folder, key = _folder(spark, "pack"), F.col("s_suppkey")
    lines = table(spark, d, "supplier").select(key.alias("k"), F.concat(F.lit("  tool_"), key.cast("string"), F.lit(': {namespace: tool, match_literals: ["'), F.lower("s_name"), F.lit('"]}')).alias("value"))
    ends = spark.createDataFrame([(-1, "tool_tags:"), (1 << 60, "ttp_tags:\n  all: {namespace: ttp}")], "k long, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("k").select("value").write.text(folder)
    pack = readers.load_rules(spark, folder)
    return readers.rule_table(spark, pack).select("section", "id", F.coalesce(F.get_json_object("rule", "$.match_literals[0]"), F.lit("")).alias("literal"))


@query(f"WITH {TL} SELECT event_id, at_text, {_PHASES} FROM tl WHERE event_type <> 'click' UNION ALL SELECT event_id, at_text, 'kept', '' FROM tl WHERE event_type = 'click'")
def read_timeline(spark, d):
    """A timeline written as JSON lines, between lines that are no JSON; phases are filled in where there are none."""
    folder = _folder(spark, "timeline")
    tl = _techniques(spark, d).withColumn("attack_phases", F.when(F.col("event_action") == "shell_command", F.array(F.lit("kept"))).otherwise(F.col("attack_phases")))
    tl.write.json(folder)
    tl.select(F.concat(F.lit("{broken "), "event_id")).write.mode("append").text(folder)
    got = readers.read_timeline(spark, folder, _phase_tables(spark))
    return got.select("event_id", at("timestamp").alias("at_text"), csv("attack_phases").alias("phases"), csv("attack_phase_candidates").alias("candidates"))


@query("SELECT 'unit' || c_custkey || '.service' AS file_path, CASE WHEN c_custkey % 3 = 0 THEN 'systemd_service_definition' ELSE 'systemd_unit_observed' END AS event_action, CASE WHEN c_custkey % 3 = 0 THEN 'medium' ELSE 'low' END AS severity, substr(CASE c_custkey % 3 WHEN 0 THEN '[Service]' || chr(10) || 'ExecStart=/bin/' || c_custkey WHEN 1 THEN '[Service]' ELSE 'ExecStart=/bin/x' END || chr(10) || repeat('#', 4000), 1, 4000) AS raw FROM customer")
def parse_systemd_listing(spark, d):
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("[Service]\nExecStart=/bin/"), key.cast("string"))).when(key % 3 == 1, "[Service]").otherwise("ExecStart=/bin/x")
    files = table(spark, d, "customer").select(F.concat(F.lit("unit"), key.cast("string"), F.lit(".service")).alias("source_path"), F.lit(1).cast("long").alias("line_no"), F.concat(text, F.lit("\n" + "#" * 4000)).alias("raw"))
    return parsers.parse_systemd_listing(files).select("file_path", "event_action", "severity", "raw")


@query(f"WITH {TL} SELECT event_id, at_text || '.000000' AS at_text, 'a,b' AS tags, '{{\"k\":\"v\"}}' AS extra, coalesce(command, '') AS command FROM tl")
def write_timeline(spark, d):
    """The CSV form, read again; the JSON and Parquet forms are written with it."""
    folder = _folder(spark, "out")
    tl = timeline(spark, d).withColumns({"tags": F.array(F.lit("a"), F.lit("b")), "extra": F.create_map(F.lit("k"), F.lit("v"))})
    sinks.write_timeline(tl, folder)
    got = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    return got.select("event_id", F.translate("timestamp", "TZ", " ").alias("at_text"), "tags", "extra", F.coalesce("command", F.lit("")).alias("command"))


@query("SELECT 'f' || s_suppkey AS title, 'high' AS severity, 'e' || s_suppkey || ',x' AS event_ids FROM supplier")
def write_findings(spark, d):
    folder, key = _folder(spark, "findings"), F.col("s_suppkey").cast("string")
    found = table(spark, d, "supplier").select(F.concat(F.lit("f"), key).alias("title"), F.lit("high").alias("severity"), F.array(F.concat(F.lit("e"), key), F.lit("x")).alias("event_ids"))
    sinks.write_findings(found, folder)
    return spark.read.schema(found.schema).json(folder).withColumn("event_ids", csv("event_ids"))


@query(f"WITH {TL} SELECT src_ip AS ioc, 'ip' AS kind, event_id, event_action, usr AS user_name, 14 AS columns_written FROM tl WHERE event_type = 'error'")
def write_ioc_hits(spark, d):
    folder = _folder(spark, "hits")
    hits = timeline(spark, d).where("event_action = 'ssh_login_failure'").withColumns({"value": F.col("src_ip"), "kind": F.lit("ip"), "label": F.lit("l")})
    sinks.write_ioc_hits(hits, folder)
    got = spark.read.option("header", True).option("escape", '"').csv(folder)
    return got.select(F.col("value").alias("ioc"), "kind", "event_id", "event_action", F.col("user").alias("user_name"), F.lit(len(got.columns)).alias("columns_written"))


@query(f"WITH {INV} SELECT 'files' AS section, collection_id AS name, relative AS value FROM inv UNION ALL SELECT 'totals', 'n', count(*)::VARCHAR FROM inv")
def summary_tables(spark, d):
    inv = inventory(spark, d)
    got = sinks.summary_tables(files=inv.select("collection_id", "relative"), totals=inv.agg(F.count("*").alias("n")))
    row = lambda *names: F.coalesce(*(F.get_json_object("row", f"$.{n}") for n in names))
    return got.select("section", F.coalesce(row("collection_id"), F.lit("n")).alias("name"), row("relative", "n").alias("value"))


@query("SELECT 'setting' AS section, 'mode' AS name, 'full' AS value UNION ALL SELECT 'output_hash', 'nation', sha256(string_agg(raw || chr(10), '' ORDER BY nation, line_no)) FROM (" + _LINES + ") WHERE nation = 3 UNION ALL SELECT 'rule_hash', 'pack', sha256('{}') UNION ALL SELECT 'totals', 'events', count(*)::VARCHAR FROM events UNION ALL SELECT 'totals', 'timed', count(ts)::VARCHAR FROM events UNION ALL SELECT 'sources', 'parsed', count(*)::VARCHAR FROM customer")
def hashed_manifest(spark, d):
    """A run's manifest with the hashes of a written file and of a rule pack."""
    out = sinks.file_hashes(spark, _logs(spark, d) + "/nation=3").select(F.lit("nation").alias("name"), "value")
    pack = spark.createDataFrame([("pack", json.dumps({}))], "name string, text string").select("name", F.sha2("text", 256).alias("value"))
    sources = table(spark, d, "customer").select(F.lit("parsed").alias("parser_status"))
    return sinks.run_manifest(timeline(spark, d), sources, {"mode": "full"}, rules=pack, outputs=out)


@query(f"WITH {TL} SELECT event_id, {_PHASES} FROM tl")
def fill_attack_phases(spark, d):
    return rules.fill_attack_phases(_techniques(spark, d), *_phase_tables(spark)).select("event_id", csv("attack_phases").alias("phases"), csv("attack_phase_candidates").alias("candidates"))


@query(f"WITH {TL} SELECT 'totals' AS section, 'events' AS name, count(*)::VARCHAR AS value FROM tl UNION ALL SELECT 'totals', 'timed', count(ts)::VARCHAR FROM tl UNION ALL SELECT 'setting', 'mode', 'full' UNION ALL SELECT 'sources', 'parsed', count(*)::VARCHAR FROM customer")
def written_manifest(spark, d):
    """The totals of a manifest come from the write of the timeline."""
    tl = timeline(spark, d)
    totals = sinks.write_timeline(tl, _folder(spark, "out"), csv=False)
    return sinks.run_manifest(tl, table(spark, d, "customer").select(F.lit("parsed").alias("parser_status")), {"mode": "full"}, totals=totals)


@query(f"WITH {TL} SELECT count(*) + count(*) FILTER (event_type = 'view') AS lines, count(*) FILTER (event_type = 'view') AS malformed FROM tl")
def timeline_problems(spark, d):
    folder = _folder(spark, "timeline")
    tl = timeline(spark, d)
    tl.write.json(folder)
    tl.where("event_action = 'http_request'").select(F.concat(F.lit("{broken "), "event_id")).write.mode("append").text(folder)
    return readers.timeline_problems(spark, folder).agg(F.sum("lines").alias("lines"), F.sum("malformed").alias("malformed"))
