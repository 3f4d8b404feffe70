"""Readers of evidence files, indicator lists, manifests, rules and written timelines."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from emberlog.functions import times
from emberlog.operators.correlate import read_ioc_lines
from emberlog.operators.rules import fill_attack_phases
from emberlog.operators.timeline import first_n, to_timeline
from emberlog.schemas import TIMELINE_SCHEMA
from emberlog.session import written
from emberlog.sources import files


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(``source_path``, ``line_no``, ``raw``) of text files, in file order, bad UTF-8 replaced.

    Lines are numbered by block: the place within a block, plus the lines of the blocks before it in
    the file. No task holds a whole file that has several blocks.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = text.groupBy("source_path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = text.join(blocks.withColumn("before", before), ["source_path", "block"])
    return numbered.select("source_path", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), F.make_valid_utf8(F.regexp_replace("value", r"\r$", "")).alias("raw"))


def read_compressed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of gzip, bzip2 and xz files, told by their first bytes, in splits where their format has them; others give one row with ``problem``."""
    return files.compressed_lines(spark, paths)


# Source types and the globs of their paths, at any depth.
SOURCE_GLOBS = {
    "uac_log": ("uac.log", "*/uac.log"),
    "bodyfile": ("bodyfile*", "*bodyfile*"),
    "bodyfile_privilege": ("bodyfile*", "*bodyfile*"),
    "auth_log": ("*auth.log*", "*secure*"),
    "syslog": ("*syslog*", "*messages*", "*kern.log*"),
    "auditd": ("*audit.log*", "audit.log*"),
    "cron": ("*cron*",),
    "cron_file": ("etc/crontab", "etc/cron.d/*", "var/spool/cron/*", "var/spool/cron/crontabs/*"),
    "shell_history": (".bash_history", ".zsh_history", ".sh_history", ".*history"),
    "package_log": ("*dpkg.log*", "*apt/history.log*", "*yum.log*", "*dnf.log*", "*zypper.log*"),
    "systemd": ("*systemctl*",),
    "journal_text": ("*journalctl*", "*journal*.txt", "*journal*.log", "*journal*.out"),
    "journal_binary": ("*.journal", "*.journal~"),
    "systemd_unit": ("etc/systemd/system/*.service", "etc/systemd/system/*.timer", "home/*/.config/systemd/user/*.service", "root/.config/systemd/user/*.service"),
    "web_log": ("*access.log*", "*error.log*", "*nginx*", "*apache*", "*httpd*"),
    "login_history": ("*last.txt", "*lastb.txt", "*login_history*", "*failed_logins*", "*wtmp.txt", "*btmp.txt"),
    "login_binary": ("var/log/wtmp", "var/log/btmp", "var/log/lastlog"),
    "passwd": ("etc/passwd",),
    "shadow": ("etc/shadow",),
    "group": ("etc/group",),
    "sudoers": ("etc/sudoers", "etc/sudoers.d/*"),
    "authorized_keys": ("home/*/.ssh/authorized_keys", "root/.ssh/authorized_keys"),
    "known_hosts": ("home/*/.ssh/known_hosts", "root/.ssh/known_hosts"),
    "sshd_config": ("etc/ssh/sshd_config", "etc/ssh/sshd_config.d/*"),
    "profile": ("etc/profile", "etc/profile.d/*", "home/*/.bashrc", "home/*/.profile", "home/*/.bash_profile", "root/.bashrc", "root/.profile"),
    "ld_preload": ("etc/ld.so.preload",),
    "pam_config": ("etc/pam.d/*",),
    "rc_local": ("etc/rc.local", "etc/init.d/*"),
    "capabilities": ("*capabilities*", "*getcap*"),
    "ss_output": ("*ss_-tanp*", "*ss_-tlnp*", "*ss_tanp*", "*ss_tlnp*"),
    "netstat_output": ("*netstat_-anp*", "*netstat_anp*", "*netstat_-tlnp*"),
    "ps_output": ("*ps_auxwww*", "*ps_-ef*", "*ps_aux*"),
}
# What the names of some types must be besides.
_CONFIRMED = {
    "auth_log": r"(^|/)(auth\.log|secure)[^/]*$",
    "cron": r"(^|/)var/log/|(^|/)cron[^/]*$",
    "journal_text": r"(?<!\.journal)(?<!\.journal~)$",
}


def glob_pattern(globs: tuple[str, ...]) -> str:
    """A regular expression for paths whose last parts fit one of the globs; a star stays within a part."""
    return r"(^|/)(" + "|".join("[^/]*".join(map(re.escape, g.split("*"))) for g in globs) + ")$"


def classify_sources(listed: DataFrame, globs: dict[str, tuple[str, ...]] = SOURCE_GLOBS) -> DataFrame:
    """(``relative``, ``source_type``), as many rows for a file as types fit; files that are left out have none.

    Where ``head`` is given, the first bytes of the file, a database is told by them (``sqlite_log``).
    """
    path = F.col("relative")
    tests = [(t, path.rlike(glob_pattern(g)) & (path.rlike(_CONFIRMED[t]) if t in _CONFIRMED else F.lit(True))) for t, g in globs.items()]
    if "head" in listed.columns:
        tests.append(("sqlite_log", F.col("head") == F.lit(files.SQLITE)))
    found = F.array_compact(F.array(*(F.when(test, F.lit(t)) for t, test in tests)))
    return listed.where(excluded(path).isNull()).select("relative", F.explode(found).alias("source_type")).dropDuplicates()


def excluded(path: Column) -> Column:
    """Why a file is left out, or null."""
    # Parts of paths, and the reasons.
    return F.when(path.rlike(r"(^|/)__MACOSX(/|$)"), "macos_metadata_directory").when(path.rlike(r"(^|/)\.DS_Store(/|$)"), "macos_finder_metadata").when(path.rlike(r"(^|/)\._"), "macos_appledouble_metadata")


def excluded_files(listed: DataFrame) -> DataFrame:
    return listed.select("relative", excluded(F.col("relative")).alias("reason")).where("reason is not null")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` with size, SHA-256 and source types; files that cannot be read have no hash.

    Spark lists the files; each is read once, as a stream, for its hash and its first bytes, so size
    has no limit. The facts are written once, as types and rows both come from them.
    """
    facts = files.file_facts(files.list_files(spark, root, recursive=True))
    place = F.instr("path", root.rstrip("/").removeprefix("file://") + "/") + len(root.rstrip("/").removeprefix("file://")) + 1
    base = facts.select(F.expr("path").substr(place, F.length("path")).alias("relative"), F.col("length").alias("size"), "sha256", "head")
    base = written(base.where(excluded(F.col("relative")).isNull()), "inventory")
    types = classify_sources(base).groupBy("relative").agg(F.array_sort(F.collect_set("source_type")).alias("source_types"))
    some = F.col("source_types").isNotNull()
    return base.drop("head").join(types, "relative", "left").withColumns({"coverage_status": F.when(some, "pending").otherwise("unsupported"), "coverage_reason": F.when(~some, "no parser")})


# Names of columns with times and messages, the best first.
TIME_COLUMNS = ("timestamp", "time", "datetime", "utcsec", "ts", "created_at", "event_time", "date", "o_orderdate", "l_shipdate")
MESSAGE_COLUMNS = ("message", "msg", "text", "description", "event", "o_comment", "l_comment")


def table_to_timeline(df: DataFrame, table: str, year: int = 1970, tz: str = "UTC") -> DataFrame:
    """Events of any table: the first usable time by column name, the first message column, the whole row as JSON."""
    names = {c.lower(): c for c in df.columns}
    found = [times.parse_numeric_or_text(F.col(names[c]).cast("string"), year, tz) for c in TIME_COLUMNS if c in names]
    if {"ldate", "ltime"} <= set(names):
        found.append(times.parse_any(F.concat_ws(" ", names["ldate"], names["ltime"]), year, tz))
    ts = F.coalesce(*found) if found else F.lit(None)
    message = F.coalesce(*(F.col(names[c]).cast("string") for c in MESSAGE_COLUMNS if c in names), F.lit(table))
    raw = F.to_json(F.struct(*df.columns))
    return to_timeline(df, {"timestamp": ts, "timestamp_type": F.lit("log_time"), "source_path": F.lit(table), "source_type": F.lit("table"), "parser": F.lit("table"), "event_category": F.lit("application"), "event_action": F.lit("table_row"), "summary": message, "raw": raw}).where("timestamp is not null")


def resolve_lookups(df: DataFrame, lookups: dict[str, tuple[DataFrame, str, str]], most: int = 1_000_000) -> DataFrame:
    """Replace ids by names: column to (table, id, name); ids that are not found stay as text. Tables of up to ``most`` rows are broadcast."""
    for column, (table, key, name) in lookups.items():
        small = table.select(F.col(key).alias("_key"), F.col(name).alias("_name")).dropDuplicates(["_key"])
        if table.limit(most + 1).count() <= most:
            small = F.broadcast(small)
        df = df.join(small, F.col(column) == F.col("_key"), "left").withColumn(column, F.coalesce("_name", F.col(column).cast("string"))).drop("_key", "_name")
    return df


def table_inventory(rows: DataFrame, by: str = "table_name") -> DataFrame:
    """Rows examined, with a usable time, and without one. Needs ``timestamp``."""
    return rows.groupBy(by).agg(F.count("*").alias("examined"), F.count("timestamp").alias("emitted"), F.count_if(F.col("timestamp").isNull()).alias("without_time"))


def cap_rows(df: DataFrame, by: str, order: list[Column], per_table: int, total: int | None = None) -> DataFrame:
    """At most ``per_table`` rows of each value of ``by`` and ``total`` in all, with ``truncated`` where more were there. A cap is this operator's purpose."""
    counts = df.groupBy(by).agg(F.count("*").alias("_n"))
    cut = first_n(df, [by], order, per_table).drop("place").join(counts, by).withColumn("truncated", F.col("_n") > per_table).drop("_n")
    return cut if total is None else cut.orderBy(by, *order).limit(total)


def read_iocs(spark: SparkSession, path: str) -> DataFrame:
    return read_ioc_lines(read_log_lines(spark, path))


def read_input_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')")


#: Sections of a rule pack that hold rules by id, and the namespace that each rule of a section names.
RULE_SECTIONS = {"tool_tags": "tool", "ttp_tags": "ttp", "actor_similarity_profiles": "actor_similarity", "malware_payload_tags": "malware_payload"}


def load_rules(spark: SparkSession, path: str) -> dict[str, dict]:
    """The sections of a YAML rule pack, each a mapping of rules by id. A pack is a file written by hand, of a size that the driver can hold; a key that comes twice is an error.

    The parser is libyaml's where PyYAML has it. Time grows with the number of rules.
    """
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        again = [k for k, n in Counter(keys).items() if n > 1]
        if again:
            raise ValueError(f"keys that come twice: {sorted(map(str, again))}")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    pack = yaml.load(text, Loader=Loader) or {}  # noqa: S506
    if not isinstance(pack, dict):
        raise ValueError("a rule pack is a mapping")
    return pack


def phase_tables(spark: SparkSession, pack: dict[str, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of attack phases that events are classified by: techniques, signals, order."""
    techniques = [(t, p) for t, phases in pack["techniques"].items() for p in phases]
    signals = [(s, p) for p, names in pack["phase_signals"].items() for s in names]
    order = [(p, int(v["order"])) for p, v in pack["phases"].items()]
    return spark.createDataFrame(techniques, "mitre string, phase string"), spark.createDataFrame(signals, "signal string, phase string"), spark.createDataFrame(order, "phase string, place int")


def rule_table(spark: SparkSession, pack: dict[str, dict]) -> DataFrame:
    """All rules of a pack as rows (``section``, ``id``, ``rule`` as JSON), for ``validate_rules``."""
    rows = [(section, str(k), json.dumps(v)) for section in (*RULE_SECTIONS, "source_references") for k, v in (pack.get(section) or {}).items()]
    return spark.createDataFrame(rows, "section string, id string, rule string")


def validate_rules(rules: DataFrame) -> DataFrame:
    """(``section``, ``id``, ``violation``) of a table of rules (``section``, ``id``, ``rule`` as JSON).

    Checks ids, namespaces, required texts, lists of distinct texts, techniques, severities,
    confidences, references that are no source, minimums, and the cap of likeness profiles.
    """
    rule = lambda field, kind="string": F.from_json("rule", f"`{field}` {kind}")[field]
    texts = lambda field: F.coalesce(rule(field, "array<string>"), F.array().cast("array<string>"))
    listed = lambda field: F.get_json_object("rule", f"$.{field}")
    of = lambda *sections: F.col("section").isin(*sections)
    blank = lambda field: F.trim(F.coalesce(rule(field), F.lit(""))) == ""
    # Forms and names that rules may use.
    technique, confidences, severities = r"^T\d{4}(\.\d{3})?$", ("low", "medium", "high"), ("informational", "low", "medium", "high", "critical")
    lists = ("mitre", "mitre_focus", "source_refs", "actor_refs", "match_literals", "match_detection_names", "match_event_actions", "match_tags", "strong_indicators", "supporting_indicators", "required_any_indicators")
    tools, ttps, actors, sources = of("tool_tags", "malware_payload_tags"), of("ttp_tags"), of("actor_similarity_profiles"), of("source_references")
    namespace = F.create_map(*[F.lit(x) for pair in RULE_SECTIONS.items() for x in pair])[F.col("section")]
    number = lambda field, default: F.coalesce(rule(field, "double"), F.lit(default).cast("double"))
    low = lambda field, default, least: ~F.coalesce((number(field, default) >= least) & (number(field, default) == F.floor(number(field, default))), F.lit(False))
    checks = {
        "bad_id": ~F.col("id").rlike("^[a-z0-9_]+$"),
        "bad_namespace": ~sources & ~F.coalesce(rule("namespace") == namespace, F.lit(False)),
        "missing_title": sources & blank("title"),
        "bad_reference": sources & ~F.coalesce(rule("url").startswith("https://"), F.lit(False)),
        "missing_category": tools & blank("category"),
        "missing_evidence": ttps & blank("evidence"),
        "missing_display_name": actors & blank("display_name"),
        "missing_warning": actors & blank("analyst_warning"),
        "bad_severity": ttps & ~F.coalesce(rule("severity").isin(*severities), F.lit(False)),
        "bad_confidence": (tools | ttps) & ~F.coalesce(rule("confidence_when_matched").isin(*confidences), F.lit(False)),
        "no_literals": tools & (F.size(texts("match_literals")) == 0),
        "no_strong_indicators": actors & (F.size(texts("strong_indicators")) == 0),
        "bad_confidence_cap": actors & ~F.coalesce(rule("confidence_cap").isin("low", "medium"), F.lit(False)),
        "low_evidence_count": actors & low("required_evidence_count", None, 2),
        "low_event_count": actors & low("minimum_event_count", 2, 1),
        "low_strong_count": actors & low("minimum_strong_indicators", 2, 1),
        "low_supporting_count": actors & low("minimum_supporting_indicators", 1, 0),
        "bad_technique": F.exists(F.concat(texts("mitre"), texts("mitre_focus")), lambda m: ~F.coalesce(m.rlike(technique), F.lit(False))),
    }
    for field in lists:
        checks[f"bad_list_{field}"] = listed(field).isNotNull() & (~listed(field).startswith("[") | F.exists(texts(field), lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""))
        checks[f"repeats_{field}"] = F.size(F.array_distinct(F.transform(texts(field), F.trim))) < F.size(texts(field))
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())))
    single = rules.select("section", "id", F.explode(found).alias("violation"))
    double = rules.groupBy("section", "id").agg(F.count("*").alias("n")).where("n > 1").select("section", "id", F.lit("duplicate_id").alias("violation"))
    used = rules.where(~sources).select("section", "id", F.explode(F.concat(texts("source_refs"), texts("actor_refs"))).alias("ref")).distinct()
    known = rules.where(sources).select(F.col("id").alias("ref"))
    unknown = used.join(known, "ref", "left_anti").select("section", "id", F.lit("unknown_reference").alias("violation")).distinct()
    return single.unionByName(double).unionByName(unknown)


def validate_phases(phases: DataFrame, signals: DataFrame, techniques: DataFrame) -> DataFrame:
    """(``kind``, ``key``, ``violation``) of phases (``phase``, ``id``, ``label``, ``place``), signals (``signal``, ``phase``) and techniques (``mitre``, ``phase``)."""
    # Forms of phases, tactics and techniques.
    form, tactic, technique = "^[a-z][a-z0-9_]*$", r"^TA\d{4}$", r"^T\d{4}(\.\d{3})?$"
    bad = lambda test: ~F.coalesce(test, F.lit(False))
    row = lambda df, kind, key, **checks: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in checks.items())))).alias("violation")).distinct()
    names = phases.select("phase").distinct()
    place = phases.groupBy("place").agg(F.count("*").alias("n")).where("n > 1 or place is null").select("place")
    twice = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    tag = lambda df, kind, key, what: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(what).alias("violation")).distinct()
    return reduce(
        DataFrame.unionByName,
        [
            row(phases, "phase", "phase", bad_phase=bad(F.col("phase").rlike(form)), bad_tactic=bad(F.col("id").rlike(tactic)), missing_label=F.trim(F.coalesce("label", F.lit(""))) == ""),
            row(signals, "signal", "signal", bad_signal=bad(F.col("signal").rlike(form))),
            row(techniques, "technique", "mitre", bad_technique=bad(F.col("mitre").rlike(technique))),
            tag(phases.join(place, phases["place"].eqNullSafe(place["place"]), "left_semi"), "phase", "phase", "order_not_unique"),
            tag(signals.join(names, "phase", "left_anti"), "signal", "signal", "unknown_phase"),
            tag(techniques.join(names, "phase", "left_anti"), "technique", "mitre", "unknown_phase"),
            tag(twice(signals, "phase", "signal"), "signal", "signal", "repeated"),
            tag(twice(techniques, "mitre", "phase"), "technique", "mitre", "repeated"),
        ],
    )


def read_timeline(spark: SparkSession, path: str, phases: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """A timeline written as JSON lines; lines that do not parse are left out. With tables of phases, events without phases or candidates are classified."""
    tl = spark.read.schema(TIMELINE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return tl if phases is None else fill_attack_phases(tl, *phases)


def timeline_problems(spark: SparkSession, path: str) -> DataFrame:
    """(``source_path``, ``lines``, ``malformed``) of a timeline written as JSON lines: what ``read_timeline`` leaves out. Blank lines do not count."""
    bad = "_malformed"
    schema = StructType([*TIMELINE_SCHEMA.fields, StructField(bad, StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), "value").where(F.trim("value") != "")
    broken = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})[bad].isNotNull()
    return lines.groupBy("source_path").agg(F.count("*").alias("lines"), F.count_if(broken).alias("malformed"))
