"""Writers of timelines, findings, hits and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberlog.schemas import TIMELINE_COLUMNS
from emberlog.sources import files


def flat(timeline: DataFrame) -> DataFrame:
    """The timeline in its fixed column order as text: arrays joined by commas, ``extra`` as JSON with sorted keys."""
    kinds = dict(timeline.dtypes)
    out = []
    for c in TIMELINE_COLUMNS:
        if kinds[c].startswith("array"):
            out.append(F.array_join(c, ",").alias(c))
        elif kinds[c].startswith("map"):
            out.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c))
        elif kinds[c] == "timestamp":
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c))
        else:
            out.append(F.col(c))
    return timeline.select(*out)


def write_timeline(timeline: DataFrame, path: str, csv: bool = True) -> dict[str, int]:
    """Parquet by collection, and from it JSON lines and CSV: the timeline is computed once. Returns the totals of the write (``events``, ``timed``), counted as its rows went by."""
    seen = Observation()
    observed = timeline.observe(seen, F.count(F.lit(1)).alias("events"), F.count("timestamp").alias("timed"))
    observed.write.mode("overwrite").partitionBy("collection_id").parquet(f"{path}/parquet")
    written = timeline.sparkSession.read.schema(timeline.schema).parquet(f"{path}/parquet").select(*TIMELINE_COLUMNS)
    written.write.mode("overwrite").json(f"{path}/json")
    if csv:
        flat(written).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    return {name: int(value) for name, value in seen.get.items()}


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


HIT_COLUMNS = ("value", "kind", "label", "event_id", "timestamp", "source_path", "source_type", "event_action", "user", "src_ip", "dst_ip", "file_path", "command", "summary")


def write_ioc_hits(hits: DataFrame, path: str) -> None:
    hits.select(*HIT_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(``name``, ``value``) of the files under ``path``: their SHA-256, each file read once as a stream."""
    facts = files.file_facts(files.list_files(spark, path, recursive=True))
    return facts.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("value"))


def run_manifest(events: DataFrame, sources: DataFrame, settings: dict[str, str], rules: DataFrame | None = None, inputs: DataFrame | None = None, outputs: DataFrame | None = None, totals: dict[str, int] | None = None) -> DataFrame:
    """Labelled rows on a run: its settings, events, source statuses, and hashes (``name``, ``value``) of rules, inputs and outputs where given.

    With ``totals``, which ``write_timeline`` returns, the events are not read again.
    """
    spark = events.sparkSession
    fixed = spark.createDataFrame([("setting", k, v) for k, v in sorted(settings.items())], "section string, name string, value string")
    if totals is None:
        counts = events.agg(F.count("*").alias("events"), F.count("timestamp").alias("timed")).selectExpr("stack(2, 'events', cast(events as string), 'timed', cast(timed as string)) as (name, value)").select(F.lit("totals").alias("section"), "name", "value")
    else:
        counts = spark.createDataFrame([("totals", k, str(v)) for k, v in sorted(totals.items())], fixed.schema)
    status = sources.groupBy("parser_status").agg(F.count("*").alias("n")).select(F.lit("sources").alias("section"), F.col("parser_status").alias("name"), F.col("n").cast("string").alias("value"))
    out = fixed.unionByName(counts).unionByName(status)
    for section, hashes in (("rule_hash", rules), ("input_hash", inputs), ("output_hash", outputs)):
        if hashes is not None:
            out = out.unionByName(hashes.select(F.lit(section).alias("section"), "name", "value"))
    return out


def summary_tables(**sections: DataFrame) -> DataFrame:
    """Sections of a report as rows: (``section``, ``row``), each row as JSON."""
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in sections.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
