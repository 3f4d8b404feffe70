"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import materialise

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "vendor", "jwt", "pem")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_VENDOR = re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_])")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
_SAMPLE = re.compile(r"example|sample|changeme|placeholder|dummy|your|xxxx|1234567|abcdef", re.IGNORECASE)


def spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, secret value) of every candidate, in code points, by start and kind."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    out += [(3, m.start(), m.end(), m[0]) for m in _VENDOR.finditer(text)]
    if "eyJ" in text:
        out += [(4, m.start(), m.end(), m[0]) for m in _JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(5, m.start(), m.end(), m[0]) for m in _PEM.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def listed(found: list[tuple[int, int, int, str]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found if k < kinds)


def live_looking(value: str, least_bits: float = 2.5) -> bool:
    """Random enough, and without the words of made-up examples."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= least_bits and not _SAMPLE.search(value)


_SCAN = "row_id long, id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,key:string,live:boolean>>"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, copied_owners: int = 3) -> DataFrame:
    """One row per input row: id, the base digest columns, all ``spans`` and ``secrets``.

    ``secrets`` holds each span with ``owners`` and ``repositories``, the numbers of distinct ones
    in the whole corpus with the same secret value, and ``verdict``: ``copied`` from
    ``copied_owners`` owners on, else ``live`` if the value looks random and ``sample`` if not.
    Owner and repository default to the columns ``source`` and the id. Values are hashed before
    they are shuffled; counts are partial in each task first, so a value found everywhere does not
    meet in one task.

    Null text is empty, a null owner or repository counts as one more. Repeated rows are scanned
    each, in an id's name or not; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col("source") if owner is None else owner).alias("owner"),
        F.xxhash64(F.col(id_col) if repository is None else repository).alias("repository"),
    ).withColumn("row_id", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                got = spans(text.as_py() or "")
                n = Counter(s[0] for s in got)
                row = (n[0], n[1], n[2], hashlib.sha256(listed(got, 3).encode()).hexdigest(), listed(got), [{"kind": KINDS[k], "start": a, "end": b, "key": hashlib.md5(v.encode()).hexdigest(), "live": live_looking(v)} for k, a, b, v in got])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            found = pa.array(columns[5], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.string()), ("live", pa.bool_())])))
            names = ["row_id", "id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:5]), found], names)

    schema = _SCAN.format(id=kind).replace(f"id {kind},", f"id {kind}, owner long, repository long,", 1)
    scanned = materialise(rows.select("row_id", "id", "owner", "repository", "text").mapInArrow(run, schema), "scanned")

    each = scanned.where(F.size("found") > 0).select("row_id", "owner", "repository", F.explode("found").alias("s"))
    pairs = each.groupBy(F.col("s.key").alias("key"), "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("key", "owner").agg(F.count("*").alias("repositories"))
    owners = by_owner.groupBy("key").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = each.select("row_id", "s.*").join(owners, "key")
    verdict = F.when(F.col("owners") >= copied_owners, "copied").when(F.col("live"), "live").otherwise("sample")
    own = judged.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "owners", "repositories", verdict.alias("verdict")))).alias("secrets"))
    out = scanned.join(own, "row_id", "left")
    secrets = F.coalesce("secrets", F.from_json(F.lit("[]"), own.schema["secrets"].dataType))
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", secrets.alias("secrets"))


def redact(text: Column, secrets: Column, mask: str = "[secret]", verdict: str = "live") -> Column:
    """``text`` with every span of that verdict masked; overlapping spans become one mask."""
    live = F.filter(secrets, lambda s: s["verdict"] == verdict)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        apart = (span["start"] > state["at"]) | (state["at"] == 0)
        return F.struct(F.when(apart, F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"]).alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    return F.when(F.size(live) == 0, text).otherwise(F.aggregate(live, start, step, lambda s: F.concat(s["done"], F.substr(text, (s["at"] + 1).cast("int")))))
