"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from emberlog.plans import bindings, core_queries, evidence_queries, file_queries, parser_queries, stream_queries  # noqa: F401


def queries() -> dict[str, bindings.Query]:
    return dict(bindings.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bindings.ORACLES)
