"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from vellum.plans import decisions, fallback, flows, parts, privacy, programs, relational, scans, services, terms, textual

FLAGSHIP = "g8_chat_daily"
MODULES = (relational, textual, flows, programs, decisions, privacy, terms, fallback, scans, services, parts)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
