"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from vellum.llm import (
    conversations,
    decontamination,
    fingerprints,
    katz,
    language,
    mixing,
    pages,
    phrases,
    pii,
    secrets,
    simhash,
    tokenfiles,
    toxicity,
)

MODULES = (conversations, decontamination, fingerprints, katz, language, mixing, pages, phrases, pii, secrets, simhash, tokenfiles, toxicity)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(getattr(module, "ORACLE_SQL", {}))
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
