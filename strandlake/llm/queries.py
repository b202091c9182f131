"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import alignment, chat_format, decontamination, embeddings, language_id, mixing, packing, phrases, quality_rules, simhash, token_files, toxicity, url_templates

MODULES = (
    toxicity, url_templates, language_id, mixing, token_files, quality_rules, simhash, packing, chat_format, embeddings, decontamination, alignment, phrases,
)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
