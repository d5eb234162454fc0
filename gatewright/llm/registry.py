"""The queries of this subpackage. The pipeline's are in corpus_pipeline.py at the repository's top."""

from __future__ import annotations

from gatewright.llm import decontamination, embedding_dedup, filter_audit, fingerprints, importance, language_id, lm_scoring, near_dedup, packing, passages, pieces, sharding, url_filters

MODULES = (decontamination, embedding_dedup, filter_audit, fingerprints, importance, language_id, lm_scoring, near_dedup, packing, passages, pieces, sharding, url_filters)


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(module, "ORACLE_SQL", {})
    return out
