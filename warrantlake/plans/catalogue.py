"""Named queries: ``QUERIES[name] = (build(spark, sf_dir), oracle SQL or None)``."""

from __future__ import annotations

from warrantlake.plans import q_drift, q_evidence, q_ledger, q_matrix, q_metrics, q_more, q_nullband, q_paired, q_paths, q_policy, q_pooling, q_records, q_response, q_rest, q_session, q_sources, q_text, q_typed, q_validate

QUERIES: dict = {}
for _module in (q_metrics, q_drift, q_evidence, q_ledger, q_matrix, q_text, q_records, q_more, q_rest, q_validate, q_session, q_paired, q_policy, q_paths, q_nullband, q_typed, q_pooling, q_response, q_sources):
    QUERIES |= _module.QUERIES
