"""All registered queries, by area."""

from __future__ import annotations

from stopwise.plans import (
    q_audit,
    q_calibration,
    q_coverage,
    q_gates,
    q_ingest,
    q_pairs,
    q_policy,
    q_profile,
    q_resample,
    q_text,
)

QUERIES = [
    *q_policy.QUERIES,
    *q_calibration.QUERIES,
    *q_profile.QUERIES,
    *q_pairs.QUERIES,
    *q_resample.QUERIES,
    *q_coverage.QUERIES,
    *q_gates.QUERIES,
    *q_ingest.QUERIES,
    *q_text.QUERIES,
    *q_audit.QUERIES,
]
