"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from strandline.plans import extras, flows, models, nested, scans, tensors

FLAGSHIP = "pipeline_tripwire"
MODULES = [scans, flows, models, tensors, extras, nested]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
