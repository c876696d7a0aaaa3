"""All queries of the evaluation operators, with SQL for each that SQL can express."""

from __future__ import annotations

from assayframe.plans import audits, authoring, controls, flow, run_files, scores, suites, summaries, texts, verdicts  # noqa: F401  they register their queries
from assayframe.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
