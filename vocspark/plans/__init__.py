"""Registered queries and their SQL twins."""

from __future__ import annotations

from vocspark.plans import io_queries, kpi_queries, message_queries, registry, retrieval_queries, run_queries, text_queries  # noqa: F401  (modules register their queries)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
