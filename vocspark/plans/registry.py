"""Where queries are registered: each has a function of (spark, sf_dir) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocspark.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Places and parts of dates are long in SQL.
PLACES = ("rank", "place", "severity_rank", "volume_rank", "pain_point_rank", "y", "m")


def register(name: str, query: Query, sql: str | None = None) -> None:
    def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("long") for c, kind in df.dtypes if kind == "int" and c in PLACES})

    QUERIES[name] = typed
    if sql:
        ORACLES[name] = sql


def over_events(name: str, transform: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the messages made from events; ``sql`` selects from ev and may add CTEs before its select."""
    register(name, lambda spark, d: transform(adapters.from_events(spark, d)), sql and f"with {adapters.EVENTS_SQL} {sql}")


def over_conversations(name: str, transform: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the messages made from conversations; ``sql`` selects from cv."""
    register(name, lambda spark, d: transform(adapters.from_conversations(spark, d)), sql and f"with {adapters.CONVERSATIONS_SQL} {sql}")


def over_documents(name: str, transform: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    register(name, lambda spark, d: transform(adapters.read(spark, d, "documents")), sql)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)})"


def case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {a} then {b}" for a, b in pairs) + f" else {otherwise} end"
