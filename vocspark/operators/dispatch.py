"""Metrics by name over one slice of messages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.operators import compare, conversation, filters, kpi, trends
from vocspark.sources.scratch import Scratch


def _topics_and_flags(messages: DataFrame, kind: str) -> DataFrame:
    """One kind of ``compare.issue_sets`` of the newest run against the run before it."""
    runs = messages.groupBy("dataset_run_id").agg(F.max("created_at").alias("at")).orderBy(F.desc("at"), F.desc("dataset_run_id")).limit(2)
    runs = [r["dataset_run_id"] for r in runs.collect()]  # two names
    now = messages.where(F.col("dataset_run_id") == runs[0]) if runs else messages
    before = messages.where(F.col("dataset_run_id") == runs[1]) if len(runs) > 1 else messages.limit(0)
    sets = compare.issue_sets(kpi.topics_batch(now), kpi.topics_batch(before), compare.flags_of(now))
    return sets.where(F.col("kind") == kind)


def _root_causes(messages: DataFrame) -> DataFrame:
    means = messages.agg(F.avg("response_time_minutes").alias("av"), (F.avg(F.col("reopened").cast("int")) * 100).alias("ro"))
    return kpi.root_causes(kpi.topics_batch(messages).crossJoin(F.broadcast(means)), F.col("av"), F.col("ro"))  # one row of means


def _delta(messages: DataFrame) -> DataFrame:
    """The last 30 days against all."""
    newest = messages.agg((F.max("created_at") - F.expr("interval 30 days")).alias("_since"))
    rows = messages.crossJoin(F.broadcast(newest))  # one row
    return compare.deltas(compare.sides(rows, F.col("created_at") >= F.col("_since"), F.lit(True)))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kpi_summary": kpi.overall, "response_time": lambda m: m.agg(F.avg("response_time_minutes").alias("average_response_time_minutes")), "sla_turnaround": kpi.sla_tiers,
    "resolution_rate": lambda m: kpi.overall(m).select("resolution_rate"), "escalation_rate": lambda m: kpi.overall(m).select("escalation_rate"), "reopen_rate": lambda m: kpi.direct_rates(m).select("reopen_rate"),
    "fcr": lambda m: kpi.direct_rates(m).select("fcr_rate"), "csat_proxy": kpi.csat, "sentiment": kpi.sentiment_distribution, "sentiment_trend": trends.live, "issue_trends": trends.live,
    "emerging_issues": lambda m: _topics_and_flags(m, "emerging"), "recurring_issues": lambda m: _topics_and_flags(m, "recurring"), "priorities": lambda m: kpi.priorities(kpi.topics_batch(m)), "root_causes": _root_causes,
    "cluster_sentiment_stats": lambda m: kpi.cluster_stats(kpi.topics_batch(m)), "dimension_breakdowns": kpi.dimension_breakdown, "available_dimensions": kpi.spans,
    "solution_impact": lambda m: kpi.recommendations(kpi.topics_live(m), kpi.overall(m)), "comparative_delta": _delta, "customer_pain_points": lambda m: kpi.cluster_stats(kpi.topics_batch(m)),
    # further ones, and short names
    "overall": kpi.overall, "direct_rates": kpi.direct_rates, "sla": kpi.sla_tiers, "csat": kpi.csat, "weighted_sentiment": kpi.weighted_sentiment, "dimensions": kpi.dimension_breakdown,
    "companies": kpi.company_list, "spans": kpi.spans, "topics": kpi.topics_live, "topics_batch": kpi.topics_batch, "samples": kpi.topic_samples, "multiplier": kpi.escalation_multiplier, "quality": kpi.quality_scores,
    "states": conversation.states, "rates": lambda m: conversation.rates(conversation.states(m)), "trend": trends.live, "batch_trend": trends.batch, "multi_period": trends.multi_period, "spikes": trends.spike_flags, "hourly": trends.hourly_zscore,
}


#: Small tables that several metrics are made of, and how each of these is made of its table.
BASES: dict[str, Callable[[DataFrame], DataFrame]] = {"totals": kpi.totals, "topics": kpi.topics_batch, "days": trends.live}
SHARED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "kpi_summary": ("totals", kpi.overall_from), "overall": ("totals", kpi.overall_from), "response_time": ("totals", lambda t: t.select(F.col("response_mean").alias("average_response_time_minutes"))),
    "resolution_rate": ("totals", lambda t: kpi.overall_from(t).select("resolution_rate")), "escalation_rate": ("totals", lambda t: kpi.overall_from(t).select("escalation_rate")),
    "reopen_rate": ("totals", lambda t: kpi.direct_from(t).select("reopen_rate")), "fcr": ("totals", lambda t: kpi.direct_from(t).select("fcr_rate")), "direct_rates": ("totals", kpi.direct_from),
    "topics_batch": ("topics", lambda t: t), "priorities": ("topics", kpi.priorities), "cluster_sentiment_stats": ("topics", kpi.cluster_stats), "customer_pain_points": ("topics", kpi.cluster_stats),
    "sentiment_trend": ("days", lambda t: t), "issue_trends": ("days", lambda t: t), "trend": ("days", lambda t: t),
}


def run_metrics(messages: DataFrame, names: Iterable[str], **slice_: object) -> dict[str, DataFrame]:
    """The named metrics over the messages that ``filters.slice_filter(**slice_)`` keeps. Unknown names raise KeyError.

    A table of totals, topics or days that two or more of the names are made of is computed in one
    pass over the messages and kept, so that more names do not mean more scans.
    """
    names = list(dict.fromkeys(names))
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {', '.join(unknown)}")
    kept = messages.where(filters.slice_filter(**slice_))
    uses = Counter(SHARED[n][0] for n in names if n in SHARED)
    scratch = Scratch(messages.sparkSession, "metrics") if any(n > 1 for n in uses.values()) else None
    bases = {base: scratch.keep(BASES[base](kept)) if n > 1 else BASES[base](kept) for base, n in uses.items()}
    return {n: SHARED[n][1](bases[SHARED[n][0]]) if n in SHARED else METRICS[n](kept) for n in names}
