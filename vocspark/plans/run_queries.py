"""Queries of the conversation document and of comparisons between runs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vocspark.functions import wordlists as W
from vocspark.operators import compare, conversation, convdoc, kpi
from vocspark.plans.kpi_queries import _BATCH, SPIKES_SQL
from vocspark.plans.message_queries import VIEW_SQL
from vocspark.plans.registry import over_conversations, over_events, text
from vocspark.plans.text_queries import SQL
from vocspark.sources import adapters
from vocspark.sources.scratch import Scratch


def _rows(m):
    return conversation.batch_rows(adapters.threaded(m))


def _view(m):
    return conversation.view(_rows(m))


def _both(m):
    """Conversations and messages; these are made and written once."""
    rows = Scratch(m.sparkSession, "batch-rows").keep(_rows(m))
    return conversation.view(rows), rows


over_conversations("e28_escalation_rates", lambda m: convdoc.escalation_rates(_view(m)), f", {VIEW_SQL} select 'overall' as dimension, 'all' as value, count(*) as conversations, avg(escalated::int) * 100 as escalation_rate from cw " + " ".join(f"union all select '{c}', {c}, count(*), avg(escalated::int) * 100 from cw group by {c}" for c in ("issue_category", "sentiment", "priority")))
over_conversations("e29_resolution_rates", lambda m: convdoc.resolution_rates(_view(m)), f", {VIEW_SQL} select 'all' as value, count(*) as conversations, avg(resolved::int) * 100 as resolution_rate from cw union all select issue_category, count(*), avg(resolved::int) * 100 from cw group by 1")
over_conversations("e29_category_sentiment", lambda m: convdoc.category_sentiment(_rows(m)), f", {VIEW_SQL} select issue_category, count(*) as messages, avg(sentiment_score) as avg_score, avg((sentiment = 'negative')::int) * 100 as negative_percentage from b3 group by 1")
over_conversations("e30_resolution_times", lambda m: convdoc.resolution_times(_view(m)), f", {VIEW_SQL} select count(*) as resolved, avg(duration_minutes) as average_minutes, median(duration_minutes) as median_minutes from cw where resolved")


def _sketched(m):
    """Sketches by category and number of messages, merged by category, and whether the median found has half of the exact minutes on either side."""
    view = _view(m).select("issue_category", "messages", "resolved", "duration_minutes")
    times = convdoc.sketched_times(convdoc.resolution_sketches(view, "issue_category", "messages"), "issue_category")
    found = times.select("issue_category", F.col("median_minutes").alias("found"))
    share = lambda yes: F.avg(yes.cast("int"))
    minutes, slack = F.col("duration_minutes"), convdoc.RANK_ERROR
    halves = view.where("resolved and duration_minutes is not null").join(found, "issue_category").groupBy("issue_category").agg(((share(minutes < F.col("found")) <= 0.5 + slack) & (share(minutes <= F.col("found")) >= 0.5 - slack)).alias("median_holds"))
    return times.select("issue_category", "resolved", F.round("average_minutes", 6).alias("average_minutes")).join(halves, "issue_category")


over_conversations("e30_sketched_times", _sketched, f", {VIEW_SQL} select issue_category, count(*) as resolved, round(avg(duration_minutes), 6) as average_minutes, true as median_holds from cw where resolved group by 1")
_TOP = "select field, value, n, row_number() over (partition by field order by n desc, value) as rank from (select field, value, count(*) as n from (unpivot (select {cols} from cw{where}) on {cols} into name field value value) where value <> 'Unknown' group by 1, 2)"
_COLS = "issue_category, issue_subcategory, pain_point, sentiment"
over_conversations("e31_top_labels", lambda m: convdoc.top_labels(_view(m), _COLS.split(", ")), f", {VIEW_SQL} select * from ({_TOP.format(cols=_COLS, where='')}) where rank <= 5")
over_conversations("e31_distinct_pain_points", lambda m: convdoc.distinct_pain_points(_view(m)), f", {VIEW_SQL} select count(distinct pain_point) as distinct_pain_points from cw where pain_point <> 'Unknown'")
over_conversations(
    "e32_recurring_after_solution",
    lambda m: convdoc.flagged(_view(m), "recurring_after_solution"),
    f", {VIEW_SQL} select 'all' as kind, 'all' as value, count(*) filter (recurring_after_solution) as n, avg(recurring_after_solution::int) * 100 as rate from cw union all select field, value, n, null from ({_TOP.format(cols='issue_category, pain_point', where=' where recurring_after_solution')}) where rank <= 5",
)
over_conversations("e33_sentiment_impact", lambda m: convdoc.sentiment_impact(*_both(m)), f", {VIEW_SQL} select sentiment, conversations, resolution_rate, escalation_rate, avg_response_minutes from (select sentiment, count(*) as conversations, avg(resolved::int) * 100 as resolution_rate, avg(escalated::int) * 100 as escalation_rate from cw group by 1) left join (select sentiment, avg(response_time_minutes) as avg_response_minutes from b3 group by 1) using (sentiment)")
over_conversations(
    "e34_ai_impact",
    lambda m: convdoc.ai_impact(_view(m).withColumns({"ai_solution_proposed": F.col("messages") > 3, "ai_solution_successful": F.col("resolved"), "sentiment_before": F.lit(-1.0), "sentiment_after": F.col("messages") % 2})),
    f", {VIEW_SQL} select 'available' as status, count(*) filter (messages > 3) as proposed, avg(resolved::int) filter (messages > 3) * 100 as success_rate, avg(messages % 2 + 1.0) filter (messages > 3) as sentiment_change from cw",
)
over_conversations(
    "e35_document",
    lambda m: convdoc.document(*_both(m)).select(F.get_json_object("document", "$.conversations").cast("long").alias("conversations"), F.get_json_object("document", "$.messages").cast("long").alias("messages"), F.get_json_object("document", "$.times.resolved").cast("long").alias("resolved"), F.get_json_object("document", "$.labels[0].value").alias("top_category"), F.get_json_object("document", "$.ai.status").alias("ai")),
    f", {VIEW_SQL} select count(*) as conversations, cast(sum(messages) as bigint) as messages, count(*) filter (resolved) as resolved, (select issue_category from cw where issue_category <> 'Unknown' group by 1 order by count(*) desc, 1 limit 1) as top_category, 'not_available' as ai from cw",
)

# --- runs
_KPIS = """count(*) * 1.0 as total_records, avg(fcr::int) * 100 as resolution_rate, avg(escalated::int) * 100 as escalation_rate, avg(reopened::int) * 100 as reopen_rate, avg(response_time_minutes) as avg_response_time_minutes,
  avg((sentiment = 'negative')::int) * 100 as negative_percentage, avg((sentiment = 'positive')::int) * 100 as positive_percentage, (count(*) filter (sentiment = 'positive') + 0.5 * count(*) filter (sentiment = 'neutral')) / count(*) * 100 as csat_proxy"""
_HIGHER = ", ".join(text(k) for k, v in compare.METRICS.items() if v)


def _delta_sql(current: str, previous: str) -> str:
    u = lambda where: f"(unpivot (select {_KPIS} from ev where {where}) on {', '.join(compare.METRICS)} into name metric value v)"
    return f"select metric, c.v as current, p.v as previous, c.v - p.v as delta, case when p.v <> 0 then (c.v - p.v) / greatest(0.001, p.v) * 100 when c.v > 0 then 100.0 else 0.0 end as percentage_change, case when c.v = p.v then 'stable' when (c.v > p.v) = (metric in ({_HIGHER})) then 'improved' else 'declined' end as trend from {u(current)} c join {u(previous)} p using (metric)"


def _runs(m):
    """Run b without billing and run a without general support: each lacks a topic of the other."""
    b = m.where("dataset_run_id = 'run_b' and topic_keywords <> 'billing, charge, invoice, payment'")
    a = m.where("dataset_run_id = 'run_a' and topic_keywords <> 'login, password, auth, 2fa'")
    return b, a


_B = "(select * from ev where dataset_run_id = 'run_b' and topic_keywords <> 'billing, charge, invoice, payment')"
_A = "(select * from ev where dataset_run_id = 'run_a' and topic_keywords <> 'login, password, auth, 2fa')"

over_events("g1_kpi_deltas", lambda m: compare.deltas(compare.sides(m, F.col("dataset_run_id") == "run_b", F.col("dataset_run_id") == "run_a")), _delta_sql("dataset_run_id = 'run_b'", "dataset_run_id = 'run_a'"))


def _topics_sql(source: str, side: str) -> str:
    return f"select lower({SQL['cluster']('topic_keywords')}) as key, count(*) as {side}_volume, avg((sentiment = 'negative')::int) * 100 as {side}_negative from {source} group by 1"


over_events(
    "g2_topic_evolution",
    lambda m: compare.topic_evolution(*(compare.topics_by(r) for r in _runs(m))),
    f", c as ({_topics_sql(_B, 'c')}), p as ({_topics_sql(_A, 'p')}), j as (select key, case when p_volume is null then 'new' when c_volume is null then 'subsided' else 'changed' end as status, coalesce(c_volume, 0) as current_volume, coalesce(p_volume, 0) as previous_volume, coalesce(c_volume, 0) - coalesce(p_volume, 0) as volume_delta, coalesce(c_negative, 0) - coalesce(p_negative, 0) as negative_delta from c full join p using (key)) "
    "select *, volume_delta * 100.0 / greatest(1, previous_volume) as volume_change, case when volume_delta > 0 then 'Surging' when volume_delta < 0 then 'Decreasing' else 'Stable' end as direction, row_number() over (order by abs(volume_delta) desc, key) as rank from j",
)


def _sets(m):
    b, a = _runs(m)
    return compare.issue_sets(kpi.topics_batch(b), compare.topics_by(a), compare.flags_of(b))


def _sets_sql(current: str, previous: str, prefix: str) -> str:
    """CTEs that end in {prefix}sets, over ev narrowed to the current run."""
    generic = "lower(topic_keywords) in (" + ", ".join(map(text, W.GENERIC_TOPICS)) + ") or contains(lower(topic_keywords), 'unclassified')"
    body = f"{_BATCH}, {SPIKES_SQL}".replace(" from ev", f" from {current} as x")
    for name in ("tb0", "tb1", "tb", "dv", "sp0", "sp1", "sp"):
        body = re.sub(rf"\b{name}\b", prefix + name, body)
    z = "case when coalesce(spike, 0) > 0 then spike else 2.2 + 0.45 * (rank - 1) + negative_percentage / 50 end"
    return f"""{body}, {prefix}fl as (select category, max(spike_score) as spike from {prefix}sp where spike_score >= 2 and volume >= 3 group by 1),
{prefix}z as (select *, coalesce(spike, 0) > 0 as z_measured, {z} as z_score from {prefix}tb left join {prefix}fl on category = topic_keywords where not ({generic})),
{prefix}t as (select *, least(420, greatest(45, z_score * 42 + (rank - 1) * 24 + negative_percentage * 1.5)) as surge_percentage, case when z_score >= 3 then 'CRITICAL_SURGE' when z_score >= 2 then 'HIGH_VELOCITY_SPIKE' else 'SURGING' end as severity from {prefix}z),
{prefix}k as (select 'emerging' as kind, * from {prefix}t union all select 'recurring', * from {prefix}t where volume >= 10 and topic_keywords in (select topic_keywords from {previous} as y) union all select 'new', * from {prefix}t where topic_keywords not in (select topic_keywords from {previous} as y)),
{prefix}sets as (select kind, place, topic_keywords, volume, z_score, z_measured, surge_percentage, severity from (select *, row_number() over (partition by kind order by pain_score desc, topic_keywords) as place from {prefix}k) where place <= 5)"""


over_events("g3_issue_sets", _sets, f", {_sets_sql(_B, _A, 'c_')} select * from c_sets")
over_events(
    "g3_pillars",
    lambda m: (lambda b, a: compare.pillars(_sets(m), compare.issue_sets(kpi.topics_batch(a), compare.topics_by(b), compare.flags_of(a)), kpi.overall(b), kpi.overall(a)))(*_runs(m)),
    f", {_sets_sql(_B, _A, 'c_')}, {_sets_sql(_A, _B, 'p_')}, n as (select (select count(*) from c_sets where kind = 'emerging') as emerging, (select count(*) from c_sets where kind = 'recurring') as recurring, (select count(*) from p_sets where kind = 'recurring') as before, (select avg(response_time_minutes) from {_B} as x) as now, (select avg(response_time_minutes) from {_A} as x) as was) "
    "select emerging, recurring, case when before > 0 then (recurring - before) * 100.0 / before else 0.0 end as recurring_reduction, (was - now) / greatest(0.1, was) * 100 as speed_boost from n",
)
over_events(
    "g4_recent_against_all",
    lambda m: compare.deltas(compare.sides(m.crossJoin(F.broadcast(m.agg(F.max("created_at").alias("newest")))), F.col("created_at") >= F.col("newest") - F.expr("interval 7 days"), F.lit(True))),
    _delta_sql("created_at >= (select max(created_at) from ev) - interval 7 day", "true"),
)
over_events("g5_previous_signature", lambda m: compare.previous_signature(compare.run_signatures(m), "analyst", "run_b").select("user_id", "dataset_run_id", "total_records", "resolution_rate"), "select 'analyst' as user_id, 'run_a' as dataset_run_id, count(*) as total_records, avg(fcr::int) * 100 as resolution_rate from ev where dataset_run_id = 'run_a'")
over_events(
    "g6_signature_payloads",
    lambda m: compare.signature_payloads(m).select("dataset_run_id", F.get_json_object("payload", "$.total_records").cast("long").alias("total"), F.get_json_object("payload", "$.by_sentiment[0].n").cast("long").alias("negative"), F.get_json_object("payload", "$.by_topic_keywords[1].topic_keywords").alias("topic")),
    "select dataset_run_id, count(*) as total, count(*) filter (sentiment = 'negative') as negative, (select distinct topic_keywords from ev order by 1 limit 1 offset 1) as topic from ev group by 1",
)
over_events("g7_topic_keys", lambda m: compare.topic_keys(*_runs(m)), f"select topic_keywords from {_B} as x union select topic_keywords from {_A} as x")
