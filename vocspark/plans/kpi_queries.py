"""Queries of KPIs, topics, dimensions, rule tables and time series."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vocspark.functions import wordlists as W
from vocspark.operators import conversation, kpi, trends
from vocspark.plans.message_queries import VIEW_SQL
from vocspark.plans.registry import case, over_conversations, over_events, register, text
from vocspark.plans.text_queries import SQL, _any
from vocspark.sources import adapters

_OVERALL = """ov as (select count(*) as total_records, count(*) filter (sentiment = 'negative') as negative_count, count(*) filter (sentiment = 'positive') as positive_count, count(*) filter (sentiment = 'neutral') as neutral_count,
  avg(response_time_minutes) as avg_response_time_minutes, count(*) filter (priority in ('high', 'urgent', 'critical')) as urgent_count, count(*) filter (inbound) as inbound_count, count(*) filter (not inbound) as outbound_count, count(*) filter (fcr) as resolved_count from ev)"""
_OVERALL_RATES = "negative_count * 100.0 / total_records as negative_percentage, positive_count * 100.0 / total_records as positive_percentage, 100.0 - (negative_count + positive_count) * 100.0 / total_records as neutral_percentage, resolved_count * 100.0 / total_records as resolution_rate, urgent_count * 100.0 / total_records as escalation_rate, (positive_count + 0.5 * neutral_count) * 100.0 / total_records as csat_proxy"
over_events(
    "e9_overall_kpi",
    kpi.overall,
    f", {_OVERALL} select *, {_OVERALL_RATES} from ov",
)
over_events("e10_direct_rates", kpi.direct_rates, "select avg(fcr::int) * 100 as fcr_rate, avg(escalated::int) * 100 as escalated_rate, avg(reopened::int) * 100 as reopened_rate, avg(fcr::int) * 100 as resolution_rate, avg(escalated::int) * 100 as escalation_rate, avg(reopened::int) * 100 as reopen_rate from ev")
over_events(
    "e11_sla_tiers",
    kpi.sla_tiers,
    ", tiers(no, tier, status) as (values (0, '< 15m', 'optimal'), (1, '15m - 60m', 'standard'), (2, '1h - 4h', 'warning'), (3, '> 4h', 'critical')), c as (select case when response_time_minutes < 15 then 0 when response_time_minutes < 60 then 1 when response_time_minutes < 240 then 2 when response_time_minutes >= 240 then 3 end as no, count(*) as n from ev group by 1) select tier, status, coalesce(n, 0) as messages, coalesce(n, 0) * 100.0 / greatest((select sum(n) from c where no is not null), 1) as percentage from tiers left join c using (no)",
)
over_events("e12_sentiment_distribution", kpi.sentiment_distribution, "select sentiment, count(*) as messages, count(*) * 100.0 / (select count(*) from ev) as percentage from ev group by 1")
over_events("e13_csat", kpi.csat, "select (count(*) filter (sentiment = 'positive') + 0.5 * count(*) filter (sentiment = 'neutral')) / count(*) * 100 as csat_proxy, 1 + 4 * (0.6 * avg(fcr::int) + 0.4 * (1 - avg((sentiment = 'negative')::int))) as csat_index from ev")
over_events("e14_weighted_sentiment", kpi.weighted_sentiment, "select sum(sentiment_score * coalesce(impressions, 1.0)) / sum(coalesce(impressions, 1.0)) as weighted_sentiment, avg((sentiment = 'negative')::int) * 100 as negative_percentage from ev")
over_events(
    "e15_category_breakdowns",
    lambda m: kpi.category_breakdowns(m.select("sentiment", "priority", "topic_keywords", "company", "product", "region", "resolution_status", "dataset_run_id", "author_id")),
    ", u as (select name as \"column\", value, count(*) as n from (unpivot (select sentiment, priority, topic_keywords, company, product, region, resolution_status, dataset_run_id, author_id from ev) on sentiment, priority, topic_keywords, company, product, region, resolution_status, dataset_run_id, author_id into name name value value) group by 1, 2) select \"column\", value, n from (select *, count(*) over (partition by \"column\") as d, row_number() over (partition by \"column\" order by n desc, value) as r from u) where d <= 50 and r <= 10",
)
over_events(
    "e16_dimension_breakdown",
    kpi.dimension_breakdown,
    ", g as (" + " union all ".join(f"select '{c}' as dimension, {c} as value, count(*) as total, avg((sentiment = 'negative')::int) * 100 as negative_percentage, avg(response_time_minutes) as avg_response, avg(fcr::int) * 100 as resolution_rate from ev group by {c}" for c in ("region", "company", "product")) + ") select * from (select *, row_number() over (partition by dimension order by total desc, value) as rank from g where not (dimension = 'company' and regexp_full_match(value, '[0-9]+'))) where rank <= 10",
)
register(
    "e16_star_join_breakdown",
    lambda spark, d: (lambda o, c, n, r: o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"]).groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("double")).alias("total")))(*(adapters.read(spark, d, t) for t in ("orders", "customer", "nation", "region"))),
    "select r_name, n_name, count(*) as orders, sum(cast(o_totalprice as double)) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
)
over_events("e17_company_list", kpi.company_list, "select company, count(*) as total, avg((sentiment = 'negative')::int) * 100 as negative_percentage, avg((sentiment = 'positive')::int) * 100 as positive_percentage, avg(response_time_minutes) as avg_response, (select t.topic_keywords from ev t where t.company = ev.company group by 1 order by count(*) desc, 1 limit 1) as top_topic from ev group by 1 order by total desc, company limit 50")
_LISTS = ("years", "companies", "products", "regions")
over_events("e18_spans", lambda m: kpi.spans(m).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in _LISTS}), "select strftime(min(created_at), '%Y-%m-%d') as first_day, strftime(max(created_at), '%Y-%m-%d') as last_day, array_to_string(list_sort(list(distinct cast(year(created_at) as integer))), ',') as years, array_to_string(list_sort(list(distinct company)), ',') as companies, array_to_string(list_sort(list(distinct product)), ',') as products, array_to_string(list_sort(list(distinct region)), ',') as regions from ev")

_GENERIC = "lower(topic_keywords) in (" + ", ".join(map(text, W.GENERIC_TOPICS)) + ")"
_LIVE = f"""tl0 as (select topic_keywords, count(*) as volume, count(*) filter (sentiment = 'negative') as negative_complaints, avg(response_time_minutes) as avg_response_time from ev group by 1 order by 2 desc, 1 limit 10),
tl1 as (select *, {SQL['cluster']('topic_keywords')} as cluster_name, negative_complaints * 100.0 / volume as negative_percentage, volume * (negative_complaints * 1.0 / volume + 0.2) as pain_score from tl0),
tl as (select *, pain_score + greatest(0, avg_response_time - 60) / 20 as discovery_pain_score, row_number() over (order by {_GENERIC}, pain_score desc, topic_keywords) as rank from tl1)"""
_BATCH = f"""tb0 as (select topic_keywords, count(*) as volume, count(*) filter (sentiment = 'negative') as negative_complaints, count(*) filter (escalated) as escalation_cases, avg(response_time_minutes) as avg_response_time, avg(fcr::int) * 100 as resolution_rate from ev group by 1),
tb1 as (select *, {SQL['cluster']('topic_keywords')} as cluster_name, negative_complaints * 100.0 / volume as negative_percentage, volume * (negative_complaints * 1.0 / volume + 0.5 * escalation_cases / volume + 0.2) * case when {_GENERIC} then 0.05 else 1 end as pain_score, negative_complaints * 100.0 * (1 + avg_response_time / 100) as documented_pain from tb0),
tb as (select *, row_number() over (order by {_GENERIC}, pain_score desc, topic_keywords) as rank from tb1)"""
over_events("e19_topics_live", kpi.topics_live, f", {_LIVE} select * from tl")
over_events("e20_topics_batch", kpi.topics_batch, f", {_BATCH} select * from tb where rank <= 10")
over_events(
    "e21_topic_samples",
    lambda m: kpi.topic_samples(m).select("topic_keywords", F.size("samples").alias("n"), F.array_join(F.transform("samples", lambda s: s["tweet_id"].cast("string")), ",").alias("ids"), F.md5(F.array_join(F.transform("samples", lambda s: s["text"]), "|")).alias("texts_md5")),
    ", s as (select *, row_number() over (partition by topic_keywords order by tweet_id) as n from ev) select topic_keywords, cast(count(*) as integer) as n, string_agg(tweet_id, ',' order by n) as ids, md5(string_agg(text, '|' order by n)) as texts_md5 from s where n <= 3 group by 1",
)
_RATE = "escalation_cases * 100.0 / volume"
over_events(
    "e22_cluster_stats",
    lambda m: kpi.cluster_stats(kpi.topics_batch(m)),
    f", {_BATCH} select rank, topic_keywords, cluster_name, {SQL['department']('cluster_name')} as department, case when pain_score >= 75 or {_RATE} >= 25 then 'P0 (Critical Urgent)' when pain_score >= 45 or negative_percentage >= 30 then 'P1 (High Priority)' when pain_score >= 20 or {_RATE} >= 10 then 'P2 (Medium Priority)' else 'P3 (Standard Review)' end as priority_tier, volume as total_cases, negative_complaints as complaints, {_RATE} as escalation_rate, pain_score from tb where rank <= 12",
)


def _field(rules, i: int, low: str) -> str:
    return case([(_any(low, row[0]), text(row[i])) for row in rules[:-1]], text(rules[-1][i]))


def _tenth(value: str) -> str:
    return f"printf('%.1f', round({value}, 1))"


def _sentence(sentence: str, **values: str) -> str:
    """SQL of a sentence with its {names} replaced by values."""
    return " || ".join(values[x] if i % 2 else text(x) for i, x in enumerate(re.split(r"\{(\w+)\}", sentence)))


_VOLUME = "format('{:,}', volume)"
_LOW = "lower(topic_keywords || ' ' || cluster_name)"
over_events(
    "e23_recommendations",
    lambda m: kpi.recommendations(kpi.topics_live(m), kpi.overall(m)),
    f", {_LIVE}, {_OVERALL}, r as (select 0 as no, {', '.join(text(x) + ' as ' + n for x, n in zip(kpi.SLA_ALERT[:3], ('owner', 'impact', 'issue')))}, {_sentence(kpi.WHY_SLOW, response=_tenth('avg_response_time_minutes'))} as why, {text(kpi.SLA_ALERT[3])} as action from ov where avg_response_time_minutes > 60 union all select rank, {_field(kpi.RECOMMENDATIONS, 1, _LOW)}, {_field(kpi.RECOMMENDATIONS, 2, _LOW)}, cluster_name, {_sentence(kpi.WHY_TOPIC, volume=_VOLUME, negative=_tenth('negative_percentage'))}, {_field(kpi.RECOMMENDATIONS, 3, _LOW)} from tl where rank <= 5) select owner, impact, issue, why, action, rank from (select *, row_number() over (order by no) as rank from r) where rank <= 6",
)
_SAID = {"volume": _VOLUME, "negative": _tenth("negative_percentage"), "response": _tenth("avg_response_time"), "average": _tenth("av"), "reopen": _tenth("ro")}
_CAUSE = ", ".join(
    case([(_any("lower(topic_keywords)", words), _sentence(row[i], **_SAID)) for words, *row in kpi.ROOT_CAUSES] + [("avg_response_time > greatest(60, av * 1.15)", _sentence(kpi.SLOW_CAUSE[i], **_SAID)), ("ro > 15", _sentence(kpi.REOPEN_CAUSE[i], **_SAID))], _sentence(kpi.OTHER_CAUSE[i], **_SAID)) + f" as {name}"
    for i, name in enumerate(("likely_root_cause", "owner", "evidence", "recommended_fix"))
)
over_events(
    "e24_root_causes",
    lambda m: (lambda t: kpi.root_causes(t, F.col("av"), F.col("ro")))(kpi.topics_batch(m).crossJoin(F.broadcast(m.agg(F.avg("response_time_minutes").alias("av"), (F.avg(F.col("reopened").cast("int")) * 100).alias("ro"))))),
    f", {_BATCH}, k as (select avg(response_time_minutes) as av, avg(reopened::int) * 100 as ro from ev), rc as (select topic_keywords, cluster_name, {_CAUSE}, volume * (negative_percentage / 100 + 0.2) + escalation_cases * 0.5 + greatest(0, avg_response_time - 60) / 20 as severity_score, volume from tb cross join k where rank <= 8) select * from (select *, row_number() over (order by severity_score desc, topic_keywords) as severity_rank from rc) where severity_rank <= 6",
)
over_events("e25_priorities", lambda m: kpi.priorities(kpi.topics_batch(m)), f", {_BATCH} select topic_keywords, volume, negative_complaints, case when negative_complaints > 5 or escalation_cases > 3 then 'High' when volume > 8 then 'Medium' else 'Normal' end as priority from tb where rank <= 10")
over_events("e26_escalation_multiplier", kpi.escalation_multiplier, f", {_OVERALL} select greatest(1.0, (negative_count + urgent_count) * 10.0 / total_records) as multiplier from ov")
over_events("e27_warehouse_kpis", kpi.warehouse_kpis, "select topic_keywords, count(*) as volume, avg(coalesce(response_time_minutes, 0)) as avg_response, count(response_time_minutes) * 1.0 / count(*) as response_coverage, cast(null as double) as readable_flags from ev group by 1 order by 2 desc, 1 limit 10")
over_events("e36_quadrants", lambda m: kpi.quadrants(kpi.topics_batch(m)), f", {_BATCH}, q as (select *, row_number() over (order by volume, topic_keywords) as n, count(*) over () as c from tb where rank <= 10), md as (select volume as mv from q where n = c // 2 + 1) select topic_keywords, volume, negative_percentage, case when volume >= mv and negative_percentage >= 24 then 'critical' when negative_percentage >= 24 then 'emerging' when volume >= mv then 'routine' else 'baseline' end as quadrant from q cross join md")
_TOPICS = [*adapters.EVENT_TOPICS.values(), "General Support"]
over_events("e37_region_topic_matrix", lambda m: kpi.region_topic_matrix(m, _TOPICS), "select region, " + ", ".join(f"count(*) filter (topic_keywords = {text(t)}) as t{i}_volume, avg(response_time_minutes) filter (topic_keywords = {text(t)}) as t{i}_response" for i, t in enumerate(_TOPICS)) + " from ev group by 1")
over_events("e38_quality_scores", kpi.quality_scores, ", s as (select avg(fcr::int) * 100 as fcr_score, avg((response_time_minutes < 60)::int) * 100 as sla_score, 100 - avg(escalated::int) * 100 as escalation_score, 100 - avg(reopened::int) * 100 as reopen_score, 100 - avg((sentiment = 'negative')::int) * 100 as sentiment_score, greatest(0, 100 - avg(response_time_minutes) / 240 * 100) as velocity_score from ev) select *, (fcr_score + sla_score + escalation_score + reopen_score + sentiment_score + velocity_score) / 6 as overall_score from s")

# --- time series
_PERIOD = {"month": "strftime(created_at, '%Y-%m')", "day": "strftime(created_at, '%Y-%m-%d')", "hour": "strftime(created_at, '%Y-%m-%d %H:00')", "weekly": "strftime(date_trunc('week', created_at), '%Y-%m-%d')"}
_TONES = "count(*) as total, count(*) filter (sentiment = 'positive') as positive, count(*) filter (sentiment = 'neutral') as neutral, count(*) filter (sentiment = 'negative') as negative"
for _g in ("month", "day", "hour"):
    over_events(f"f1_live_trend_{_g}", lambda m, g=_g: trends.live(m, g), f"select {_PERIOD[_g]} as period, {_TONES}, avg((priority in ('high', 'urgent', 'critical'))::int) * 100 as escalation, case when count(*) filter (inbound) > 0 then least(100.0, count(*) filter (not inbound) * 100.0 / count(*) filter (inbound)) else 0 end as resolution from ev group by 1")
for _g, _p in (("daily", "day"), ("weekly", "weekly"), ("monthly", "month")):
    _flag = "case when avg(fcr::int) > 0 then avg(fcr::int) * 100 else avg((resolution_status in ('resolved', 'closed', 'complete', 'completed', 'solved'))::int) * 100 end as resolution"
    over_events(f"f2_batch_trend_{_g}", lambda m, g=_g: trends.batch(m, g), f"select {_PERIOD[_p]} as period, {_TONES}, avg(escalated::int) * 100 as escalation, {_flag} from ev group by 1")
    over_events(f"f3_multi_period_{_g}", lambda m, g=_g: trends.multi_period(m, g), f"select {_PERIOD[_p]} as period, count(*) as total, {_flag}, avg(response_time_minutes) as avg_response, count(*) filter (sentiment = 'negative') as negative, count(*) filter (sentiment = 'positive') as positive, avg((sentiment = 'negative')::int) * 100 as negative_percentage, avg((sentiment = 'positive')::int) * 100 as positive_percentage from ev group by 1")
SPIKES_SQL = """dv as (select topic_keywords as category, cast(created_at as date) as date, count(*) as volume from ev group by 1, 2),
sp0 as (select *, coalesce(avg(volume) over w, 0) as rolling_mean, stddev_samp(volume) over w as sd from dv window w as (partition by category order by date rows between 3 preceding and 1 preceding)),
sp1 as (select category, date, volume, rolling_mean, case when coalesce(sd, 0) = 0 then 1.0 else sd end as rolling_std from sp0),
sp as (select *, (volume - rolling_mean) / rolling_std as spike_score from sp1)"""
over_events("f4_spikes", lambda m: trends.spikes(trends.daily_volumes(m)).withColumn("date", F.col("date").cast("string")), f", {SPIKES_SQL} select * replace (cast(date as varchar) as date), spike_score >= 2 and volume >= 3 as spike_detected from sp")
over_events("f5_spike_flags", trends.spike_flags, f", {SPIKES_SQL} select category, max(spike_score) as spike_score from sp where spike_score >= 2 and volume >= 3 group by 1")
_rows = lambda m: conversation.batch_rows(adapters.threaded(m))
over_conversations("f6_daily_issue_growth", lambda m: conversation.daily_issues(conversation.label_issues(adapters.threaded(m))).select("issue_category", F.col("date").cast("string").alias("date"), "daily_volume", "issue_growth_rate", "spike_score", "spike_detected"), f", {VIEW_SQL} select issue_category, cast(d as varchar) as date, daily_volume, issue_growth_rate, spike_score, coalesce(spike_score >= 2, false) as spike_detected from ds")
over_conversations("f7_new_and_emerging", lambda m: conversation.issue_columns(_rows(m)).select("tweet_id", "new_issue", "emerging_issue"), f", {VIEW_SQL} select tweet_id, new_issue, emerging_issue from b5")
over_conversations(
    "f8_escalation_spikes",
    lambda m: trends.escalation_spikes(conversation.view(_rows(m)), min_conversations=2).withColumn("date", F.col("date").cast("string")),
    f", {VIEW_SQL}, ed as (select date, count(*) as conversations, avg(escalated::int) * 100 as rate from cw group by 1), ez as (select *, avg(rate) over w as m, stddev_samp(rate) over w as s, count(rate) over w as c from ed window w as (order by date rows between 7 preceding and 1 preceding)), e1 as (select date, conversations, rate, case when c >= 3 then m end as mean, case when c >= 3 then s end as std from ez) select cast(date as varchar) as date, conversations, rate, mean, std, (rate - mean) / nullif(std, 0) as z_score, coalesce(conversations >= 2 and (rate - mean) / nullif(std, 0) >= 2, false) as spike from e1",
)
over_conversations(
    "f8_latest_day",
    lambda m: trends.latest(trends.escalation_spikes(conversation.view(_rows(m)), min_conversations=2)).select(F.col("date").cast("string").alias("date"), "conversations", "rate"),
    f", {VIEW_SQL} select cast(date as varchar) as date, count(*) as conversations, avg(escalated::int) * 100 as rate from cw group by 1 order by 1 desc limit 1",
)
_CD = f"{VIEW_SQL}, cd as (select issue_category as category, date, count(distinct conversation_id) as conversations from cw group by 1, 2)"
over_conversations("f9_emerging_issues", lambda m: trends.emerging_issues(conversation.view(_rows(m))).withColumn("date", F.col("date").cast("string")), f", {_CD} select category, cast(date as varchar) as date, conversations, previous, growth from (select *, (conversations - previous) * 100.0 / previous as growth from (select *, lag(conversations) over (partition by category order by date) as previous, row_number() over (partition by category order by date desc) as r from cd)) where r = 1 and growth >= 20")
over_events(
    "f9_growth_by_topic",
    lambda m: trends.emerging_issues(m.withColumn("date", F.to_date("created_at")), "topic_keywords", -100.0).withColumn("date", F.col("date").cast("string")),
    ", cd as (select topic_keywords as category, cast(created_at as date) as date, count(distinct conversation_id) as conversations from ev group by 1, 2), g as (select *, lag(conversations) over (partition by category order by date) as previous, row_number() over (partition by category order by date desc) as r from cd) select category, cast(date as varchar) as date, conversations, previous, (conversations - previous) * 100.0 / previous as growth from g where r = 1 and (conversations - previous) * 100.0 / previous >= -100",
)
over_conversations("f10_halves", lambda m: trends.halves(conversation.view(_rows(m))), f", {_CD} select *, (second_half - first_half) * 100.0 / first_half as change, case when (second_half - first_half) * 100.0 / first_half > 5 then 'increasing' when (second_half - first_half) * 100.0 / first_half < -5 then 'decreasing' else 'stable' end as direction from (select category, avg(conversations) filter (n <= days // 2) as first_half, avg(conversations) filter (n > days // 2) as second_half from (select *, row_number() over (partition by category order by date) as n, count(*) over (partition by category) as days from cd) where days >= 2 group by 1)")
over_events(
    "f11_hourly_zscore",
    lambda m: trends.hourly_zscore(m).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm")),
    ", h as (select date_trunc('hour', created_at) as hour, count(*) as volume from ev group by 1), z as (select *, avg(volume) over w as m, stddev_samp(volume) over w as s from h window w as (order by hour range between interval 24 hour preceding and current row)) select strftime(hour, '%Y-%m-%d %H:%M') as hour, volume, (volume - m) / nullif(s, 0) as z_score, coalesce((volume - m) / nullif(s, 0) > 2.5, false) as alert from z",
)
over_events("f12_ranks", lambda m: kpi.topics_batch(m).select("topic_keywords", "rank", F.dense_rank().over(_by_volume()).alias("volume_rank")), f", {_BATCH} select topic_keywords, rank, dense_rank() over (order by volume desc) as volume_rank from tb where rank <= 10")


def _by_volume():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("volume"))
