"""Queries of labels, filters, threads and conversations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vocspark.functions import labels
from vocspark.operators import conversation, filters, threads
from vocspark.plans.registry import over_conversations, over_events, register, text
from vocspark.plans.text_queries import SQL
from vocspark.sources import adapters

# --- labels
over_events("b2_normalise", lambda m: labels.normalise(m.select("tweet_id", F.col("sentiment").alias("sentiment_label"), F.col("topic_keywords").alias("topic"), F.col("response_time_minutes").cast("string").alias("response_time")), "run_x", "user_y").select("tweet_id", "sentiment", "topic_keywords", "response_time_minutes", "dataset_run_id", "user_id"), "select tweet_id, sentiment, topic_keywords, response_time_minutes, 'run_x' as dataset_run_id, 'user_y' as user_id from ev")
over_events(
    "b3_company",
    lambda m: m.select("tweet_id", labels.company("company", "author_id", "inbound", "text").alias("company")),
    r"select tweet_id, coalesce(case when company <> '' and not regexp_full_match(company, '[0-9]+') then company end, case when not inbound then author_id end, nullif(regexp_extract(text, '@([\p{L}\p{N}_]+)', 1), ''), 'General Enterprise') as company from ev",
)
over_events(
    "b4_coerce",
    lambda m: m.select("tweet_id", F.unix_timestamp(labels.timestamp(F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy"))).alias("long_form"), F.unix_timestamp(labels.timestamp(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("iso"), labels.timestamp(F.lit("not a date")).isNull().alias("bad_is_null")),
    "select tweet_id, cast(floor(epoch(created_at)) as bigint) as long_form, cast(floor(epoch(created_at)) as bigint) as iso, true as bad_is_null from ev",
)
over_events("b5_flags", lambda m: m.select("tweet_id", labels.flag("resolution_status").alias("said"), labels.flag(F.col("fcr").cast("string")).alias("fcr"), labels.flag_or_null("resolution_status").alias("strict")), "select tweet_id, resolution_status in ('true', '1', 'yes', 'y', 'resolved', 'closed') as said, fcr, cast(null as boolean) as strict from ev")
over_events("b7_sentiment_label", lambda m: m.select("tweet_id", labels.sentiment(F.upper("sentiment")).alias("live"), labels.sentiment_alias(F.substring("sentiment", 1, 3)).alias("alias")), "select tweet_id, sentiment as live, sentiment as alias from ev")
over_events("b8_topic_label", lambda m: m.select("tweet_id", labels.topic(F.when(F.col("tweet_id") % 3 == 0, "other").when(F.col("tweet_id") % 3 == 1, F.col("topic_keywords"))).alias("topic")), "select tweet_id, case when tweet_id % 3 = 1 then topic_keywords else 'General Support' end as topic from ev")
over_events(
    "b9_region_bucket",
    lambda m: m.select("author_id", labels.bucket("author_id").alias("bucket"), labels.region("author_id").alias("region")).distinct(),
    "select distinct author_id, b as bucket, case when b < 52 then 'North America' when b < 74 then 'Europe' when b < 88 then 'Asia Pacific' when b < 95 then 'Latin America' else 'Middle East & Africa' end as region from (select author_id, cast(('0x' || substr(md5(author_id), 1, 8)) as bigint) % 100 as b from ev)",
)
over_events("b10_priority_rule", lambda m: m.select("tweet_id", labels.priority_of("response_time_minutes", "sentiment").alias("priority"), F.least("response_time_minutes", F.lit(1440.0)).alias("capped")), "select tweet_id, case when response_time_minutes > 120 or sentiment = 'negative' then 'urgent' else 'normal' end as priority, least(response_time_minutes, 1440.0) as capped from ev")
over_events("b15_region_title", lambda m: m.groupBy(labels.region_title("region").alias("title")).agg(F.count("*").alias("messages")), "select case region when 'north america' then 'North America' when 'europe' then 'Europe' when 'asia' then 'Asia Pacific' when 'latam' then 'Latin America' else 'Middle East & Africa' end as title, count(*) as messages from ev group by 1")

# --- filters
_IDS = lambda m: m.select("tweet_id")
for _name, _kw, _where in (
    ("run", {"run": "run_a"}, "dataset_run_id = 'run_a'"),
    ("month", {"year": 2024, "month": 1}, "created_at >= timestamp '2024-01-01' and created_at < timestamp '2024-02-01'"),
    ("month_only", {"month": 1, "priority": "Urgent"}, "month(created_at) = 1 and priority = 'urgent'"),
    ("years", {"years": (2023, 2024), "sentiment": "NEGATIVE"}, "year(created_at) in (2023, 2024) and sentiment = 'negative'"),
    ("dates", {"dates": (date(2024, 1, 5), date(2024, 1, 9)), "company": "acme"}, "created_at >= timestamp '2024-01-05' and created_at < timestamp '2024-01-10' and company = 'Acme'"),
    ("topic_region", {"topic": "Billing", "region": "EU", "product": "PRODUCT_3"}, "contains(topic_keywords, 'billing') and region = 'europe' and product = 'product_3'"),
):
    over_events(f"b11_slice_{_name}", lambda m, kw=_kw: m.where(filters.slice_filter(**kw)).select("tweet_id"), f"select tweet_id from ev where {_where}")
over_events("b12_recent_7_days", lambda m: _IDS(filters.recent(m, 7)), "select tweet_id from ev where created_at >= (select max(created_at) from ev) - interval 7 day")
over_events("b13_listed_companies", lambda m: filters.listed_companies(m).groupBy("company").agg(F.count("*").alias("messages")), "select company, count(*) as messages from ev where not regexp_full_match(company, '[0-9]+') group by 1")
over_conversations(
    "b14_keep_or_all",
    lambda m: filters.keep_or_all(adapters.threaded(m), F.col("inbound") & (F.col("sentiment") == "negative"), "conversation_id").select("conversation_id", "tweet_id"),
    "select conversation_id, tweet_id from (select *, max(cast(inbound and sentiment = 'negative' as integer)) over (partition by conversation_id) as any_kept from cv) where any_kept = 0 or (inbound and sentiment = 'negative')",
)

# --- threads
over_conversations("d1_conversation_roots", lambda m: threads.conversation_roots(m).select("tweet_id", "conversation_id"), "select tweet_id, conversation_id from cv")
_RESP = "(epoch_us(r.created_at) - epoch_us(m.created_at)) / 6e7"
over_conversations(
    "d2_response_times",
    lambda m: threads.response_times(m).select("tweet_id", "response_time_minutes"),
    f"select m.tweet_id, case when {_RESP} >= 0 then {_RESP} end as response_time_minutes from cv m left join cv r on m.inbound and r.tweet_id = try_cast(m.response_tweet_id as bigint)",
)
over_conversations(
    "d3_group_counts",
    lambda m: threads.with_group_counts(conversation.label_issues(m)).select("tweet_id", "issue_category", "issue_volume", "category_sentiment_score"),
    f"select tweet_id, c as issue_category, count(*) over (partition by c) as issue_volume, avg(sentiment_score) over (partition by c) as category_sentiment_score from (select *, {SQL['category'](SQL['simple']('text'))} as c from cv)",
)
over_conversations(
    "d4_first_replies",
    lambda m: threads.first_replies(adapters.threaded(m)).select("tweet_id", F.md5("company_response").alias("reply_md5")),
    "select m.tweet_id, md5(r.text) as reply_md5 from cv m left join (select conversation_id, text from (select *, row_number() over (partition by conversation_id order by created_at, tweet_id) as i from cv where not inbound) where i = 1) r using (conversation_id) where m.inbound",
)

# --- conversation states
_STATES = """st0 as (select *, lag(inbound) over w as before, lead(tweet_id) over w as after_id from cv window w as (partition by conversation_id order by created_at, tweet_id)),
st as (select conversation_id, count(*) as messages_count, count(*) filter (inbound) as customer_messages_count, count(*) filter (not inbound) as agent_messages_count,
  coalesce(bool_or(inbound and coalesce(not before, false)), false) as reopened, coalesce(bool_or(not inbound and after_id is null), false) as resolved, coalesce(bool_or(inbound and (priority in ('high', 'urgent', 'critical') or sentiment = 'negative')), false) as escalated from st0 group by 1)"""
over_conversations("e1_conversation_states", lambda m: conversation.states(adapters.threaded(m)), f", {_STATES} select * from st")
_HANDLES = [h for h, _ in labels.COMPANY_OF_HANDLE] + ["someone_else"]
_HANDLE_SQL = f"case tweet_id % {len(_HANDLES)} " + " ".join(f"when {i} then {text(h)}" for i, h in enumerate(_HANDLES)) + " end"
over_events(
    "b9_handle_company_region",
    lambda m: m.withColumn("handle", F.element_at(F.array(*map(F.lit, _HANDLES)), (F.col("tweet_id") % len(_HANDLES) + 1).cast("int"))).groupBy("handle", labels.company_of_handle("handle").alias("company"), labels.region("handle").alias("region")).agg(F.count("*").alias("messages")),
    f", h as (select {_HANDLE_SQL} as handle from ev), b as (select handle, cast(('0x' || substr(md5(handle), 1, 8)) as bigint) % 100 as b from h) select handle, case handle " + " ".join(f"when {text(h)} then {text(c)}" for h, c in labels.COMPANY_OF_HANDLE) + f" else {text(labels.OTHER_COMPANY)} end as company, case "
    + " ".join(f"when handle in ({', '.join(map(text, hs))}) then {text(r)}" for r, hs in labels.REGION_OF_HANDLES) + " when b < 52 then 'North America' when b < 74 then 'Europe' when b < 88 then 'Asia Pacific' when b < 95 then 'Latin America' else 'Middle East & Africa' end as region, count(*) as messages from b group by 1, 2, 3",
)
over_events(
    "e2_rates_without_ids",
    lambda m: conversation.rates(conversation.states(m.drop("conversation_id"))),
    "select cast(1 as bigint) as total_conversations, bool_or(not inbound)::int * 100.0 as resolution_rate, bool_or(inbound and (priority in ('high', 'urgent', 'critical') or sentiment = 'negative'))::int * 100.0 as escalation_rate, 0.0::double as reopen_rate, 'success' as status from ev",
)
over_conversations("e2_conversation_rates", lambda m: conversation.rates(conversation.states(adapters.threaded(m))), f", {_STATES} select count(*) as total_conversations, avg(resolved::int) * 100 as resolution_rate, avg(escalated::int) * 100 as escalation_rate, avg(reopened::int) * 100 as reopen_rate, 'success' as status from st")

# --- batch layer
_ROWS = f"""b0 as (select m.*, {_RESP} as response_time_minutes, {SQL['simple']('m.text')} as clean_text from cv m left join cv r on m.inbound and r.tweet_id = try_cast(m.response_tweet_id as bigint)),
b1 as (select *, {SQL['category']('clean_text')} as issue_category, cast(created_at as date) as d from b0 where length(clean_text) > 0),
b2 as (select *, {SQL['subcategory']('clean_text', 'issue_category')} as issue_subcategory from b1),
rep as (select author_id, issue_category, count(*) as n from b2 where inbound group by 1, 2),
b3 as (select b2.*, coalesce(rep.n > 1, false) as recurring_issue, inbound and coalesce(not lag(inbound) over (partition by conversation_id order by created_at, tweet_id), false) as reopened_proxy,
  inbound and priority = 'high' and sentiment = 'negative' and coalesce(rep.n > 1, false) as escalation_proxy, not inbound and created_at = max(created_at) over (partition by conversation_id) as resolution_proxy from b2 left join rep using (author_id, issue_category)),
day as (select issue_category, d, count(*) as daily_volume from b2 group by 1, 2),
dw as (select *, lag(daily_volume) over w as previous_volume, avg(daily_volume) over (partition by issue_category order by d rows between 3 preceding and 1 preceding) as rm, stddev_samp(daily_volume) over (partition by issue_category order by d rows between 3 preceding and 1 preceding) as rs from day window w as (partition by issue_category order by d)),
ds as (select issue_category, d, daily_volume, case when previous_volume > 0 then (daily_volume - previous_volume) * 100.0 / previous_volume end as issue_growth_rate, (daily_volume - rm) / case when rs <> 0 then rs end as spike_score from dw),
b4 as (select b3.*, issue_growth_rate, spike_score, coalesce(spike_score >= 2, false) as spike_detected, count(*) over (partition by b3.issue_category) as issue_volume, avg(sentiment_score) over (partition by b3.issue_category) as category_sentiment_score, b3.d = min(b3.d) over (partition by b3.issue_category) as new_issue from b3 left join ds on b3.issue_category = ds.issue_category and b3.d = ds.d),
b5 as (select *, coalesce(issue_growth_rate >= 50 and issue_volume >= 2, false) as emerging_issue from b4),
cs as (select conversation_id, count(tweet_id) as conversation_message_count, count(*) filter (inbound) as customer_message_count, count(*) filter (not inbound) as agent_message_count, avg(sentiment_score) as avg_sentiment, count(*) filter (sentiment = 'negative') as negative_message_count,
  count(*) filter (inbound and response_tweet_id is not null) as response_count, avg(response_time_minutes) as avg_response_time_minutes, count(*) filter (priority = 'high') as high_priority_count, bool_or(resolution_proxy) as resolved_proxy, bool_or(escalation_proxy) as escalated_proxy, bool_or(reopened_proxy) as reopened_proxy_conversation from b3 group by 1),
gk as (select (select count(*) from b3 where inbound) as total_customer_messages, (select count(*) from cs) as total_conversations, (select count(*) filter (response_tweet_id is not null) * 100.0 / count(*) from b3 where inbound) as response_rate,
  (select avg(response_time_minutes) from b3 where inbound) as avg_response_time_minutes, (select avg(resolved_proxy::int) * 100 from cs) as resolution_rate_proxy, (select avg(escalated_proxy::int) * 100 from cs) as escalation_rate_proxy, (select avg(reopened_proxy_conversation::int) * 100 from cs) as reopen_rate_proxy, (select avg(sentiment_score) from b3) as average_sentiment)"""
_rows = lambda m: conversation.batch_rows(adapters.threaded(m))
over_conversations("e3_batch_stats", lambda m: conversation.stats(_rows(m)), f", {_ROWS} select conversation_id, conversation_message_count, customer_message_count, agent_message_count, avg_sentiment, negative_message_count, response_count, avg_response_time_minutes, high_priority_count, case when customer_message_count > 0 then response_count * 100.0 / customer_message_count end as response_rate from cs")
over_conversations(
    "e4_batch_proxies",
    lambda m: _rows(m).select("tweet_id", "recurring_issue", "reopened_proxy", "recurring_after_solution", "escalation_proxy", "resolution_proxy", "resolved_proxy", "escalated_proxy", "reopened_proxy_conversation"),
    f", {_ROWS} select tweet_id, recurring_issue, reopened_proxy, reopened_proxy and recurring_issue as recurring_after_solution, escalation_proxy, resolution_proxy, resolved_proxy, escalated_proxy, reopened_proxy_conversation from b3 join cs using (conversation_id)",
)
over_conversations("e5_global_kpis", lambda m: conversation.global_kpis(_rows(m)), f", {_ROWS} select * from gk")
_SAME = "tweet_id author_id inbound response_tweet_id in_response_to_tweet_id sentiment confidence priority sentiment_score conversation_id issue_category issue_subcategory issue_volume issue_growth_rate new_issue recurring_issue emerging_issue spike_detected spike_score response_time_minutes conversation_message_count customer_message_count agent_message_count avg_sentiment negative_message_count response_count resolved_proxy escalation_proxy reopened_proxy category_sentiment_score".split()
over_conversations(
    "e6_wide_rows",
    lambda m: conversation.wide(adapters.threaded(m)).drop("created_at", "text", "avg_response_time_minutes", "response_rate", "topic_probability"),
    f", {_ROWS} select {', '.join('b5.' + c if c in ('conversation_id', 'response_time_minutes') else c for c in _SAME)}, -1 as topic_id, 'General' as topic_keywords, issue_category || ' - ' || issue_subcategory as customer_pain_point, reopened_proxy and recurring_issue as recurring_after_solution, inbound and response_tweet_id is not null as response_exists, "
    "total_customer_messages, total_conversations, gk.response_rate as overall_response_rate, gk.avg_response_time_minutes as overall_avg_response_time_minutes, resolution_rate_proxy as overall_resolution_rate_proxy, escalation_rate_proxy as overall_escalation_rate_proxy, reopen_rate_proxy as overall_reopen_rate_proxy, average_sentiment as overall_average_sentiment from b5 join cs on b5.conversation_id = cs.conversation_id cross join gk",
)
over_conversations(
    "e7_issue_summary",
    lambda m: conversation.issue_summary(adapters.threaded(m)),
    f", {_ROWS} select *, dense_rank() over (order by issue_volume desc) as pain_point_rank, issue_volume * avg_sentiment as sentiment_impact from (select issue_category, issue_subcategory, count(tweet_id) as issue_volume, avg(sentiment_score) as avg_sentiment, avg(confidence) as avg_confidence, count(*) filter (priority = 'high') as high_priority_volume, count(*) filter (new_issue) as new_issue_count, count(*) filter (recurring_issue) as recurring_issue_count, count(*) filter (emerging_issue) as emerging_issue_count, count(*) filter (spike_detected) as spike_count, avg(response_time_minutes) as avg_response_time from b5 where inbound group by 1, 2)",
)
VIEW_SQL = f"""{_ROWS},
lab as (select conversation_id, f, v, row_number() over (partition by conversation_id, f order by count(*) desc, v) as i from (unpivot (select conversation_id, sentiment, issue_category, issue_subcategory, issue_category || ' - ' || issue_subcategory as pain_point from b3) on sentiment, issue_category, issue_subcategory, pain_point into name f value v) group by 1, 2, 3),
vw as (select b3.conversation_id, arg_min(author_id, (created_at, tweet_id)) filter (inbound) as customer_id, min(created_at) as started, max(created_at) as ended, count(*) as messages, count(*) filter (inbound) as customer_messages, bool_or(resolution_proxy) as resolved, bool_or(escalation_proxy) as escalated, bool_or(reopened_proxy) as reopened,
  bool_or(reopened_proxy and recurring_issue) as recurring_after_solution, avg(response_time_minutes) as avg_response_minutes, case max(case priority when 'high' then 3 when 'medium' then 2 when 'normal' then 1 else 0 end) when 3 then 'high' when 2 then 'medium' when 1 then 'normal' else 'unknown' end as priority,
  (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 6e7 as duration_minutes, cast(min(created_at) as date) as date from b3 group by 1),
cw as (select vw.*, s.v as sentiment, c.v as issue_category, u.v as issue_subcategory, p.v as pain_point from vw join lab s on s.conversation_id = vw.conversation_id and s.f = 'sentiment' and s.i = 1 join lab c on c.conversation_id = vw.conversation_id and c.f = 'issue_category' and c.i = 1 join lab u on u.conversation_id = vw.conversation_id and u.f = 'issue_subcategory' and u.i = 1 join lab p on p.conversation_id = vw.conversation_id and p.f = 'pain_point' and p.i = 1)"""
over_conversations(
    "e8_conversation_view",
    lambda m: conversation.view(_rows(m)).withColumns({"started": F.unix_timestamp("started"), "ended": F.unix_timestamp("ended"), "date": F.col("date").cast("string")}),
    f", {VIEW_SQL} select * replace (cast(epoch(started) as bigint) as started, cast(epoch(ended) as bigint) as ended, cast(date as varchar) as date) from cw",
)
register("b6_required_columns", lambda spark, d: labels.require(adapters.from_events(spark, d), ["tweet_id", "text", "created_at"]).select("tweet_id"), f"with {adapters.EVENTS_SQL} select tweet_id from ev")
register(
    "b1_resolve_columns",
    lambda spark, d: (lambda df, found: df.select(F.col(found["text"]).alias("text"), F.col(found["tweet_id"]).alias("tweet_id")))(*(lambda df: (df, labels.resolve_columns(df, {"tweet_id": "doc_id"})))(adapters.read(spark, d, "documents").withColumnRenamed("text", "remark"))).select("tweet_id", F.length("text").alias("n")),
    "select doc_id as tweet_id, cast(length(text) as integer) as n from documents",
)
