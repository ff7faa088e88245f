"""Per-conversation states, statistics and views, and the batch layer's wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vocspark.functions import text as T
from vocspark.functions import wordlists as W
from vocspark.operators import threads
from vocspark.operators.sizes import bounded
from vocspark.sources.scratch import Scratch


def _in_order() -> WindowSpec:
    return Window.partitionBy("conversation_id").orderBy("created_at", "tweet_id")


def _any(condition):
    return F.coalesce(F.bool_or(condition), F.lit(False))


def states(messages: DataFrame) -> DataFrame:
    """One row per conversation: counts, and whether it was reopened, resolved, escalated.

    Reopened: a customer writes right after an agent. Resolved: the last message is an agent's.
    Escalated: a customer's message is urgent or negative. Ties in time follow the id. Messages
    without a column conversation_id are one conversation: resolved if an agent wrote at all,
    never reopened.
    """
    urgent = F.lower("priority").isin(list(W.URGENT)) | (F.lower("sentiment") == "negative")
    if "conversation_id" not in messages.columns:
        counts = (F.count("*").alias("messages_count"), F.count_if("inbound").alias("customer_messages_count"), F.count_if(~F.col("inbound")).alias("agent_messages_count"))
        whole = messages.agg(*counts, _any(~F.col("inbound")).alias("resolved"), _any(F.col("inbound") & urgent).alias("escalated")).where("messages_count > 0")
        return whole.select(F.lit(None).cast("string").alias("conversation_id"), "messages_count", "customer_messages_count", "agent_messages_count", F.lit(False).alias("reopened"), "resolved", "escalated")
    m = messages.withColumn("_after_agent", F.coalesce(~F.lag("inbound").over(_in_order()), F.lit(False))).withColumn("_last", F.lead("tweet_id").over(_in_order()).isNull())
    return m.groupBy("conversation_id").agg(
        F.count("*").alias("messages_count"),
        F.count_if("inbound").alias("customer_messages_count"),
        F.count_if(~F.col("inbound")).alias("agent_messages_count"),
        _any(F.col("inbound") & F.col("_after_agent")).alias("reopened"),
        _any(~F.col("inbound") & F.col("_last")).alias("resolved"),
        _any(F.col("inbound") & urgent).alias("escalated"),
    )


def rates(state: DataFrame) -> DataFrame:
    """Resolution, escalation and reopen rates in percent; no conversations give no_data_available."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("int")) * 100, F.lit(0.0))
    return state.agg(F.count("*").alias("total_conversations"), rate("resolved").alias("resolution_rate"), rate("escalated").alias("escalation_rate"), rate("reopened").alias("reopen_rate")).withColumn("status", F.when(F.col("total_conversations") > 0, "success").otherwise("no_data_available"))


def label_issues(messages: DataFrame) -> DataFrame:
    """Clean text, issue category, subcategory, pain point and day of each message with text."""
    m = messages.withColumn("clean_text", T.simple_clean("text")).where("length(clean_text) > 0")
    m = m.withColumn("issue_category", T.issue_category("clean_text"))
    m = m.withColumn("issue_subcategory", T.issue_subcategory("clean_text", "issue_category"))
    return m.withColumn("customer_pain_point", F.concat_ws(" - ", "issue_category", "issue_subcategory")).withColumn("date", F.to_date("created_at"))


def stats(messages: DataFrame) -> DataFrame:
    """Batch statistics per conversation. Takes response_time_minutes and sentiment_score."""
    answered = F.col("inbound") & F.col("response_tweet_id").isNotNull()
    out = messages.groupBy("conversation_id").agg(
        F.count("tweet_id").alias("conversation_message_count"),
        F.count_if("inbound").alias("customer_message_count"),
        F.count_if(~F.col("inbound")).alias("agent_message_count"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.count_if(F.col("sentiment") == "negative").alias("negative_message_count"),
        F.count_if(answered).alias("response_count"),
        F.avg("response_time_minutes").alias("avg_response_time_minutes"),
        F.count_if(F.col("priority") == "high").alias("high_priority_count"),
    )
    return out.withColumn("response_rate", F.when(F.col("customer_message_count") > 0, F.col("response_count") / F.col("customer_message_count") * 100))


def daily_issues(messages: DataFrame) -> DataFrame:
    """Daily volume per issue category, growth on the day before and a z-score against the three before.

    Few categories: the messages are counted by day first, and the windows run over the counts.
    """
    daily = messages.groupBy("issue_category", "date").agg(F.count("*").alias("daily_volume"))
    by_day = Window.partitionBy("issue_category").orderBy("date")
    three = by_day.rowsBetween(-3, -1)
    daily = daily.withColumn("previous_volume", F.lag("daily_volume").over(by_day)).withColumn("rolling_mean", F.avg("daily_volume").over(three)).withColumn("rolling_std", F.stddev_samp("daily_volume").over(three))
    return daily.withColumn("issue_growth_rate", F.when(F.col("previous_volume") > 0, (F.col("daily_volume") - F.col("previous_volume")) / F.col("previous_volume") * 100)).withColumn(
        "spike_score", (F.col("daily_volume") - F.col("rolling_mean")) / F.when(F.col("rolling_std") != 0, F.col("rolling_std"))
    ).withColumn("spike_detected", F.coalesce(F.col("spike_score") >= 2, F.lit(False)))


def proxies(messages: DataFrame) -> DataFrame:
    """The batch layer's per-message proxies and their any-values per conversation.

    Takes messages labelled by ``label_issues`` with conversation_id.
    """
    repeats = messages.where("inbound").groupBy("author_id", "issue_category").agg(F.count("*").alias("customer_issue_count"))
    m = messages.join(repeats, ["author_id", "issue_category"], "left")
    whole = Window.partitionBy("conversation_id")
    m = m.withColumn("recurring_issue", F.coalesce(F.col("customer_issue_count") > 1, F.lit(False)))
    m = m.withColumn("reopened_proxy", F.col("inbound") & F.coalesce(~F.lag("inbound").over(_in_order()), F.lit(False)))
    m = m.withColumn("recurring_after_solution", F.col("reopened_proxy") & F.col("recurring_issue"))
    m = m.withColumn("escalation_proxy", F.col("inbound") & (F.col("priority") == "high") & (F.col("sentiment") == "negative") & F.col("recurring_issue"))
    m = m.withColumn("resolution_proxy", ~F.col("inbound") & (F.col("created_at") == F.max("created_at").over(whole)))
    for name, source in (("resolved_proxy", "resolution_proxy"), ("escalated_proxy", "escalation_proxy"), ("reopened_proxy_conversation", "reopened_proxy")):
        m = m.withColumn(name, F.bool_or(source).over(whole))
    return m


def global_kpis(messages: DataFrame) -> DataFrame:
    """One row of KPIs over messages with proxies and response times."""
    per = messages.groupBy("conversation_id").agg(F.bool_or("resolution_proxy").alias("r"), F.bool_or("escalation_proxy").alias("e"), F.bool_or("reopened_proxy").alias("o"))
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("int")) * 100, F.lit(0.0))
    conversations = per.agg(F.count("*").alias("total_conversations"), rate("r").alias("resolution_rate_proxy"), rate("e").alias("escalation_rate_proxy"), rate("o").alias("reopen_rate_proxy"))
    asked = F.count_if("inbound")
    rows = messages.agg(
        asked.alias("total_customer_messages"),
        F.coalesce(F.count_if(F.col("inbound") & F.col("response_tweet_id").isNotNull()) / F.when(asked > 0, asked) * 100, F.lit(0.0)).alias("response_rate"),
        F.coalesce(F.avg(F.when(F.col("inbound"), F.col("response_time_minutes"))), F.lit(0.0)).alias("avg_response_time_minutes"),
        F.avg("sentiment_score").alias("average_sentiment"),
    )
    return rows.crossJoin(conversations)  # one row each


def batch_rows(messages: DataFrame) -> DataFrame:
    """Messages with conversation ids, issue labels, response times and proxies: the base of the wide output.

    A written table, as most of what is built on it reads it several times.
    """
    m = label_issues(messages)
    return Scratch(messages.sparkSession, "batch-rows").keep(proxies(threads.response_times(m, allow_negative=True)))


WIDE = (
    "tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id", "sentiment", "confidence", "priority", "sentiment_score", "conversation_id", "topic_id", "topic_keywords", "topic_probability",
    "issue_category", "issue_subcategory", "customer_pain_point", "issue_volume", "issue_growth_rate", "new_issue", "recurring_issue", "recurring_after_solution", "emerging_issue", "spike_detected", "spike_score", "response_exists", "response_time_minutes",
    "conversation_message_count", "customer_message_count", "agent_message_count", "avg_sentiment", "negative_message_count", "response_count", "response_rate", "avg_response_time_minutes", "resolved_proxy", "escalation_proxy", "reopened_proxy", "category_sentiment_score",
)


def issue_columns(rows: DataFrame) -> DataFrame:
    """``rows`` of ``batch_rows`` with issue volume, growth, spikes, novelty: aggregates by category and day, broadcast back."""
    daily = daily_issues(rows).select("issue_category", "date", "issue_growth_rate", "spike_score", "spike_detected")
    firsts = rows.groupBy("issue_category").agg(F.min("date").alias("_first"))
    m = threads.with_group_counts(rows).join(bounded(daily), ["issue_category", "date"], "left").join(bounded(firsts), "issue_category", "left")
    m = m.withColumn("new_issue", F.col("date") == F.col("_first")).drop("_first")
    return m.withColumn("emerging_issue", F.coalesce((F.col("issue_growth_rate") >= 50) & (F.col("issue_volume") >= 2), F.lit(False)))


def wide(messages: DataFrame) -> DataFrame:
    """The batch layer's wide rows: 40 columns, then 8 global KPIs on each."""
    rows = batch_rows(messages)
    m = issue_columns(rows).join(stats(rows).drop("high_priority_count"), "conversation_id", "left")
    m = m.withColumn("response_exists", F.col("inbound") & F.col("response_tweet_id").isNotNull())
    for name, value in (("topic_id", F.lit(-1)), ("topic_keywords", F.lit("General")), ("topic_probability", F.lit(None).cast("double"))):
        m = m if name in m.columns else m.withColumn(name, value)
    kpis = global_kpis(rows)
    names = {"response_rate": "overall_response_rate", "avg_response_time_minutes": "overall_avg_response_time_minutes", "resolution_rate_proxy": "overall_resolution_rate_proxy", "escalation_rate_proxy": "overall_escalation_rate_proxy", "reopen_rate_proxy": "overall_reopen_rate_proxy", "average_sentiment": "overall_average_sentiment"}
    return m.select(*WIDE).crossJoin(F.broadcast(kpis.withColumnsRenamed(names)))


def issue_summary(messages: DataFrame) -> DataFrame:
    """Nine aggregates per category and subcategory of customer messages, a dense rank by volume, and sentiment impact."""
    m = issue_columns(batch_rows(messages)).where("inbound")
    out = m.groupBy("issue_category", "issue_subcategory").agg(
        F.count("tweet_id").alias("issue_volume"), F.avg("sentiment_score").alias("avg_sentiment"), F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("priority") == "high").alias("high_priority_volume"), F.count_if("new_issue").alias("new_issue_count"), F.count_if("recurring_issue").alias("recurring_issue_count"),
        F.count_if("emerging_issue").alias("emerging_issue_count"), F.count_if("spike_detected").alias("spike_count"), F.avg("response_time_minutes").alias("avg_response_time"),
    )
    return out.withColumn("pain_point_rank", F.dense_rank().over(Window.orderBy(F.desc("issue_volume")))).withColumn("sentiment_impact", F.col("issue_volume") * F.col("avg_sentiment"))


def view(rows: DataFrame) -> DataFrame:
    """One row per conversation from ``batch_rows``: span, flags, means, most frequent labels, highest priority."""
    label = lambda c: F.coalesce(F.mode(F.when(F.col(c) != "Unknown", F.col(c)), True), F.lit("Unknown"))
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).when(F.col("priority") == "normal", 1).otherwise(0)
    out = rows.where("created_at is not null").groupBy("conversation_id").agg(
        F.min_by(F.when(F.col("inbound"), F.col("author_id")), F.when(F.col("inbound"), F.struct("created_at", "tweet_id"))).alias("customer_id"),
        F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.count("*").alias("messages"), F.count_if("inbound").alias("customer_messages"),
        F.bool_or("resolution_proxy").alias("resolved"), F.bool_or("escalation_proxy").alias("escalated"), F.bool_or("reopened_proxy").alias("reopened"), F.bool_or("recurring_after_solution").alias("recurring_after_solution"),
        F.avg("response_time_minutes").alias("avg_response_minutes"), label("sentiment").alias("sentiment"), label("issue_category").alias("issue_category"), label("issue_subcategory").alias("issue_subcategory"), label("customer_pain_point").alias("pain_point"), F.max(rank).alias("_rank"),
    )
    out = out.withColumn("duration_minutes", (F.unix_micros("ended") - F.unix_micros("started")) / 6e7).withColumn("date", F.to_date("started"))
    return out.withColumn("priority", F.when(F.col("_rank") == 3, "high").when(F.col("_rank") == 2, "medium").when(F.col("_rank") == 1, "normal").otherwise("unknown")).drop("_rank")
