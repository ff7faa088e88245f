"""Conversation threads and response times from reply links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.operators.sizes import bounded
from vocspark.sources.shared import shared_dir


def conversation_roots(messages: DataFrame) -> DataFrame:
    """``messages`` with conversation_id: the id of the first message up the reply links.

    Pointer jumping: each round a message takes its ancestor's ancestor, so a thread of depth d
    takes log2(d) rounds. Only messages that answer one join; a missing parent ends the thread
    with the parent's own id. Message ids count once, the earliest row first. Rounds stop when no
    ancestor moves, or when more than all links would have been passed: what moves then answers
    in a circle, and its thread has the least id of the circle. Each round is a join of narrow
    columns, written to the checkpoint folder so that plans stay short.
    """
    first = F.min(F.struct("created_at", "in_response_to_tweet_id")).alias("first")
    links = messages.where("in_response_to_tweet_id is not null and tweet_id is not null").groupBy(F.col("tweet_id").alias("id")).agg(first)
    steps = _kept(links.select("id", F.col("first.in_response_to_tweet_id").alias("up"), F.col("id").alias("low"), F.lit(True).alias("moved")))
    for _ in range(steps.count().bit_length() + 1):
        beyond = steps.select(F.col("id").alias("up"), F.col("up").alias("higher"), F.col("low").alias("lower"))
        stepped = steps.join(beyond, "up", "left")
        steps = _kept(stepped.select("id", F.coalesce("higher", "up").alias("up"), F.least("low", "lower").alias("low"), F.col("higher").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            break
    circles = steps.select(F.col("id").alias("up"), F.col("low").alias("lower"))
    roots = steps.join(circles, "up", "left").select("id", F.when(F.col("moved"), F.col("lower")).otherwise(F.col("up")).alias("root"))
    own = [messages[c] for c in messages.columns if c != "conversation_id"]
    return messages.join(roots, messages["tweet_id"] == roots["id"], "left").select(*own, F.coalesce(roots["root"], messages["tweet_id"]).cast("string").alias("conversation_id"))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def response_times(messages: DataFrame, allow_negative: bool = False) -> DataFrame:
    """``messages`` with response_time_minutes: from an inbound message to the first id in response_tweet_id.

    Null for outbound messages, unknown ids and, unless allowed, negative gaps. The joined side
    has one row per id, the earliest.
    """
    first_id = F.trim(F.get(F.split(messages["response_tweet_id"], ","), F.lit(0)))
    wanted = F.when(messages["inbound"], F.regexp_replace(first_id, r"\.0+$", "").try_cast("long"))
    times = messages.where("tweet_id is not null and created_at is not null").groupBy(F.col("tweet_id").alias("answer")).agg(F.min("created_at").alias("answered"))
    minutes = (F.unix_micros(times["answered"]) - F.unix_micros(messages["created_at"])) / 6e7
    kept = minutes if allow_negative else F.when(minutes >= 0, minutes)
    own = [messages[c] for c in messages.columns if c != "response_time_minutes"]
    return messages.join(times, wanted == times["answer"], "left").select(*own, kept.alias("response_time_minutes"))


def with_group_counts(messages: DataFrame) -> DataFrame:
    """Issue volume and mean category sentiment on every row: few groups, so aggregated and broadcast."""
    stats = messages.groupBy("issue_category").agg(F.count("*").alias("issue_volume"), F.avg("sentiment_score").alias("category_sentiment_score"))
    return messages.join(bounded(stats), "issue_category", "left")


def first_replies(messages: DataFrame) -> DataFrame:
    """Customer messages with their conversation's first outbound text, null for none."""
    reply = messages.where("not inbound").groupBy("conversation_id").agg(F.min_by("text", F.struct("created_at", "tweet_id")).alias("company_response"))
    return messages.where("inbound").join(reply, "conversation_id", "left")
