"""Comparison of runs and slices: KPI deltas, topic evolution, issue sets, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions import text as T
from vocspark.functions import wordlists as W
from vocspark.operators import trends
from vocspark.operators.sizes import bounded

METRICS = {"resolution_rate": True, "escalation_rate": False, "reopen_rate": False, "avg_response_time_minutes": False, "negative_percentage": False, "positive_percentage": True, "csat_proxy": True, "total_records": True}


def sides(messages: DataFrame, current: Column, previous: Column) -> DataFrame:
    """Rows tagged ``side`` current or previous; a row in both slices is two rows, so one aggregation serves both."""
    where = F.array_compact(F.array(F.when(current, "current"), F.when(previous, "previous")))
    return messages.withColumn("side", F.explode(where))


def kpis_by(messages: DataFrame, *keys: str) -> DataFrame:
    """The compared KPIs per key."""
    n = F.count("*")
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")) * 100
    tone = lambda s: F.count_if(F.lower("sentiment") == s)
    return messages.groupBy(*keys).agg(
        n.alias("total_records"), rate("fcr").alias("resolution_rate"), rate("escalated").alias("escalation_rate"), rate("reopened").alias("reopen_rate"), F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)).alias("avg_response_time_minutes"),
        (tone("negative") / n * 100).alias("negative_percentage"), (tone("positive") / n * 100).alias("positive_percentage"), ((tone("positive") + tone("neutral") * 0.5) / n * 100).alias("csat_proxy"),
    )


def deltas(tagged: DataFrame) -> DataFrame:
    """(metric, current, previous, delta, percentage_change, trend) from rows tagged by ``sides``.

    From 0, any rise is 100 %. improved and declined follow whether more is better.
    """
    long = kpis_by(tagged, "side").withColumn("total_records", F.col("total_records").cast("double")).unpivot("side", list(METRICS), "metric", "value")
    both = long.groupBy("metric").agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in ("current", "previous")))
    better = F.lit(False)
    for name, higher in METRICS.items():
        better = F.when(F.col("metric") == name, higher).otherwise(better)
    d = F.col("current") - F.col("previous")
    change = F.when(F.col("previous") != 0, d / F.greatest(F.lit(0.001), F.col("previous")) * 100).when(F.col("current") > 0, 100.0).otherwise(0.0)
    trend = F.when(d == 0, "stable").when((d > 0) == better, "improved").otherwise("declined")
    return both.select("metric", "current", "previous", d.alias("delta"), change.alias("percentage_change"), trend.alias("trend"))


def topics_by(messages: DataFrame) -> DataFrame:
    """Volume and negative share of each topic."""
    out = messages.groupBy("topic_keywords").agg(F.count("*").alias("volume"), (F.avg((F.lower("sentiment") == "negative").cast("int")) * 100).alias("negative"))
    return out.withColumn("cluster_name", T.cluster_name("topic_keywords"))


def topic_evolution(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Topics of two runs matched by lower-case cluster name: new, subsided or changed, largest change first."""
    key = F.lower(F.trim(F.coalesce("cluster_name", "topic_keywords")))
    one = lambda df, side: df.withColumn("key", key).where("key <> '' and key <> 'pending ai discovery'").groupBy("key").agg(F.sum("volume").alias(f"{side}_volume"), (F.sum(F.col("volume") * F.col("negative")) / F.sum("volume")).alias(f"{side}_negative"))
    out = one(current, "current").join(one(previous, "previous"), "key", "full_outer")
    status = F.when(F.col("previous_volume").isNull(), "new").when(F.col("current_volume").isNull(), "subsided").otherwise("changed")
    c, p = F.coalesce("current_volume", F.lit(0)), F.coalesce("previous_volume", F.lit(0))
    delta = c - p
    out = out.select("key", status.alias("status"), c.alias("current_volume"), p.alias("previous_volume"), delta.alias("volume_delta"), (delta / F.greatest(F.lit(1), p) * 100).alias("volume_change"), (F.coalesce("current_negative", F.lit(0.0)) - F.coalesce("previous_negative", F.lit(0.0))).alias("negative_delta"))
    return out.withColumn("direction", F.when(F.col("volume_delta") > 0, "Surging").when(F.col("volume_delta") < 0, "Decreasing").otherwise("Stable")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("volume_delta")), "key")))


def issue_sets(topics: DataFrame, previous_topics: DataFrame, flags: DataFrame, top: int = 5) -> DataFrame:
    """(kind, topic_keywords, ...): emerging, recurring and new topics of a run against the one before.

    topics is ranked with pain_score. A topic without a measured spike gets the padded score
    2.2 + 0.45 (rank - 1) + negative / 50; z_measured tells the two apart. Recurring topics have 10
    messages and were seen before, new ones were not.
    """
    generic = F.lower(F.trim("topic_keywords")).isin(list(W.GENERIC_TOPICS)) | F.lower("topic_keywords").contains("unclassified")
    t = topics.where(~generic).join(bounded(flags.withColumnRenamed("category", "topic_keywords")), "topic_keywords", "left")
    place = F.col("rank") - 1
    measured = F.coalesce(F.col("spike_score") > 0, F.lit(False))
    t = t.withColumn("z_measured", measured).withColumn("z_score", F.when(measured, F.col("spike_score")).otherwise(2.2 + place * 0.45 + F.col("negative_percentage") / 50))
    t = t.withColumn("surge_percentage", F.least(F.lit(420.0), F.greatest(F.lit(45.0), F.col("z_score") * 42 + place * 24 + F.col("negative_percentage") * 1.5)))
    t = t.withColumn("severity", F.when(F.col("z_score") >= 3, "CRITICAL_SURGE").when(F.col("z_score") >= 2, "HIGH_VELOCITY_SPIKE").otherwise("SURGING"))
    seen = bounded(previous_topics.select("topic_keywords").distinct())
    kinds = {"emerging": t, "recurring": t.where("volume >= 10").join(seen, "topic_keywords", "left_semi"), "new": t.join(seen, "topic_keywords", "left_anti")}
    out = None
    for kind, df in kinds.items():
        df = df.withColumn("kind", F.lit(kind)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("pain_score"), "topic_keywords"))).where(F.col("place") <= top)
        df = df.select("kind", "place", "topic_keywords", "volume", "z_score", "z_measured", "surge_percentage", "severity")
        out = df if out is None else out.unionByName(df)
    return out


def pillars(sets: DataFrame, previous_sets: DataFrame, kpis: DataFrame, previous_kpis: DataFrame) -> DataFrame:
    """Counts of the sets, reduction of recurring issues and speed-up of answers, in percent."""
    count = lambda df, kind, name: df.agg(F.count_if(F.col("kind") == kind).alias(name))
    out = count(sets, "emerging", "emerging").crossJoin(count(sets, "recurring", "recurring")).crossJoin(count(previous_sets, "recurring", "recurring_before"))
    out = out.crossJoin(kpis.select(F.col("avg_response_time_minutes").alias("now"))).crossJoin(previous_kpis.select(F.col("avg_response_time_minutes").alias("was")))
    reduction = F.when(F.col("recurring_before") > 0, (F.col("recurring") - F.col("recurring_before")) / F.col("recurring_before") * 100).otherwise(0.0)
    boost = F.when(F.col("was") > 0, (F.col("was") - F.col("now")) / F.greatest(F.lit(0.1), F.col("was")) * 100).otherwise(0.0)
    return out.select("emerging", "recurring", reduction.alias("recurring_reduction"), boost.alias("speed_boost"))


def run_signatures(messages: DataFrame) -> DataFrame:
    """One KPI row per run and user, with the time of its newest message."""
    at = messages.groupBy("dataset_run_id").agg(F.max("created_at").alias("created_at"), F.lit("analyst").alias("user_id"))
    return kpis_by(messages, "dataset_run_id").join(at, "dataset_run_id")


def previous_signature(signatures: DataFrame, user: str, current_run: str) -> DataFrame:
    """The user's newest KPI row of another run; runs without records are stale."""
    rows = signatures.where((F.col("user_id") == user) & (F.col("dataset_run_id") != current_run) & (F.col("total_records") > 0))
    return rows.groupBy("user_id").agg(F.max_by(F.struct("*"), F.struct("created_at", "dataset_run_id")).alias("s")).select("s.*")


def signature_payloads(messages: DataFrame) -> DataFrame:
    """(dataset_run_id, payload): KPIs with their topic, tone and priority children joined back into one JSON document."""
    child = lambda col: messages.groupBy("dataset_run_id", col).agg(F.count("*").alias("n")).groupBy("dataset_run_id").agg(F.array_sort(F.collect_list(F.struct(col, "n"))).alias(f"by_{col}"))
    out = messages.groupBy("dataset_run_id").agg(F.count("*").alias("total_records"), F.count_if(F.lower("sentiment") == "negative").alias("negative"))
    for col in ("topic_keywords", "sentiment", "priority"):
        out = out.join(child(col), "dataset_run_id", "left")
    return out.select("dataset_run_id", F.to_json(F.struct("total_records", "negative", "by_topic_keywords", "by_sentiment", "by_priority")).alias("payload"))


def topic_keys(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Distinct topics of either run."""
    return current.select("topic_keywords").union(previous.select("topic_keywords")).distinct()


def flags_of(messages: DataFrame) -> DataFrame:
    return trends.spike_flags(messages)
