"""Time series of messages: trends, spikes, growth. Windows run over daily or hourly counts, never over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions import wordlists as W

FORMATS = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00"}


def period(granularity: str, at: str = "created_at") -> Column:
    """Name of the period: day, week (its Monday), month or hour."""
    if granularity in ("week", "weekly"):
        return F.date_format(F.date_trunc("week", at), "yyyy-MM-dd")
    return F.date_format(at, FORMATS[{"daily": "day", "monthly": "month", "hourly": "hour"}.get(granularity, granularity)])


def _count(label: str) -> Column:
    return F.count_if(F.lower("sentiment") == label)


def live(messages: DataFrame, granularity: str = "day") -> DataFrame:
    """Counts by tone, urgent share, and answers over questions up to 100, per period."""
    out = messages.where("created_at is not null").groupBy(period(granularity).alias("period")).agg(F.count("*").alias("total"), _count("positive").alias("positive"), _count("neutral").alias("neutral"), _count("negative").alias("negative"), (F.avg(F.lower("priority").isin(list(W.URGENT)).cast("int")) * 100).alias("escalation"), F.count_if("inbound").alias("_in"), F.count_if(~F.col("inbound")).alias("_out"))
    return out.withColumn("resolution", F.when(F.col("_in") > 0, F.least(F.lit(100.0), F.col("_out") / F.col("_in") * 100)).otherwise(0.0)).drop("_in", "_out")


def _batch(messages: DataFrame, granularity: str, *more: Column) -> DataFrame:
    status = F.lower("resolution_status").isin(list(W.RESOLVED_STATUSES))
    rate = lambda c: F.avg(c.cast("int")) * 100
    out = messages.where("created_at is not null").groupBy(period(granularity).alias("period")).agg(
        F.count("*").alias("total"), _count("positive").alias("positive"), _count("neutral").alias("neutral"), _count("negative").alias("negative"),
        rate(F.col("escalated")).alias("escalation"), rate(F.col("fcr")).alias("_flag"), rate(F.coalesce(status, F.lit(False))).alias("_status"), *more,
    )
    return out.withColumn("resolution", F.when(F.col("_flag") > 0, F.col("_flag")).otherwise(F.col("_status"))).drop("_flag", "_status")


def batch(messages: DataFrame, granularity: str = "daily") -> DataFrame:
    """Counts by tone with flag-based escalation and resolution; a resolution of 0 falls back to the status column."""
    return _batch(messages, granularity)


def multi_period(messages: DataFrame, granularity: str = "daily") -> DataFrame:
    """Total, resolution, average response, and count and share of negative and positive, per period."""
    out = _batch(messages, granularity, F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)).alias("avg_response"))
    share = lambda c: (F.col(c) / F.col("total") * 100).alias(f"{c}_percentage")
    return out.select("period", "total", "resolution", "negative", "positive", "avg_response", share("negative"), share("positive"))


def daily_volumes(messages: DataFrame, category: str = "topic_keywords") -> DataFrame:
    return messages.where(F.col("created_at").isNotNull() & F.col(category).isNotNull()).groupBy(F.col(category).alias("category"), F.to_date("created_at").alias("date")).agg(F.count("*").alias("volume"))


def spikes(daily: DataFrame, window: int = 3, z: float = 2.0, least: int = 3) -> DataFrame:
    """z-score of each day's volume against the category's previous ``window`` rows.

    A deviation of null or 0 counts as 1, a missing mean as 0; a spike also needs ``least`` messages.
    """
    before = Window.partitionBy("category").orderBy("date").rowsBetween(-window, -1)
    std = F.stddev_samp("volume").over(before)
    out = daily.withColumn("rolling_mean", F.coalesce(F.avg("volume").over(before), F.lit(0.0))).withColumn("rolling_std", F.when(F.coalesce(std, F.lit(0.0)) == 0, 1.0).otherwise(std))
    out = out.withColumn("spike_score", (F.col("volume") - F.col("rolling_mean")) / F.col("rolling_std"))
    return out.withColumn("spike_detected", (F.col("spike_score") >= z) & (F.col("volume") >= least))


def spike_flags(messages: DataFrame, category: str = "topic_keywords") -> DataFrame:
    """Greatest spike score of each category that spiked."""
    return spikes(daily_volumes(messages, category)).where("spike_detected").groupBy("category").agg(F.max("spike_score").alias("spike_score"))


def escalation_spikes(conversations: DataFrame, days: int = 7, observations: int = 3, min_conversations: int = 20, z: float = 2.0) -> DataFrame:
    """Daily escalation rate of conversations (date, escalated) against up to ``days`` rows before it."""
    daily = conversations.groupBy("date").agg(F.count("*").alias("conversations"), (F.avg(F.col("escalated").cast("int")) * 100).alias("rate"))
    before = Window.orderBy("date").rowsBetween(-days, -1)  # one row a day
    enough = F.count("rate").over(before) >= observations
    out = daily.withColumn("mean", F.when(enough, F.avg("rate").over(before))).withColumn("std", F.when(enough, F.stddev_samp("rate").over(before)))
    out = out.withColumn("z_score", (F.col("rate") - F.col("mean")) / F.when(F.col("std") != 0, F.col("std")))
    return out.withColumn("spike", F.coalesce((F.col("conversations") >= min_conversations) & (F.col("z_score") >= z), F.lit(False)))


def latest(daily: DataFrame) -> DataFrame:
    """The row of the last day."""
    return daily.agg(F.max_by(F.struct(*daily.columns), "date").alias("r")).select("r.*")


def emerging_issues(conversations: DataFrame, category: str = "issue_category", least: float = 20.0) -> DataFrame:
    """Growth of distinct conversations per category on its last observed day over the one before, where at least ``least`` %."""
    daily = conversations.groupBy(F.col(category).alias("category"), "date").agg(F.count_distinct("conversation_id").alias("conversations"))
    by = Window.partitionBy("category").orderBy("date")
    out = daily.withColumn("previous", F.lag("conversations").over(by)).withColumn("from_last", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("date"))))
    out = out.withColumn("growth", F.when(F.col("previous") > 0, (F.col("conversations") - F.col("previous")) / F.col("previous") * 100))
    return out.where((F.col("from_last") == 1) & (F.col("growth") >= least)).drop("from_last")


def halves(conversations: DataFrame, category: str = "issue_category", band: float = 5.0) -> DataFrame:
    """Mean daily volume of the second half of a category's observed days against the first: direction beyond ``band`` %."""
    daily = conversations.groupBy(F.col(category).alias("category"), "date").agg(F.count_distinct("conversation_id").alias("conversations"))
    by = Window.partitionBy("category")
    first = F.col("n") <= F.floor(F.col("days") / 2)
    daily = daily.withColumn("n", F.row_number().over(by.orderBy("date"))).withColumn("days", F.count("*").over(by)).where("days >= 2")
    out = daily.groupBy("category").agg(F.avg(F.when(first, F.col("conversations"))).alias("first_half"), F.avg(F.when(~first, F.col("conversations"))).alias("second_half"))
    out = out.withColumn("change", (F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100)
    return out.withColumn("direction", F.when(F.col("change") > band, "increasing").when(F.col("change") < -band, "decreasing").otherwise("stable"))


def hourly_zscore(messages: DataFrame, hours: int = 24, z: float = 2.5) -> DataFrame:
    """Hourly volume against the mean and deviation of the last ``hours`` hours, itself included."""
    hourly = messages.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("volume"))
    span = Window.orderBy(F.unix_timestamp("hour")).rangeBetween(-hours * 3600, 0)  # one row an hour
    std = F.stddev_samp("volume").over(span)
    out = hourly.withColumn("z_score", (F.col("volume") - F.avg("volume").over(span)) / F.when(std != 0, std))
    return out.withColumn("alert", F.coalesce(F.col("z_score") > z, F.lit(False)))
