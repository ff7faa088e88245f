"""Row filters over messages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGION_GROUPS = (("north america", "us", "usa", "canada"), ("europe", "eu", "uk", "emea"), ("asia", "asia pacific", "apac", "india"), ("latam", "latin america", "brazil"), ("africa", "middle east", "mea"))


def slice_filter(
    run: str | None = None, year: int | None = None, month: int | None = None, years: tuple[int, int] | None = None, dates: tuple[date, date] | None = None,
    sentiment: str | None = None, priority: str | None = None, topic: str | None = None, company: str | None = None, product: str | None = None, region: str | None = None, language: str | None = None,
) -> Column:
    """One condition for a dashboard slice. Years, months and date ranges are half-open ranges of created_at, so they reach the scan."""
    at, keep = F.col("created_at"), F.lit(True)

    def between(a: date, b: date) -> Column:
        return (at >= F.lit(a.isoformat()).cast("timestamp")) & (at < F.lit(b.isoformat()).cast("timestamp"))

    if run is not None:
        keep = keep & (F.col("dataset_run_id") == run)
    if year is not None and month is not None:
        keep = keep & between(date(year, month, 1), date(year + month // 12, month % 12 + 1, 1))
    elif year is not None:
        keep = keep & between(date(year, 1, 1), date(year + 1, 1, 1))
    elif month is not None:
        keep = keep & (F.month(at) == month)
    if years is not None:
        keep = keep & between(date(years[0], 1, 1), date(years[1] + 1, 1, 1))
    if dates is not None:
        keep = keep & between(dates[0], date.fromordinal(dates[1].toordinal() + 1))
    for name, value in (("sentiment", sentiment), ("priority", priority), ("company", company), ("product", product), ("detected_language", language)):
        if value is not None:
            keep = keep & (F.lower(name) == value.lower())
    if topic is not None:
        keep = keep & F.lower("topic_keywords").contains(topic.lower())
    if region is not None:
        group = next((g for g in REGION_GROUPS if region.lower() in g), (region.lower(),))
        keep = keep & F.lower("region").isin(list(group))
    return keep


def recent(messages: DataFrame, days: int) -> DataFrame:
    """Messages of the last ``days`` before the newest one; the newest is one aggregated value."""
    newest = messages.agg(F.max("created_at").alias("_newest"))
    return messages.join(F.broadcast(newest), F.col("created_at") >= F.col("_newest") - F.expr(f"interval {int(days)} days")).drop("_newest")


def listed_companies(messages: DataFrame) -> DataFrame:
    """Messages whose company can be listed: named, not a number, not a catch-all."""
    name = F.trim("company")
    return messages.where(F.col("company").isNotNull() & (name != "") & ~name.rlike("^[0-9]+$") & ~F.lower(name).isin("global enterprise", "general enterprise", "unknown"))


def keep_or_all(df: DataFrame, keep: Column, by: str) -> DataFrame:
    """Rows to keep of each group ``by``; a group of which none would be kept stays whole."""
    kept = F.coalesce(keep, F.lit(False)).cast("int")
    return df.withColumn("_keep", kept).withColumn("_any", F.max("_keep").over(Window.partitionBy(by))).where("_keep = 1 or _any = 0").drop("_keep", "_any")
