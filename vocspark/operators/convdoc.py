"""Metric families over conversation views, and the whole analytics document as one JSON row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions import labels


def _rate(flag: str) -> Column:
    return F.coalesce(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int")) * 100, F.lit(0.0))


def escalation_rates(view: DataFrame) -> DataFrame:
    """(dimension, value, conversations, escalation_rate): overall and by category, sentiment and priority, in one pass."""
    cols = ["issue_category", "sentiment", "priority"]
    out = view.groupingSets([[], *([F.col(c)] for c in cols)], *map(F.col, cols)).agg(F.grouping_id().alias("g"), F.count("*").alias("conversations"), _rate("escalated").alias("escalation_rate"))
    name = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "issue_category").when(F.col("g") == 5, "sentiment").otherwise("priority")
    return out.select(name.alias("dimension"), F.coalesce("issue_category", "sentiment", "priority", F.lit("all")).alias("value"), "conversations", "escalation_rate")


def resolution_rates(view: DataFrame) -> DataFrame:
    """(value, conversations, resolution_rate): overall (all) and by category."""
    out = view.groupingSets([[], [F.col("issue_category")]], F.col("issue_category")).agg(F.count("*").alias("conversations"), _rate("resolved").alias("resolution_rate"))
    return out.select(F.coalesce("issue_category", F.lit("all")).alias("value"), "conversations", "resolution_rate")


def category_sentiment(rows: DataFrame) -> DataFrame:
    """Mean score and negative share per category, over messages."""
    return rows.groupBy("issue_category").agg(F.count("*").alias("messages"), F.avg("sentiment_score").alias("avg_score"), (F.avg((F.col("sentiment") == "negative").cast("int")) * 100).alias("negative_percentage"))


def resolution_times(view: DataFrame) -> DataFrame:
    """Mean and median minutes of resolved conversations."""
    return view.where("resolved").agg(F.count("*").alias("resolved"), F.avg("duration_minutes").alias("average_minutes"), F.median("duration_minutes").alias("median_minutes"))


#: Accuracy of sketched durations: a quantile's rank is within ``RANK_ERROR`` with a chance of 0.99.
SKETCH_SIZE, RANK_ERROR = 800, 0.005


def resolution_sketches(view: DataFrame, *by: str) -> DataFrame:
    """Count, sum and a sketch of the minutes of resolved conversations for each ``by``, such as a day and a category.

    A sketch takes some 10 KB whatever the number of conversations, where an exact median holds
    every distinct value. Rows can be kept and merged with later ones.
    """
    return view.where("resolved").groupBy(*by).agg(
        F.count("*").alias("resolved"), F.count("duration_minutes").alias("n"), F.sum("duration_minutes").alias("minutes"),
        F.kll_sketch_agg_double(F.col("duration_minutes").cast("double"), SKETCH_SIZE).alias("sketch"),
    )


def sketched_times(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, resolved, average_minutes, median_minutes) of kept sketches merged for each ``by``; null where there are no minutes."""
    merged = sketches.groupBy(*by).agg(F.sum("resolved").alias("resolved"), F.sum("n").alias("n"), F.sum("minutes").alias("minutes"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))
    some = F.col("n") > 0
    median = F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))
    return merged.select(*by, "resolved", F.when(some, F.col("minutes") / F.col("n")).alias("average_minutes"), median.alias("median_minutes"))


def top_labels(view: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """(field, value, n, rank): the most frequent values of each column."""
    counts = view.select(*columns).unpivot([], columns, "field", "value").where("value is not null and value <> 'Unknown'").groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top)


def distinct_pain_points(view: DataFrame) -> DataFrame:
    return view.agg(F.count_distinct(F.when(F.col("pain_point") != "Unknown", F.col("pain_point"))).alias("distinct_pain_points"))


def flagged(view: DataFrame, flag: str, top: int = 5) -> DataFrame:
    """(kind, value, n, rate): how many conversations have ``flag``, and their leading categories and pain points."""
    total = view.agg(F.lit("all").alias("kind"), F.lit("all").alias("value"), F.count_if(flag).alias("n"), _rate(flag).alias("rate"))
    parts = top_labels(view.where(flag), ["issue_category", "pain_point"], top).select(F.col("field").alias("kind"), "value", "n", F.lit(None).cast("double").alias("rate"))
    return total.unionByName(parts)


def sentiment_impact(view: DataFrame, rows: DataFrame) -> DataFrame:
    """Per sentiment: resolution and escalation over conversations, mean response over messages. The grains differ."""
    per = view.groupBy("sentiment").agg(F.count("*").alias("conversations"), _rate("resolved").alias("resolution_rate"), _rate("escalated").alias("escalation_rate"))
    response = rows.groupBy("sentiment").agg(F.avg("response_time_minutes").alias("avg_response_minutes"))
    return per.join(response, "sentiment", "left")


AI_COLUMNS = ("ai_solution_proposed", "ai_solution_successful", "sentiment_before", "sentiment_after")


def ai_impact(view: DataFrame) -> DataFrame:
    """Proposed solutions, their success and mean change of sentiment, or not_available without the columns."""
    if any(labels.first_existing(view, [c]) is None for c in AI_COLUMNS):
        return view.sparkSession.createDataFrame([("not_available", None, None, None)], "status string, proposed long, success_rate double, sentiment_change double")
    proposed = F.coalesce(F.col(AI_COLUMNS[0]), F.lit(False))
    good = F.avg(F.when(proposed, F.coalesce(F.col(AI_COLUMNS[1]), F.lit(False)).cast("int"))) * 100
    return view.agg(F.lit("available").alias("status"), F.count_if(proposed).alias("proposed"), good.alias("success_rate"), F.avg(F.when(proposed, F.col(AI_COLUMNS[3]) - F.col(AI_COLUMNS[2]))).alias("sentiment_change"))


def document(view: DataFrame, rows: DataFrame) -> DataFrame:
    """One JSON row: totals, rates, times, leading labels and sentiment impact, as nested objects and arrays."""
    listed = lambda df, *order: df.agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))).alias("a"))
    parts = {
        "escalation": listed(escalation_rates(view), "dimension", "value"),
        "resolution": listed(resolution_rates(view), "value"),
        "labels": listed(top_labels(view, ["issue_category", "issue_subcategory", "pain_point"]), "field", "rank"),
        "impact": listed(sentiment_impact(view, rows), "sentiment"),
        "times": resolution_times(view).select(F.struct("*").alias("a")),
        "ai": ai_impact(view).select(F.struct("*").alias("a")),
    }
    out = view.agg(F.count("*").alias("conversations"), F.sum("messages").alias("messages"))
    for name, part in parts.items():
        out = out.crossJoin(part.withColumnRenamed("a", name))  # one row each
    return out.select(F.to_json(F.struct("*")).alias("document"))
