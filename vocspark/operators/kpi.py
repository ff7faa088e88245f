"""KPIs, topics, dimensions and rule tables over messages (the live layer and its batch twin)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions import labels
from vocspark.functions import text as T
from vocspark.functions import wordlists as W


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)) * 100


def _urgent() -> Column:
    return F.lower("priority").isin(list(W.URGENT))


def _is(label: str) -> Column:
    return F.lower("sentiment") == label


#: Columns of a message that ``overall_sums`` reads, for tables without some of them.
_OVERALL_COLUMNS = {"conversation_id": "string", "sentiment": "string", "response_time_minutes": "double", "priority": "string", "inbound": "boolean", "fcr": "boolean"}


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total_records"), F.count_if(_is("negative")).alias("negative_count"), F.count_if(_is("positive")).alias("positive_count"), F.count_if(_is("neutral")).alias("neutral_count"),
        F.count_if(_urgent()).alias("urgent_count"), F.count_if("inbound").alias("inbound_count"), F.count_if(~F.col("inbound")).alias("outbound_count"), F.count_if(F.coalesce("fcr", F.lit(False))).alias("resolved_count"),
    ]


def overall_sums(messages: DataFrame) -> DataFrame:
    """One row that can be merged with others: counts, sum and number of response times, a sketch of conversation ids. Missing columns are null."""
    given = messages.withColumns({c: F.lit(None).cast(kind) for c, kind in _OVERALL_COLUMNS.items() if c not in messages.columns})
    return given.agg(*_counts(), F.sum("response_time_minutes").alias("response_sum"), F.count("response_time_minutes").alias("response_count"), F.hll_sketch_agg("conversation_id", 14).alias("conversation_sketch"))


def merged_sums(partials: DataFrame, *by: str) -> DataFrame:
    """``overall_sums`` rows added up for each ``by``."""
    added = [c for c in partials.columns if c.endswith(("_count", "_records", "_sum"))]
    return partials.groupBy(*by).agg(*(F.sum(c).alias(c) for c in added), F.hll_union_agg("conversation_sketch").alias("conversation_sketch"))


def overall_of(sums: DataFrame) -> DataFrame:
    """The columns of ``overall`` from sums, and ``conversations``, an estimate within about 1 %."""
    mean = F.coalesce(F.col("response_sum") / F.nullif("response_count", F.lit(0)), F.lit(0.0))
    out = sums.withColumns({"avg_response_time_minutes": mean, "conversations": F.hll_sketch_estimate("conversation_sketch")})
    return _with_rates(out.drop("response_sum", "response_count", "conversation_sketch"))


def overall(messages: DataFrame) -> DataFrame:
    """One row of counts and rates in one pass. Resolution falls back from resolved over all to outbound over inbound."""
    return _with_rates(messages.agg(*_counts(), F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)).alias("avg_response_time_minutes")))


def _with_rates(out: DataFrame) -> DataFrame:
    total = F.col("total_records")
    by_answers = F.when(F.col("inbound_count") > 0, F.least(F.lit(100.0), F.col("outbound_count") / F.col("inbound_count") * 100)).otherwise(0.0)
    return out.withColumns({
        "negative_percentage": _share(F.col("negative_count"), total),
        "positive_percentage": _share(F.col("positive_count"), total),
        "neutral_percentage": F.when(total > 0, F.greatest(F.lit(0.0), 100 - _share(F.col("negative_count") + F.col("positive_count"), total))).otherwise(0.0),
        "resolution_rate": F.when(F.col("resolved_count") > 0, _share(F.col("resolved_count"), total)).otherwise(by_answers),
        "escalation_rate": _share(F.col("urgent_count"), total),
        "csat_proxy": _share(F.col("positive_count") + F.col("neutral_count") * 0.5, total),
    })


_DIRECT = ("fcr", "escalated", "reopened")


def totals(messages: DataFrame) -> DataFrame:
    """One row, in one pass, of what ``overall``, ``direct_rates`` and the mean response time are made of."""
    rate = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")) * 100, F.lit(0.0))
    return messages.agg(*_counts(), F.avg("response_time_minutes").alias("response_mean"), *(rate(c).alias(f"{c}_rate") for c in _DIRECT))


def overall_from(row: DataFrame) -> DataFrame:
    """``overall`` of the messages whose ``totals`` these are."""
    given = row.withColumn("avg_response_time_minutes", F.coalesce("response_mean", F.lit(0.0)))
    return _with_rates(given.drop("response_mean", *(f"{c}_rate" for c in _DIRECT)))


def direct_from(row: DataFrame) -> DataFrame:
    """``direct_rates`` of the messages whose ``totals`` these are."""
    own = lambda c, other: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col(other)).alias(other)
    return _with_rates(row).select(*(f"{c}_rate" for c in _DIRECT), own("fcr_rate", "resolution_rate"), own("escalated_rate", "escalation_rate"), F.col("reopened_rate").alias("reopen_rate"))


def direct_rates(messages: DataFrame) -> DataFrame:
    """fcr, escalated and reopened rates; each overrides the derived rate only where it is above 0."""
    return direct_from(totals(messages))


SLA_TIERS = (("< 15m", None, 15.0, "optimal"), ("15m - 60m", 15.0, 60.0, "standard"), ("1h - 4h", 60.0, 240.0, "warning"), ("> 4h", 240.0, None, "critical"))


def sla_tiers(messages: DataFrame) -> DataFrame:
    """Count and share of the four tiers of response time; empty tiers are rows too."""
    minutes, tier = F.col("response_time_minutes"), F.lit(None).cast("int")
    for i, (_, low, high, _) in reversed(list(enumerate(SLA_TIERS))):
        inside = (minutes >= low if low is not None else minutes.isNotNull()) & (minutes < high if high is not None else F.lit(True))
        tier = F.when(inside, i).otherwise(tier)
    counts = messages.groupBy(tier.alias("no")).agg(F.count("*").alias("n"))
    tiers = messages.sparkSession.createDataFrame([(i, name, status) for i, (name, _, _, status) in enumerate(SLA_TIERS)], "no int, tier string, status string")
    out = tiers.join(counts, "no", "left").withColumn("messages", F.coalesce("n", F.lit(0)))
    return out.select("tier", "status", "messages", _share(F.col("messages"), F.sum("messages").over(Window.partitionBy(F.lit(1)))).alias("percentage"))


def sentiment_distribution(messages: DataFrame) -> DataFrame:
    """Count and share of every label, unexpected ones included."""
    out = messages.groupBy(F.coalesce("sentiment", F.lit("Unknown")).alias("sentiment")).agg(F.count("*").alias("messages"))
    return out.withColumn("percentage", F.col("messages") / F.sum("messages").over(Window.partitionBy(F.lit(1))) * 100)


def csat(messages: DataFrame) -> DataFrame:
    """CSAT proxy (positive and half of neutral) and the index 1 + 4 (0.6 FCR + 0.4 (1 - negative))."""
    n = F.greatest(F.count("*"), F.lit(1))
    return messages.agg(((F.count_if(_is("positive")) + F.count_if(_is("neutral")) * 0.5) / n * 100).alias("csat_proxy"), (1 + 4 * (0.6 * F.count_if(F.coalesce("fcr", F.lit(False))) / n + 0.4 * (1 - F.count_if(_is("negative")) / n))).alias("csat_index"))


def weighted_sentiment(messages: DataFrame, candidates: Sequence[str] = ("impressions", "views", "retweet_count", "followers_count", "likes", "reach")) -> DataFrame:
    """Mean sentiment score weighted by the first weight column there is (missing weights are 1), and the negative share."""
    name = labels.first_existing(messages, list(candidates))
    weight = F.coalesce(F.col(name).cast("double"), F.lit(1.0)) if name else F.lit(1.0)
    total = F.sum(weight)
    return messages.agg(F.when(total > 0, F.sum(F.col("sentiment_score") * weight) / total).otherwise(F.avg("sentiment_score")).alias("weighted_sentiment"), (F.count_if(_is("negative")) / F.greatest(F.count("*"), F.lit(1)) * 100).alias("negative_percentage"))


def category_breakdowns(df: DataFrame, skip: Sequence[str] = ("text", "clean_text"), most: int = 50, top: int = 10) -> DataFrame:
    """(column, value, n): the ``top`` values of each string column of at most ``most`` distinct ones.

    An approximate count sorts out the wide columns in one pass, an exact one decides on the rest.
    """
    strings = [c for c, kind in df.dtypes if kind == "string" and c not in skip]
    about = df.agg(*(F.approx_count_distinct(c).alias(c) for c in strings)).first() if strings else {}
    strings = [c for c in strings if about[c] <= most * 1.5]
    if not strings:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    values = df.select(*strings).unpivot([], strings, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("column")
    ranked = values.withColumn("distinct", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "value")))
    return ranked.where((F.col("distinct") <= most) & (F.col("rank") <= top)).select("column", "value", "n")


def dimension_breakdown(messages: DataFrame, top: int = 10) -> DataFrame:
    """(dimension, value, total, negative %, average response, resolution %): the ``top`` of region, company and product.

    One pass: grouping sets count all three dimensions in one shuffle of partial counts.
    """
    cols = ["region", "company", "product"]
    sets = messages.groupingSets([[F.col(c)] for c in cols], *map(F.col, cols))
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if(_is("negative")).alias("negative"), F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)).alias("avg_response"), F.count_if(F.coalesce("fcr", F.lit(False))).alias("resolved"))
    # A bit of the grouping id is 0 for the one column that the row is about.
    name = F.when(F.col("g") == 3, "region").when(F.col("g") == 5, "company").otherwise("product")
    out = out.select(name.alias("dimension"), F.coalesce("region", "company", "product").alias("value"), "total", _share(F.col("negative"), F.col("total")).alias("negative_percentage"), "avg_response", _share(F.col("resolved"), F.col("total")).alias("resolution_rate"))
    out = out.where("value is not null and trim(value) <> '' and not (dimension = 'company' and value rlike '^[0-9]+$')")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("total"), "value"))).where(F.col("rank") <= top)


def company_list(messages: DataFrame, top: int = 50) -> DataFrame:
    """Companies by volume with tone shares, average response and most frequent topic."""
    out = messages.groupBy("company").agg(F.count("*").alias("total"), (F.avg(_is("negative").cast("int")) * 100).alias("negative_percentage"), (F.avg(_is("positive").cast("int")) * 100).alias("positive_percentage"), F.avg("response_time_minutes").alias("avg_response"), F.mode("topic_keywords", True).alias("top_topic"))
    return out.orderBy(F.desc("total"), "company").limit(top)


def spans(messages: DataFrame, most: int = 30) -> DataFrame:
    """First and last day, years, and up to ``most`` companies, products and regions in alphabetical order."""
    columns = {"company": "companies", "product": "products", "region": "regions"}
    values = messages.select(*columns).unpivot([], list(columns), "column", "value").where("value is not null").distinct()
    order = F.row_number().over(Window.partitionBy("column").orderBy(F.lower("value"), "value"))
    first = values.withColumn("place", order).where(F.col("place") <= most)  # a top-k per column, so few rows meet
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("place", "value")))), lambda x: x["value"])
    listed = first.agg(*(of(c).alias(name) for c, name in columns.items()))
    whole = messages.agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_day"), F.array_sort(F.collect_set(F.year("created_at"))).alias("years"))
    return whole.crossJoin(listed)  # one row each


def _generic(topic: Column) -> Column:
    return F.lower(F.trim(topic)).isin(list(W.GENERIC_TOPICS))


def topics_live(messages: DataFrame, top: int = 10) -> DataFrame:
    """Topics by pain = volume (negative share + 0.2), generic ones last: the ``top`` by volume, ranked."""
    out = messages.where("topic_keywords <> 'Pending AI Discovery'").groupBy("topic_keywords").agg(F.count("*").alias("volume"), F.count_if(_is("negative")).alias("negative_complaints"), F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)).alias("avg_response_time"))
    out = out.orderBy(F.desc("volume"), "topic_keywords").limit(top)
    out = out.withColumn("cluster_name", T.cluster_name("topic_keywords")).withColumn("negative_percentage", _share(F.col("negative_complaints"), F.col("volume")))
    out = out.withColumn("pain_score", F.col("volume") * (F.col("negative_complaints") / F.col("volume") + 0.2))
    out = out.withColumn("discovery_pain_score", F.col("pain_score") + F.greatest(F.lit(0.0), F.col("avg_response_time") - 60) / 20)
    return _ranked(out)


def _ranked(topics: DataFrame) -> DataFrame:
    """Rank of at most some ten topic rows: generic last, then by pain."""
    return topics.withColumn("rank", F.row_number().over(Window.orderBy(_generic(F.col("topic_keywords")), F.desc("pain_score"), "topic_keywords")))


def topics_batch(messages: DataFrame, top: int = 10) -> DataFrame:
    """Topics with escalations and resolution; pain adds half the escalation share, generic topics count a twentieth."""
    out = messages.groupBy("topic_keywords").agg(F.count("*").alias("volume"), F.count_if(_is("negative")).alias("negative_complaints"), F.count_if(F.coalesce("escalated", F.lit(False))).alias("escalation_cases"), F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)).alias("avg_response_time"), F.count_if(F.coalesce("fcr", F.lit(False))).alias("resolved"))
    v = F.col("volume")
    out = out.withColumn("cluster_name", T.cluster_name("topic_keywords")).withColumn("negative_percentage", _share(F.col("negative_complaints"), v)).withColumn("resolution_rate", _share(F.col("resolved"), v)).drop("resolved")
    raw = v * (F.col("negative_complaints") / v + F.col("escalation_cases") / v * 0.5 + 0.2)
    out = out.withColumn("pain_score", raw * F.when(_generic(F.col("topic_keywords")), 0.05).otherwise(1.0)).withColumn("documented_pain", F.col("negative_percentage") * v * (1 + F.col("avg_response_time") / 100))
    first = out.orderBy(_generic(F.col("topic_keywords")), F.desc("pain_score"), "topic_keywords").limit(top)
    return _ranked(first)


def topic_samples(messages: DataFrame, per_topic: int = 3) -> DataFrame:
    """(topic_keywords, samples): the first messages of each topic by id, as an array of structs.

    The ranking filter is a top-k per topic, which Spark applies before the shuffle as well.
    """
    ranked = messages.where("trim(text) <> ''").select("topic_keywords", "tweet_id", "text", F.lower("sentiment").alias("sentiment"), "confidence").withColumn("n", F.row_number().over(Window.partitionBy("topic_keywords").orderBy("tweet_id"))).where(F.col("n") <= per_topic)
    return ranked.groupBy("topic_keywords").agg(F.array_sort(F.collect_list(F.struct("n", "tweet_id", "text", "sentiment", "confidence"))).alias("samples"))


def cluster_stats(topics: DataFrame, top: int = 12) -> DataFrame:
    """Escalation rate, priority tier and department of ranked topics."""
    rate, pain = _share(F.col("escalation_cases"), F.col("volume")), F.col("pain_score")
    tier = F.when((pain >= 75) | (rate >= 25), "P0 (Critical Urgent)").when((pain >= 45) | (F.col("negative_percentage") >= 30), "P1 (High Priority)").when((pain >= 20) | (rate >= 10), "P2 (Medium Priority)").otherwise("P3 (Standard Review)")
    return topics.where(F.col("rank") <= top).select("rank", "topic_keywords", "cluster_name", T.department("cluster_name").alias("department"), tier.alias("priority_tier"), F.col("volume").alias("total_cases"), F.col("negative_complaints").alias("complaints"), rate.alias("escalation_rate"), "pain_score")


# Owner, impact and action by words of a topic; the last row is for all others.
RECOMMENDATIONS = (
    (("crash", "freeze", "bug", "stability", "error", "update"), "Engineering", "Critical", "Deploy release hotfix telemetry and triage top stack traces in engineering sprint."),
    (("delivery", "order", "track", "delay", "shipping", "package"), "Logistics", "High Impact", "Audit carrier dispatch pipelines and update live delivery webhook notifications."),
    (("billing", "refund", "charge", "invoice", "payment", "fee"), "Billing Ops", "High Impact", "Enable automated 1-click refund dispute triage and review payment gateway timeout rates."),
    (("login", "password", "auth", "account", "otp", "2fa"), "Security & Auth", "Medium Impact", "Streamline self-service OTP verification and audit session expiration token policies."),
    (("network", "wifi", "signal", "outage", "coverage", "internet"), "Infrastructure", "High Impact", "Audit regional POP server latency and publish real-time network status indicators."),
    ((), "Support Operations", "Operational", "Update frontline support decision trees and deploy targeted priority macros."),
)
WHY_TOPIC = "{volume} conversations with {negative}% negative sentiment."
WHY_SLOW = "Average response time is {response} minutes."
SLA_ALERT = ("Support Operations", "SLA Alert", "Slow first response", "Route high-negative-sentiment conversations to a priority queue with a tighter SLA.")


def _rule(low: Column, rules, field: int) -> Column:
    value = F.lit(rules[-1][field])
    for row in reversed(rules[:-1]):
        value = F.when(T.any_of(low, row[0]), row[field]).otherwise(value)
    return value


def _tenth(c: Column) -> Column:
    return F.format_string("%.1f", F.round(c, 1))


def _filled(sentence: str, **values: Column) -> Column:
    """A sentence with its {names} replaced by values."""
    parts = re.split(r"\{(\w+)\}", sentence)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def recommendations(topics: DataFrame, kpis: DataFrame) -> DataFrame:
    """Up to six actions with their reason: an SLA alert first if answers take over an hour, then one per leading topic."""
    low = F.lower(F.concat_ws(" ", "topic_keywords", "cluster_name"))
    why = _filled(WHY_TOPIC, volume=F.format_number("volume", 0), negative=_tenth(F.col("negative_percentage")))
    rows = topics.where("rank <= 5").select(F.col("rank").alias("no"), _rule(low, RECOMMENDATIONS, 1).alias("owner"), _rule(low, RECOMMENDATIONS, 2).alias("impact"), F.col("cluster_name").alias("issue"), why.alias("why"), _rule(low, RECOMMENDATIONS, 3).alias("action"))
    owner, impact, issue, action = SLA_ALERT
    slow = _filled(WHY_SLOW, response=_tenth(F.col("avg_response_time_minutes")))
    alert = kpis.where("avg_response_time_minutes > 60").select(F.lit(0).alias("no"), F.lit(owner).alias("owner"), F.lit(impact).alias("impact"), F.lit(issue).alias("issue"), slow.alias("why"), F.lit(action).alias("action"))
    return alert.unionByName(rows).withColumn("rank", F.row_number().over(Window.orderBy("no"))).where("rank <= 6").drop("no")


# Likely cause, owner, evidence and fix by words of a topic.
ROOT_CAUSES = (
    (("delivery", "order", "track", "shipment"), "Carrier transit delays, warehouse fulfillment bottlenecks, and tracking status sync lag", "Supply Chain & Logistics",
     "Concentrated delivery inquiries ({volume} cases) with {negative}% negative customer tone.",
     "Integrate real-time carrier tracking webhooks, dispatch proactive delivery ETA notifications, and implement automated one-click reship/credit workflows."),
    (("crash", "freeze", "bug", "glitch", "stability"), "Client build regressions, memory leaks on specific OS versions, and unhandled runtime exceptions", "Mobile & Frontend Engineering",
     "Spike in crash and error reports ({volume} cases) generating high escalation velocity.",
     "Deploy hotfix release addressing top crash stack traces, add automated client exception monitoring, and configure canary release rollbacks."),
    (("bill", "charge", "invoice", "payment"), "Payment gateway timeout retries, double billing authorizations, and unclear subscription recurring terms", "Billing & Payments",
     "Billing dispute volume ({volume} cases) exhibiting elevated manager escalation rates.",
     "Audit payment gateway retry logic, publish instant charge confirmation receipts, and create a priority billing dispute resolution queue."),
    (("login", "password", "auth", "2fa"), "SMS OTP delivery latency, session token timeout expiry, and account lockout friction", "Identity & Security",
     "Repeated authentication failures ({volume} cases) driving customer repeat contact.",
     "Implement multi-provider OTP fallbacks, introduce biometric authentication recovery, and provide self-service automated password reset."),
    (("refund", "cancel", "dispute", "return"), "Delayed bank settlement timelines, multi-day merchant approval queues, and lack of return visibility", "Finance Operations",
     "Refund status inquiries ({volume} cases) driving high reopen rates.",
     "Automate instant wallet credits for pre-verified return scans and provide clear 3-5 day settlement progress trackers."),
)
SLOW_CAUSE = (
    "Support queue triage bottleneck and complex multi-agent ticket transfers", "Support Operations",
    "Mean response SLA of {response}m significantly exceeds baseline average of {average}m.",
    "Implement automated intent-based routing to dedicated subject matter queues and configure automated response macros.",
)
REOPEN_CAUSE = (
    "Premature ticket closure without verified issue resolution", "Support Quality Assurance",
    "High thread reopen rate of {reopen}% indicates incomplete first-contact resolution.",
    "Introduce mandatory customer resolution confirmation checks prior to case closure and revise agent troubleshooting scripts.",
)
OTHER_CAUSE = (
    "Standard operational support inquiries and general service assistance", "Customer Care",
    "Routine customer service demand ({volume} cases) resolved through standard channels.",
    "Publish self-service FAQ knowledge base articles and expand AI automated deflection capabilities.",
)


def root_causes(topics: DataFrame, avg_response: Column, reopen_rate: Column, top: int = 6) -> DataFrame:
    """Likely cause, owner, evidence, fix and severity of the first eight topics; the ``top`` by severity."""
    low = F.lower("topic_keywords")
    values = {"volume": F.format_number("volume", 0), "negative": _tenth(F.col("negative_percentage")), "response": _tenth(F.col("avg_response_time")), "average": _tenth(avg_response), "reopen": _tenth(reopen_rate)}

    def field(i: int) -> Column:
        say = lambda row: _filled(row[i], **values)
        value = F.when(F.col("avg_response_time") > F.greatest(F.lit(60.0), avg_response * 1.15), say(SLOW_CAUSE)).when(reopen_rate > 15, say(REOPEN_CAUSE)).otherwise(say(OTHER_CAUSE))
        for words, *row in reversed(ROOT_CAUSES):
            value = F.when(T.any_of(low, words), say(row)).otherwise(value)
        return value

    severity = F.col("volume") * (F.col("negative_percentage") / 100 + 0.2) + F.col("escalation_cases") * 0.5 + F.greatest(F.lit(0.0), F.col("avg_response_time") - 60) / 20
    out = topics.where("rank <= 8").select("topic_keywords", "cluster_name", *(field(i).alias(name) for i, name in enumerate(("likely_root_cause", "owner", "evidence", "recommended_fix"))), severity.alias("severity_score"), "volume")
    return out.withColumn("severity_rank", F.row_number().over(Window.orderBy(F.desc("severity_score"), "topic_keywords"))).where(F.col("severity_rank") <= top)


def priorities(topics: DataFrame) -> DataFrame:
    """High, Medium or Normal per topic, in that order."""
    level = F.when((F.col("negative_complaints") > 5) | (F.col("escalation_cases") > 3), 0).when(F.col("volume") > 8, 1).otherwise(2)
    out = topics.select("topic_keywords", "volume", "negative_complaints", level.alias("level"))
    return out.withColumn("priority", F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Normal")), F.col("level") + 1)).orderBy("level", F.desc("volume"), "topic_keywords").drop("level")


def escalation_multiplier(messages: DataFrame) -> DataFrame:
    """max(1, 10 (negative + urgent) / all)."""
    share = (F.count_if(_is("negative")) + F.count_if(_urgent())) / F.greatest(F.count("*"), F.lit(1))
    return messages.agg(F.greatest(F.lit(1.0), share * 10).alias("multiplier"))


def warehouse_kpis(messages: DataFrame, top: int = 10) -> DataFrame:
    """Issue volumes of the warehouse layer with coverage of response times and of readable flags."""
    out = messages.groupBy("topic_keywords").agg(F.count("*").alias("volume"), F.avg(F.coalesce("response_time_minutes", F.lit(0.0))).alias("avg_response"), (F.count("response_time_minutes") / F.count("*")).alias("response_coverage"), F.avg(F.col("resolution_status").try_cast("boolean").cast("int")).alias("readable_flags"))
    return out.orderBy(F.desc("volume"), "topic_keywords").limit(top)


def quadrants(topics: DataFrame) -> DataFrame:
    """critical, emerging, routine or baseline: volume against the upper median, negative share against 24 %."""
    by_volume = Window.orderBy("volume", "topic_keywords")
    ranked = topics.withColumn("n", F.row_number().over(by_volume))
    middle = ranked.agg(F.floor(F.count("*") / 2).alias("half")).join(ranked, F.col("n") == F.col("half") + 1).select(F.col("volume").alias("median_volume"))
    large, bad = F.col("volume") >= F.col("median_volume"), F.col("negative_percentage") >= 24
    return topics.crossJoin(F.broadcast(middle)).select("topic_keywords", "volume", "negative_percentage", F.when(large & bad, "critical").when(bad, "emerging").when(large, "routine").otherwise("baseline").alias("quadrant"))


def region_topic_matrix(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Volume and average response of each region by topic; topics are the pivot's fixed columns."""
    names = {t: f"t{i}" for i, t in enumerate(topics)}
    out = messages.groupBy("region").pivot("topic_keywords", list(topics)).agg(F.count(F.lit(1)).alias("volume"), F.avg("response_time_minutes").alias("response"))
    return out.select("region", *(F.coalesce(F.col(f"`{t}_volume`"), F.lit(0)).alias(f"{n}_volume") for t, n in names.items()), *(F.col(f"`{t}_response`").alias(f"{n}_response") for t, n in names.items()))


def quality_scores(messages: DataFrame) -> DataFrame:
    """Six scores of 0 to 100 and their mean: FCR, SLA, escalation, reopening, tone, velocity."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    rate = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")) * 100, F.lit(0.0))
    out = messages.agg(
        clip(rate("fcr")).alias("fcr_score"), clip(F.coalesce(F.avg((F.col("response_time_minutes") < 60).cast("int")) * 100, F.lit(0.0))).alias("sla_score"), clip(100 - rate("escalated")).alias("escalation_score"),
        clip(100 - rate("reopened")).alias("reopen_score"), clip(100 - F.avg(_is("negative").cast("int")) * 100).alias("sentiment_score"), clip(100 - F.coalesce(F.avg("response_time_minutes"), F.lit(0.0)) / 240 * 100).alias("velocity_score"),
    )
    parts = ("fcr_score", "sla_score", "escalation_score", "reopen_score", "sentiment_score", "velocity_score")
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return out.withColumn("overall_score", total / len(parts))
