"""Queries of sources, sinks and streams: each writes to the shared folder and returns what it reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.functions import text as X
from vocspark.functions import wordlists as W
from vocspark.operators import dispatch
from vocspark.plans.kpi_queries import _OVERALL, _OVERALL_RATES
from vocspark.plans.message_queries import _STATES
from vocspark.plans.registry import over_events, register
from vocspark.plans.text_queries import SQL, _any, text
from vocspark.sources import adapters, io
from vocspark.sources.shared import fresh
from vocspark.streaming import jobs

_EV = f"with {adapters.EVENTS_SQL}"
_CV = f"with {adapters.CONVERSATIONS_SQL}"


def _raw(spark, d):
    m = adapters.from_conversations(spark, d)
    return m.select("tweet_id", "author_id", F.col("inbound").cast("string").alias("inbound"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "text", "response_tweet_id", F.col("in_response_to_tweet_id").cast("string").alias("in_response_to_tweet_id"))


def _a1(spark, d):
    path = fresh(spark, "csv")
    io.write_csv(_raw(spark, d), path)
    good, bad = io.read_csv(spark, path)
    return good.select("tweet_id", "author_id", "inbound", F.md5("text").alias("text_md5"), F.lit(None).cast("string").alias("bad")).unionByName(bad.select(F.lit(None).cast("long").alias("tweet_id"), F.lit(None).cast("string").alias("author_id"), F.lit(None).cast("string").alias("inbound"), F.lit(None).cast("string").alias("text_md5"), F.col("_corrupt_record").alias("bad")))


register("a1_csv_round_trip", _a1, f"{_CV} select tweet_id, author_id, cast(inbound as varchar) as inbound, md5(text) as text_md5, cast(null as varchar) as bad from cv")
_TARGET = T.StructType([T.StructField("TWEET_ID", T.LongType()), T.StructField("Author_Id", T.StringType()), T.StructField("RESPONSE_TIME_MINUTES", T.DoubleType()), T.StructField("MISSING", T.StringType())])
over_events("a3_match_columns", lambda m: io.match_columns(m, _TARGET).withColumnsRenamed({"TWEET_ID": "tweet_id", "Author_Id": "author_id", "RESPONSE_TIME_MINUTES": "minutes", "MISSING": "missing"}), "select tweet_id, author_id, response_time_minutes as minutes, cast(null as varchar) as missing from ev")


def _a3_bad(spark, d):
    raw = adapters.from_events(spark, d).select(F.when(F.col("tweet_id") % 7 == 0, F.concat(F.lit("n"), "tweet_id")).otherwise(F.col("tweet_id").cast("string")).alias("Tweet_ID"), F.col("author_id"), F.when(F.col("tweet_id") % 5 == 0, F.lit("slow")).when(F.col("tweet_id") % 3 != 0, F.col("response_time_minutes").cast("string")).alias("response_time_minutes"))
    good, bad = io.match_rows(raw, _TARGET)
    return good.groupBy(F.lit("").alias("bad_columns")).agg(F.count("*").alias("n"), F.sum(F.coalesce("TWEET_ID", F.lit(0))).alias("ids")).unionByName(bad.groupBy(F.array_join("bad_columns", ",").alias("bad_columns")).agg(F.count("*").alias("n"), F.sum(F.regexp_replace("Tweet_ID", "n", "").cast("long")).alias("ids")))


register("a3_bad_rows", _a3_bad, f"{_EV}, r as (select tweet_id, concat_ws(',', case when tweet_id % 7 = 0 then 'TWEET_ID' end, case when tweet_id % 5 = 0 then 'RESPONSE_TIME_MINUTES' end) as bad_columns from ev) select bad_columns, count(*) as n, cast(sum(tweet_id) as bigint) as ids from r group by 1")


def _a4(spark, d):
    m = adapters.from_events(spark, d).select(F.when(F.col("tweet_id") % 5 == 0, F.concat(F.lit("x"), F.col("tweet_id").cast("string"))).otherwise(F.col("tweet_id").cast("string")).alias("tweet_id"), "author_id", "created_at", "text", F.when(F.col("tweet_id") % 2 == 0, F.col("priority")).alias("priority"))
    path = fresh(spark, "raw")
    io.append_messages(io.with_defaults(m, "run_z"), path)
    return spark.read.parquet(path).groupBy("dataset_run_id", "sentiment", "topic_keywords", "priority").agg(F.count("*").alias("n"), F.count_if(F.col("tweet_id").isNotNull()).alias("with_id"))


register("a4_append_defaults", _a4, f"{_EV} select 'run_z' as dataset_run_id, 'pending' as sentiment, 'Pending AI Discovery' as topic_keywords, case when tweet_id % 2 = 0 then priority else 'normal' end as priority, count(*) as n, count(*) as with_id from ev group by 4")


def _a5(spark, d):
    path = fresh(spark, "enriched")
    io.append_messages(io.enriched(jobs.enrich(adapters.from_events(spark, d))), path)
    return spark.read.parquet(path).groupBy("dataset_run_id", "detected_language", "sentiment", "cluster_name").agg(F.count("*").alias("n"))


_TOPIC = "case " + " ".join(f"when {_any('clean', s)} then {text(k)}" for _, k, s in W.TOPIC_DOMAINS) + f" else {text(W.OTHER_TOPIC[1])} end"
_NEG, _POS = _any("lower(text)", W.NEGATIVE_STEMS), _any("lower(text)", W.POSITIVE_STEMS)
_ENRICHED = f"""en as (select *, {SQL['language']('text')} as detected_language, case when {_NEG} and not {_POS} then 'negative' when {_POS} and not {_NEG} then 'positive' else 'neutral' end as s2, {_TOPIC} as t2 from (select *, {SQL['clean']('text')} as clean from ev))"""
register("a5_enriched", _a5, f"{_EV}, {_ENRICHED} select dataset_run_id, detected_language, s2 as sentiment, {SQL['cluster']('t2')} as cluster_name, count(*) as n from en group by all")


def _a6(spark, d):
    m = adapters.from_events(spark, d).withColumn("clean_text", F.when(F.col("tweet_id") % 2 == 0, F.lit("kept"))).select("tweet_id", "dataset_run_id", "clean_text", "sentiment")
    new = adapters.from_events(spark, d).where("tweet_id % 3 <> 0").select("tweet_id", "dataset_run_id", F.lit("new").alias("clean_text"), F.lit("filled").alias("sentiment"))
    path = fresh(spark, "filled")
    io.replace_runs(io.fill_in(m, new, ["clean_text", "sentiment"], only_empty="clean_text"), path)
    return spark.read.parquet(path).select("tweet_id", "clean_text", "sentiment")


register("a6_fill_in", _a6, f"{_EV} select tweet_id, case when tweet_id % 2 = 0 then 'kept' when tweet_id % 3 <> 0 then 'new' end as clean_text, case when tweet_id % 2 <> 0 and tweet_id % 3 <> 0 then 'filled' else sentiment end as sentiment from ev")
over_events(
    "a7_kpi_upsert",
    lambda m: (lambda k: io.upsert(k, k.where("dataset_run_id = 'run_b'").withColumns({"total": F.lit(-1).cast("long"), "created_at": F.col("created_at") + F.expr("interval 1 day")}), ["dataset_run_id", "period"]).select("dataset_run_id", "period", "total"))(m.groupBy("dataset_run_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("total"), F.max("created_at").alias("created_at"))),
    "select dataset_run_id, strftime(created_at, '%Y-%m') as period, case when dataset_run_id = 'run_b' then -1 else count(*) end as total from ev group by 1, 2",
)


def _a8(spark, d):
    path = fresh(spark, "runs")
    kpis = adapters.from_events(spark, d).groupBy("dataset_run_id", "sentiment").agg(F.count("*").alias("n"))
    io.replace_runs(kpis, path)
    io.replace_runs(kpis.where("dataset_run_id = 'run_b'").withColumn("n", F.col("n") * 2), path)
    return spark.read.parquet(path)


register("a8_replace_run", _a8, f"{_EV} select dataset_run_id, sentiment, count(*) * case when dataset_run_id = 'run_b' then 2 else 1 end as n from ev group by 1, 2")
over_events("a9_payloads", lambda m: io.payloads(m.groupBy("dataset_run_id").agg(F.count("*").alias("n"), F.min("sentiment").alias("s")), ["dataset_run_id"]), "select dataset_run_id, '{\"n\":' || count(*) || ',\"s\":\"' || min(sentiment) || '\"}' as payload from ev group by 1")


def _a10(spark, d):
    path = fresh(spark, "kept")
    io.append_messages(adapters.from_events(spark, d), path)
    io.drop_run(spark, path, "run_a")
    return spark.read.parquet(path).groupBy("dataset_run_id").agg(F.count("*").alias("n"))


register("a10_delete_run", _a10, f"{_EV} select dataset_run_id, count(*) as n from ev where dataset_run_id <> 'run_a' group by 1")


def _a12(spark, d):
    path = fresh(spark, "export")
    io.write_csv(adapters.from_events(spark, d).select(F.col("tweet_id").alias("Message ID"), F.col("sentiment").alias("Tone"), F.col("text").alias("Text")), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("`Message ID` long, Tone string, Text string").csv(path)
    return back.select(F.col("Message ID").alias("tweet_id"), F.col("Tone").alias("tone"), F.md5("Text").alias("text_md5"))


register("a12_export_csv", _a12, f"{_EV} select tweet_id, sentiment as tone, md5(text) as text_md5 from ev")
over_events("a13_latest_runs", lambda m: io.latest_runs(m, 1).select("dataset_run_id", "records"), "select dataset_run_id, count(*) as records from ev where dataset_run_id = 'run_b' group by 1")


def _legacy(spark, d):
    m = adapters.from_events(spark, d)
    topics = m.groupBy("dataset_run_id", F.col("topic_keywords").alias("topic")).agg(F.count("*").alias("volume"))
    listed = topics.groupBy("dataset_run_id").agg(F.array_sort(F.collect_list(F.struct("topic", "volume"))).alias("topics"), F.array_sort(F.collect_set("topic")).alias("new_issues"), F.array_sort(F.collect_set(F.when(F.col("volume") > 1000, F.col("topic")))).alias("recurring_issues"))
    return listed.select(F.col("dataset_run_id").alias("run_id"), F.to_json(F.struct("topics", "new_issues", "recurring_issues")).alias("payload")), topics.where("topic = 'General Support'").select(F.col("dataset_run_id").alias("run_id"), "topic")


register("a14_migrate_topics", lambda spark, d: io.migrate_topics(*_legacy(spark, d)), f"{_EV} select dataset_run_id as run_id, topic_keywords as topic, count(*) as volume from ev where topic_keywords <> 'General Support' group by 1, 2")
register("a14_migrate_issues", lambda spark, d: io.migrate_issues(_legacy(spark, d)[0]), f"{_EV}, t as (select dataset_run_id as run_id, topic_keywords as issue, count(*) as n from ev group by 1, 2) select run_id, 'new' as kind, issue from t union all select run_id, 'recurring', issue from t where n > 1000")


def _history(m):
    return m.select(F.col("conversation_id").alias("run_id"), F.col("created_at").alias("at"), F.col("tweet_id").alias("seq"), F.col("priority").alias("status"), F.col("sentiment").alias("message"))


over_events("a15_current_status", lambda m: io.current_status(_history(m)), "select conversation_id as run_id, arg_max(priority, (created_at, tweet_id)) as status, arg_max(sentiment, (created_at, tweet_id)) as message from ev group by 1")
over_events("a15_last_rows", lambda m: io.last_rows(_history(m)).select("run_id", "seq"), "select conversation_id as run_id, tweet_id as seq from ev order by created_at desc, tweet_id desc limit 15")


# --- streams
def _source(spark, d, name):
    """Messages as the files of a stream: a write for every eight days, since a stream takes files by their age; a conversation is in one file."""
    path = fresh(spark, name)
    m = adapters.from_events(spark, d)
    for first in range(1, 32, 8):
        m.where(F.dayofmonth("created_at").between(first, first + 7)).repartition("conversation_id").write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, m.schema, 8)


def _a2(spark, d):
    path, out, log, point = (fresh(spark, n) for n in ("stream-csv", "stream-out", "stream-log", "stream-point"))
    io.write_csv(_raw(spark, d).repartition(3), path)
    jobs.ingest(jobs.read_csv_stream(spark, path).select("tweet_id", "text"), out, log, point, "run_s").awaitTermination()
    return spark.read.parquet(out).groupBy("dataset_run_id", "detected_language").agg(F.count("*").alias("n"))


register("a2_stream_csv", _a2, f"with {adapters.CONVERSATIONS_SQL} select 'run_s' as dataset_run_id, {SQL['language']('text')} as detected_language, count(*) as n from cv group by 2")


def _ingested(spark, d):
    out, log, point = (fresh(spark, n) for n in ("ingest-out", "ingest-log", "ingest-point"))
    jobs.ingest(_source(spark, d, "ingest-in"), out, log, point, "run_s").awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(log)


def _final_kpi(spark, d):
    kept = jobs.ingest_run(_source(spark, d, "kpi-in"), fresh(spark, "kpi-run"), "run_s")
    return kept.drop("conversations").withColumn("avg_response_time_minutes", F.round("avg_response_time_minutes", 6))


_FINAL = _OVERALL.replace("sentiment", "s2").replace("from ev)", "from en)").replace("avg(response_time_minutes)", "round(avg(response_time_minutes), 6)")
register("j1_final_kpi", _final_kpi, f"{_EV}, {_ENRICHED}, {_FINAL} select *, 'run_s' as dataset_run_id, {_OVERALL_RATES} from ov")
register("j1_stream_ingest", lambda spark, d: _ingested(spark, d)[0].groupBy("sentiment", "topic_keywords").agg(F.count("*").alias("n")), f"{_EV}, {_ENRICHED} select s2 as sentiment, t2 as topic_keywords, count(*) as n from en group by 1, 2")
register("j2_stream_progress", lambda spark, d: jobs.cumulative(_ingested(spark, d)[1]).groupBy("dataset_run_id", "status").agg(F.max("total_rows").alias("total_rows")), f"{_EV} select 'run_s' as dataset_run_id, 'written' as status, count(*) as total_rows from ev")


def _j3(spark, d):
    m = adapters.from_events(spark, d).withColumn("detected_language", F.when(F.col("tweet_id") % 4 == 0, F.lit("xx")))
    found = m.where("detected_language is null").select("tweet_id", "dataset_run_id", X.detect_language("text").alias("detected_language"))
    path = fresh(spark, "backfill")
    io.replace_runs(io.fill_in(m, found, ["detected_language"], only_empty="detected_language"), path)
    return spark.read.parquet(path).select("tweet_id", "detected_language")


register("j3_backfill_language", _j3, f"{_EV} select tweet_id, case when tweet_id % 4 = 0 then 'xx' else {SQL['language']('text')} end as detected_language from ev")


def _arrivals(spark, d, name, stream, mode, newest_first=False):
    """``stream`` over messages that arrive eight days at a time, then late ones, then one that closes all windows; its output as a table.

    With ``newest_first`` sixteen days come in two parts, the afternoons before the mornings.
    """
    path, out, point = fresh(spark, f"{name}-in"), fresh(spark, f"{name}-out"), fresh(spark, f"{name}-point")
    m = adapters.from_events(spark, d)
    days = lambda first, n: m.where(F.dayofmonth("created_at").between(first, first + n - 1))
    if newest_first:
        parts = [days(first, 16).where((F.hour("created_at") < 12) == morning) for first in (1, 17) for morning in (False, True)]
    else:
        parts = [days(first, 8) for first in range(1, 32, 8)]
    late = m.where(F.dayofmonth("created_at") <= 2).withColumn("conversation_id", F.concat(F.lit("late-"), "conversation_id"))
    close = m.where("tweet_id = 1").withColumns({"created_at": F.lit("2030-01-01").cast("timestamp"), "conversation_id": F.lit("close")})
    for part in (*parts, late, close):
        part.write.mode("append").parquet(path)
        found = jobs.run_to_files(stream(jobs.read_stream(spark, path, m.schema, 10_000)), out, point, mode)
    return found


def _j4(spark, d):
    return _arrivals(spark, d, "trend", lambda m: jobs.trend(m, "1 day", "1 hour"), "append").drop("batch_id")


register("j4_stream_trend", _j4, f"{_EV} select strftime(created_at, '%Y-%m-%d 00:00') as period, count(*) as total, count(*) filter (sentiment = 'positive') as positive, count(*) filter (sentiment = 'negative') as negative, count(*) filter (inbound) as inbound from ev group by 1")


def _j5(spark, d):
    states = _arrivals(spark, d, "state", lambda m: jobs.conversation_states(m, "17 days"), "update", newest_first=True).where("conversation_id <> 'close' and conversation_id not like 'late-%'")
    last = states.groupBy("conversation_id").agg(F.max_by(F.struct("messages_count", "reopened", "resolved", "escalated", "ended"), F.struct("messages_count", "ended")).alias("s"))
    return last.select("conversation_id", "s.*")


register("j5_stream_states", _j5, f"{_EV}, {_STATES.replace(' from cv ', ' from ev ')} select conversation_id, messages_count, reopened, resolved, escalated, true as ended from st")
register("dispatch_overall", lambda spark, d: dispatch.run_metrics(adapters.from_events(spark, d), ["overall"], sentiment="negative")["overall"].select("total_records", "urgent_count"), f"{_EV} select count(*) as total_records, count(*) filter (priority in ('high', 'urgent', 'critical')) as urgent_count from ev where sentiment = 'negative'")
_SLICE = f"{_EV}, sl as (select * from ev where sentiment = 'negative')"
register("dispatch_response_time", lambda spark, d: dispatch.run_metrics(adapters.from_events(spark, d), ["response_time"], sentiment="negative")["response_time"], f"{_SLICE} select avg(response_time_minutes) as average_response_time_minutes from sl")
register("dispatch_rates", lambda spark, d: (lambda r: r["fcr"].crossJoin(r["reopen_rate"]).crossJoin(r["resolution_rate"]))(dispatch.run_metrics(adapters.from_events(spark, d), ["fcr", "reopen_rate", "resolution_rate"])), f"{_EV} select avg(fcr::int) * 100 as fcr_rate, avg(reopened::int) * 100 as reopen_rate, avg(fcr::int) * 100 as resolution_rate from ev")
register(
    "dispatch_comparative_delta",
    lambda spark, d: dispatch.run_metrics(adapters.from_events(spark, d), ["comparative_delta"])["comparative_delta"].where("metric in ('total_records', 'negative_percentage')").select("metric", "current", "previous", "delta"),
    f"{_EV}, c as (select * from ev where created_at >= (select max(created_at) - interval 30 day from ev)), v as (select 'total_records' as metric, (select count(*) from c)::double as current, (select count(*) from ev)::double as previous union all select 'negative_percentage', (select avg((sentiment = 'negative')::int) * 100 from c), (select avg((sentiment = 'negative')::int) * 100 from ev)) select *, current - previous as delta from v",
)


def _all_metrics(spark, d):
    found = dispatch.run_metrics(adapters.from_events(spark, d), sorted(dispatch.METRICS))
    counts = [df.agg(F.lit(name).alias("metric"), F.count("*").alias("rows")) for name, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b), counts).where("rows > 0").select("metric")


_ONE_ROW = ("kpi_summary", "response_time", "resolution_rate", "escalation_rate", "reopen_rate", "fcr")


def _values(spark, d):
    """(metric, name, value) of the metrics that are one row, all from one pass."""
    found = dispatch.run_metrics(adapters.from_events(spark, d), _ONE_ROW)
    long = [df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns)).unpivot([], df.columns, "name", "value").withColumn("metric", F.lit(m)) for m, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b), long).select("metric", "name", "value")


_OVERALL_NAMES = (
    "total_records", "negative_count", "positive_count", "neutral_count", "avg_response_time_minutes", "urgent_count", "inbound_count", "outbound_count", "resolved_count",
    "negative_percentage", "positive_percentage", "neutral_percentage", "resolution_rate", "escalation_rate", "csat_proxy",
)
_RATE_ROWS = {"response_time": ("average_response_time_minutes", "avg_response_time_minutes"), "resolution_rate": ("resolution_rate",) * 2, "escalation_rate": ("escalation_rate",) * 2}
register(
    "dispatch_values",
    _values,
    f"{_EV}, {_OVERALL}, o as (select *, {_OVERALL_RATES} from ov), r as (select 'kpi_summary' as metric, unnest([" + ", ".join(f"{{'name': '{c}', 'value': round({c}::double, 6)}}" for c in _OVERALL_NAMES) + "]) as x from o"
    + "".join(f" union all select '{m}', {{'name': '{name}', 'value': round({c}::double, 6)}} from o" for m, (name, c) in _RATE_ROWS.items())
    + " union all select 'fcr', {'name': 'fcr_rate', 'value': round(avg(fcr::int) * 100, 6)} from ev union all select 'reopen_rate', {'name': 'reopen_rate', 'value': round(avg(reopened::int) * 100, 6)} from ev) select metric, x.name as name, x.value as value from r",
)
register("dispatch_all", _all_metrics, "select unnest([" + ", ".join(f"'{n}'" for n in sorted(dispatch.METRICS)) + "]) as metric from (select count(*) as n from events) where n > 0")
