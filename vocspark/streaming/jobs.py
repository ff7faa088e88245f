"""Structured Streaming: ingestion by micro-batches, windowed trends, conversation state."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vocspark.functions import text as X
from vocspark.functions import wordlists as W
from vocspark.operators import kpi
from vocspark.sources import io


def enrich(messages: DataFrame) -> DataFrame:
    """Clean text, language, sentiment and topic: no shuffle, the same for a batch and a stream."""
    m = messages.withColumn("clean_text", X.clean_text("text")).withColumn("detected_language", X.detect_language("text"))
    m = m.withColumn("_s", X.sentiment_fast("text")).withColumn("_t", X.topic_rule("clean_text"))
    m = m.withColumns({"sentiment": F.col("_s.sentiment"), "sentiment_score": F.col("_s.score"), "topic_id": F.col("_t.topic_id"), "topic_keywords": F.col("_t.topic_keywords")})
    return m.withColumn("cluster_name", X.cluster_name("topic_keywords")).drop("_s", "_t")


def ingest(stream: DataFrame, out: str, progress: str, checkpoint: str, run_id: str, partials: str | None = None) -> StreamingQuery:
    """Enrich each micro-batch and write it with a progress row; ends when all input there is has been read.

    A batch has a partition of its own, which a retry overwrites, so rows are written once. Progress
    has its rows, seconds and rows a second. With ``partials``, a batch also leaves its part of the
    run's KPI there (``kpi.overall_sums``), made of the rows that it wrote; a retry replaces it too.
    """

    def write(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        named = lambda df: df.withColumns({"dataset_run_id": F.lit(run_id), "batch_id": F.lit(number)})
        save = lambda df, path: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_run_id", "batch_id").parquet(path)
        rows = named(enrich(batch))
        save(rows, out)
        done = batch.sparkSession.read.schema(rows.schema).parquet(out).where((F.col("dataset_run_id") == run_id) & (F.col("batch_id") == number))
        if partials:
            save(named(kpi.overall_sums(done)), partials)
        counted = done.agg(F.count("*").alias("rows"))
        seconds = F.lit(max(0.05, time.monotonic() - began))
        save(named(counted.withColumns({"status": F.lit("written"), "seconds": seconds, "rows_per_second": F.col("rows") / seconds})), progress)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_kpi(partials: DataFrame) -> DataFrame:
    """The KPI of each run (``kpi.overall`` and an estimate of its conversations) from what its batches left.

    Sums are added and sketches of conversation ids merged, so no message is read again.
    """
    return kpi.overall_of(kpi.merged_sums(partials, "dataset_run_id"))


def ingest_run(stream: DataFrame, folder: str, run_id: str) -> DataFrame:
    """``ingest`` to its end, then one row of ``final_kpi`` for the run in ``folder``/summary, which is returned.

    The run's status (running, then completed or failed) is appended to ``folder``/status; a failed
    run raises, and the same call goes on after the last whole batch.
    """
    spark = stream.sparkSession
    say = lambda status: spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{folder}/status")
    say("running")
    try:
        ingest(stream, f"{folder}/rows", f"{folder}/progress", f"{folder}/checkpoint", run_id, f"{folder}/partials").awaitTermination()
        one = final_kpi(spark.read.parquet(f"{folder}/partials").where(F.col("dataset_run_id") == run_id))
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_run_id").parquet(f"{folder}/summary")
    except Exception:
        say("failed")
        raise
    say("completed")
    return spark.read.parquet(f"{folder}/summary").where(F.col("dataset_run_id") == run_id)


def cumulative(progress: DataFrame) -> DataFrame:
    """Progress with the rows of all batches so far."""
    from pyspark.sql import Window

    return progress.withColumn("total_rows", F.sum("rows").over(Window.partitionBy("dataset_run_id").orderBy("batch_id")))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, source: str = "parquet", **options: object) -> DataFrame:
    reader = spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **options)
    return reader.option("header", True).csv(path) if source == "csv" else reader.format(source).load(path)


def read_csv_stream(spark: SparkSession, path: str, files_per_batch: int = 1, rows: int = 1000) -> DataFrame:
    """CSV files as a stream whose schema is resolved once, on the first ``rows`` of those that are there."""
    return read_stream(spark, path, io.csv_schema(spark, path, rows), files_per_batch, "csv", multiLine=True, escape='"')


def trend(messages: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tone per tumbling window; on a stream in append mode, a window is a row once the watermark has passed it, and later rows are left out."""
    rows = messages.withWatermark("created_at", late).groupBy(F.window("created_at", size).alias("w"))
    tone = lambda s: F.count_if(F.lower("sentiment") == s)
    out = rows.agg(F.count("*").alias("total"), tone("positive").alias("positive"), tone("negative").alias("negative"), F.count_if("inbound").alias("inbound"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("period"), "total", "positive", "negative", "inbound")


STATES = "conversation_id string, messages_count long, reopened boolean, resolved boolean, escalated boolean, ended boolean"
#: What is kept of a message, ``n`` of them where it stands for others; ``until`` is when its conversation ends, in milliseconds.
KEPT = pa.schema([("conversation_id", pa.string()), *((c, pa.int64()) for c in ("at", "id", "n", "until")), *((c, pa.bool_()) for c in ("into", "out", "urgent"))])
#: Conversations are dealt to so many groups by hash; all of a group are updated at once.
GROUPS = 1_024
#: Places of messages without a time, or an id.
FIRST = -(2**62)


def _unpacked(kept: bytes | None) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(kept).read_all() if kept else KEPT.empty_table()
    return {c: table.column(c).to_numpy() for c in KEPT.names}


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, KEPT, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(pa.table([pa.array(rows[c], KEPT.field(c).type) for c in KEPT.names], schema=KEPT))
    return sink.getvalue().to_pybytes()


def _merged(rows: dict[str, np.ndarray], new: np.ndarray, watermark: int, idle_ms: int) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """The conversations that ``new`` rows changed or that end, and the messages to keep of the others: of each the first and last
    of an agent, the last of the customer and the last of all, which has the count and the flag of the whole."""
    code, names = pd.factorize(rows["conversation_id"], use_na_sentinel=False)
    order = np.lexsort((rows["id"], rows["at"], code))
    code, new, rows = code[order], new[order], {c: v[order] for c, v in rows.items()}
    at, number, place = rows["at"], rows["id"], np.arange(len(code))
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    last = np.append(starts[1:], len(code)) - 1
    lowest, highest = (lambda yes: np.minimum.reduceat(np.where(yes, place, len(code)), starts)), (lambda yes: np.maximum.reduceat(np.where(yes, place, -1), starts))
    first_out, last_out, last_in = lowest(rows["out"]), highest(rows["out"]), highest(rows["into"])
    n, urgent, changed = np.add.reduceat(rows["n"], starts), np.logical_or.reduceat(rows["urgent"], starts), np.logical_or.reduceat(new, starts)
    until = np.where(changed, np.maximum(at[last] // 1000 + idle_ms, watermark + 1), np.maximum.reduceat(rows["until"], starts))
    ended = ~changed & (until < watermark)
    a, b = np.minimum(first_out, len(code) - 1), last_in
    reopened = (first_out < len(code)) & (b >= 0) & ((at[a] < at[b]) | ((at[a] == at[b]) & (number[a] < number[b])))
    resolved = (last_out >= 0) & (at[last_out] == at[last]) & (number[last_out] == number[last])
    shown = changed | ended
    out = pd.DataFrame({"conversation_id": names[code[starts]], "messages_count": n, "reopened": reopened, "resolved": resolved, "escalated": urgent, "ended": ended})[shown]
    for c, values, none in (("n", n, 0), ("urgent", urgent, False), ("until", until, FIRST)):
        rows[c] = np.full(len(code), none)
        rows[c][last] = values
    kept = np.zeros(len(code) + 1, dtype=bool)  # a place more for those that are not there
    for of in (first_out, last_out, last_in, last):
        kept[of[~ended]] = True
    return out, {c: v[kept[:-1]] for c, v in rows.items()}


def _update(idle_ms: int):
    def update(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, watermark = [_unpacked(state.get[0] if state.exists else None)], state.getCurrentWatermarkMs()
        held = len(parts[0]["at"])
        for part in () if state.hasTimedOut else batches:
            parts.append({c: part[c].to_numpy() for c in ("conversation_id", "at", "id", "into", "out", "urgent")} | {"n": np.ones(len(part), np.int64), "until": np.full(len(part), FIRST)})
        rows = {c: np.concatenate([p[c].astype(object if c == "conversation_id" else bool if c in ("into", "out", "urgent") else np.int64) for p in parts]) for c in KEPT.names}
        out, kept = _merged(rows, np.arange(len(rows["at"])) >= held, watermark, idle_ms)
        if len(kept["at"]):
            state.update((_packed(kept),))
            state.setTimeoutTimestamp(int(kept["until"][kept["until"] > FIRST].min()))  # not before the watermark, as others ended
        else:
            state.remove()
        if len(out):
            yield out

    return update


def conversation_states(messages: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """A row per conversation and batch with its state so far; the last one is the conversation's.

    Messages count by their place (time, id) and not by arrival: a customer has come back if their
    last message is behind the first of an agent, and the conversation is resolved if an agent's
    message is the last of all. So the state is four messages at most, a count and a flag per
    conversation, whatever the batches, and equals that of a batch run over the same messages. A
    message of unknown side counts but is of neither; without a time it is before all others,
    without an id before those of its time. A conversation whose last message is ``idle_ms`` older
    than the watermark ends: it has a last row with ``ended``, and its state goes.

    The state of a conversation is kept with those of others with a near hash (``GROUPS``), so that
    a batch costs a call for each of these and not for each conversation.
    """
    into, urgent = F.coalesce("inbound", F.lit(False)), F.lower("priority").isin(list(W.URGENT)) | (F.lower("sentiment") == "negative")
    rows = messages.withWatermark("created_at", late).select(
        "conversation_id", "created_at", F.coalesce(F.unix_micros("created_at"), F.lit(FIRST)).alias("at"), F.coalesce("tweet_id", F.lit(FIRST)).alias("id"),
        into.alias("into"), F.coalesce(~F.col("inbound"), F.lit(False)).alias("out"), (into & F.coalesce(urgent, F.lit(False))).alias("urgent"),
        F.pmod(F.xxhash64("conversation_id"), F.lit(GROUPS)).alias("group"),
    )
    return rows.groupBy("group").applyInPandasWithState(_update(idle_ms), STATES, "kept binary", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_files(df: DataFrame, out: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """All available input through ``df`` into Parquet, read back with batch_id; executors write, the driver gets no rows.

    A batch has a partition of its own, which a retry overwrites, so rows are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
