"""Stream states against batch states whatever the order of arrival, and a run's KPI from its batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vocspark.operators import conversation, kpi
from vocspark.sources import adapters
from vocspark.streaming import jobs

MSG = "conversation_id string, tweet_id long, created_at timestamp, inbound boolean, priority string, sentiment string, text string"
T0 = datetime(2024, 3, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_states_do_not_depend_on_arrival(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(160):
        at = T0 + timedelta(minutes=draw.randrange(0, 20), microseconds=draw.choice((0, 1)))
        rows.append((f"c{draw.randrange(12)}", i, at, draw.random() < 0.5, draw.choice(("urgent", "normal", None)), draw.choice(("negative", "neutral", None)), "a text"))
    draw.shuffle(rows)
    path = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(rows[part::4], MSG).coalesce(1).write.mode("append").parquet(path)
        out = jobs.run_to_files(jobs.conversation_states(jobs.read_stream(spark, path, spark.createDataFrame([], MSG).schema, 100)), str(tmp_path / "out"), str(tmp_path / "point"))
    last = out.groupBy("conversation_id").agg(F.max_by(F.struct("messages_count", "reopened", "resolved", "escalated"), "messages_count").alias("s")).select("conversation_id", "s.*")
    expected = conversation.states(spark.createDataFrame(rows, MSG)).select("conversation_id", "messages_count", "reopened", "resolved", "escalated")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.collect())) and expected.where("reopened").count() > 2


def test_states_of_null_rows(spark, tmp_path):
    rows = [("a", 1, T0, True, None, None, None), ("a", None, T0, None, "urgent", "negative", None), ("b", 2, None, False, None, None, ""), ("b", 3, T0, True, "HIGH", None, ""), ("c", 4, T0, False, None, None, None), ("c", 4, T0, False, None, None, None)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, MSG).write.parquet(path)
    out = jobs.run_to_files(jobs.conversation_states(jobs.read_stream(spark, path, spark.createDataFrame([], MSG).schema, 100)), str(tmp_path / "out"), str(tmp_path / "point"))
    found = {r["conversation_id"]: (r["messages_count"], r["reopened"], r["resolved"], r["escalated"]) for r in out.where("not ended").collect()}
    assert found == {"a": (2, False, False, False), "b": (2, True, False, True), "c": (2, False, True, False)}


def _batches(spark, path, n=3):
    m = adapters.from_events(spark, SF)
    for part in range(n):
        m.where(F.col("tweet_id") % n == part).coalesce(1).write.mode("append").parquet(path)
    return m, jobs.read_stream(spark, path, m.schema, 1)


def test_final_kpi_merges_batches_and_replays(spark, tmp_path):
    """Three batches give the KPI of all rows; the last one, run again after a lost commit, changes nothing."""
    folder = tmp_path / "run"
    m, stream = _batches(spark, str(tmp_path / "in"))
    drop = ("dataset_run_id", "conversations")
    first = jobs.ingest_run(stream, str(folder), "r").collect()[0].asDict()
    whole = kpi.overall(jobs.enrich(m)).first().asDict()
    assert {k: v for k, v in first.items() if k not in drop} == pytest.approx(whole)
    assert first["conversations"] == pytest.approx(m.select("conversation_id").distinct().count(), rel=0.02)
    progress = jobs.cumulative(spark.read.parquet(str(folder / "progress"))).orderBy("batch_id").collect()
    assert [r["total_rows"] for r in progress][-1] == m.count() and len(progress) == 3
    assert all(r["rows_per_second"] == pytest.approx(r["rows"] / r["seconds"]) for r in progress)
    (folder / "checkpoint" / "commits" / "2").unlink()
    (folder / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
    again = jobs.ingest_run(stream, str(folder), "r").collect()[0].asDict()
    assert again == first and spark.read.parquet(str(folder / "rows")).count() == m.count() and spark.read.parquet(str(folder / "partials")).count() == 3
    assert [r["status"] for r in spark.read.parquet(str(folder / "status")).orderBy("at").collect()] == ["running", "completed"] * 2


def test_failed_run_says_so_and_goes_on(spark, tmp_path, monkeypatch):
    folder = tmp_path / "run"
    m, stream = _batches(spark, str(tmp_path / "in"), 2)
    real = kpi.overall_sums
    monkeypatch.setattr(jobs.kpi, "overall_sums", lambda df: (_ for _ in ()).throw(ValueError("stop")))
    with pytest.raises(Exception, match="stop"):
        jobs.ingest_run(stream, str(folder), "r")
    monkeypatch.setattr(jobs.kpi, "overall_sums", real)
    assert jobs.ingest_run(stream, str(folder), "r").first()["total_records"] == m.count()
    assert [r["status"] for r in spark.read.parquet(str(folder / "status")).orderBy("at").collect()] == ["running", "failed", "running", "completed"]


def test_sums_of_missing_columns_and_no_rows(spark):
    one = kpi.overall_of(kpi.overall_sums(spark.createDataFrame([], "text string"))).first()
    assert one["total_records"] == 0 and one["avg_response_time_minutes"] == 0 and one["conversations"] == 0 and one["resolution_rate"] == 0


def test_states_of_many_conversations_take_few_calls(spark, tmp_path, monkeypatch):
    """The rows of every batch, those of ended conversations and of such as come back among them, equal a plain model; a call has many conversations."""
    monkeypatch.setattr(jobs, "GROUPS", 3, raising=False)
    calls, real = spark.sparkContext.accumulator(0), jobs._update

    def counted(idle_ms):
        update = real(idle_ms)

        def call(*args):
            calls.add(1)
            yield from update(*args)

        return call

    monkeypatch.setattr(jobs, "_update", counted)
    draw, path, idle, late = random.Random(3), str(tmp_path / "in"), 3_600_000, 600_000
    parts = [[(draw.choice((None, *(f"c{n}" for n in range(150)))), i, T0 + timedelta(minutes=90 * part + draw.randrange(60)), draw.choice((True, False, None)), draw.choice(("urgent", None)), None, "") for i in range(part * 200, part * 200 + 200)] for part in range(4)]
    parts.append([("c0", 900, T0 + timedelta(days=9), False, None, None, "")])
    for part in parts:
        spark.createDataFrame(part, MSG).coalesce(1).write.mode("append").parquet(path)
        out = jobs.run_to_files(jobs.conversation_states(jobs.read_stream(spark, path, spark.createDataFrame([], MSG).schema, 100), "10 minutes", idle), str(tmp_path / "out"), str(tmp_path / "point"))
    held, until, expected, watermark = {}, {}, [], 0
    for part in parts:
        for rows in (part, []):  # and the batch without rows after it, in which conversations end
            changed = set()
            for r in rows:
                if int(r[2].timestamp() * 1000) >= watermark:
                    held.setdefault(r[0], []).append(r)
                    changed.add(r[0])
            for c in list(held):
                at = sorted(held[c], key=lambda r: (r[2], r[1]))
                if c in changed:
                    until[c] = max(int(at[-1][2].timestamp() * 1000) + idle, watermark + 1)
                ended = c not in changed and until[c] < watermark
                if c in changed or ended:
                    agent, customer = [i for i, r in enumerate(at) if r[3] is False], [i for i, r in enumerate(at) if r[3]]
                    expected.append((c, len(at), bool(agent and customer and agent[0] < customer[-1]), at[-1][3] is False, any(r[3] and r[4] for r in at), ended))
                if ended:
                    del held[c]
            watermark = max([watermark, *(int(r[2].timestamp() * 1000) - late for r in rows)])
    found = [tuple(r)[:6] for r in out.collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(found) == order(expected) and sum(r[5] for r in expected) > 150
    assert 0 < calls.value <= 3 * 2 * len(parts)
