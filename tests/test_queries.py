"""Every registered query with SQL gives what DuckDB gives; the others run and have rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.compare import connection, same  # noqa: E402
from tests.conftest import SF  # noqa: E402
from vocspark import plans  # noqa: E402

QUERIES, ORACLES = plans.queries(), plans.oracles()
#: Several write or stream; the rest is cheap.
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_states_stay_off_the_driver(spark, monkeypatch):
    """The update stream is written by the executors; no memory sink holds it on the driver."""
    from vocspark.streaming import jobs

    def no_sink(*_, **__):
        raise AssertionError("memory sink")

    monkeypatch.setattr(jobs, "run_to_memory", no_sink, raising=False)
    out = QUERIES["j5_stream_states"](spark, SF)
    assert out.inputFiles() and all(f"batch_id={n}" in "".join(out.inputFiles()) for n in (0,)) and out.count() > 0


def test_near_groups_follow_chains(spark):
    """Successive edits are one group though its ends are not near, and links are counted."""
    from vocspark.operators.neargroups import near_groups

    words = [f"w{i}" for i in range(60)]
    docs = []
    for step in range(5):
        docs.append((5 - step, " ".join(words)))
        words[12 * step + 5] = f"new{step}"
    docs += [(6, docs[0][1]), (9, "something else entirely here")]
    out = {r["id"]: (r["group_id"], r["n_links"]) for r in near_groups(spark.createDataFrame(docs, "doc_id long, text string"), distance=0.12).collect()}
    assert {i: g for i, (g, _) in out.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 9}
    assert {i: n for i, (_, n) in out.items()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 9: 0}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
