"""Keyword searches against brute force and literal cases, and the shape of their plans."""

import random
from datetime import datetime

from vocspark.operators import keywords as K

MSG = "tweet_id long, text string, topic_keywords string, inbound boolean, sentiment string, author_id string, created_at timestamp, company string"
Q = "query_id long, query string"


def message(i, text, topic="General Support", inbound=True, sentiment="neutral", author="cust", day=1, company=None):
    return (i, text, topic, inbound, sentiment, author, datetime(2024, 1, day), company)


def test_word_search_equals_brute_force(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice("abcé") for _ in range(draw.randrange(3, 7))) for _ in range(60)]
    rows = [message(i, " ".join(draw.choice(stems) for _ in range(draw.randrange(1, 14))), draw.choice(stems), draw.random() < 0.8, draw.choice(("negative", "Negative", "neutral", None))) for i in range(300)]
    asked = [(n, " ".join(draw.choice(stems) + draw.choice(("", "?", "!")) for _ in range(draw.randrange(0, 7)))) for n in range(40)]
    m = spark.createDataFrame([*rows, rows[5], rows[5]], MSG)
    out = {}
    for r in K.keyword_search(m, spark.createDataFrame(asked, Q), limit=7).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["tweet_id"]))
    expected = {}
    for n, query in asked:
        words = [w for w in query.replace("?", "").replace("!", "").split() if len(w) > 2][:4]
        hits = [r for r in rows if r[3] and len(r[1]) >= 25 and any(w in r[1] or w in r[2] for w in words)]
        hits.sort(key=lambda r: ((r[4] or "").lower() != "negative", -r[0]))
        if hits:
            expected[n] = [(k, r[0]) for k, r in enumerate(hits[:7], 1)]
    assert {n: sorted(v) for n, v in out.items()} == expected and len(expected) > 25


def test_stored_index_by_runs(spark, tmp_path):
    """A run that is written again replaces itself, and other runs' files stay as they are."""
    path = str(tmp_path / "postings")
    a = spark.createDataFrame([message(1, "the battery of my phone is flat again today")], MSG)
    b = spark.createDataFrame([message(2, "my battery was swapped, and it is hot again")], MSG)
    q = spark.createDataFrame([(1, "battery"), (2, "swapped"), (3, "flat"), (4, "modem")], Q)
    K.write_postings(a, path, "a")
    K.write_postings(a.withColumn("tweet_id", a.tweet_id + 8), path, "b")
    kept = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "postings" / "dataset_run_id=a").rglob("*.parquet")}
    K.write_postings(b, path, "b")
    assert kept == {str(f): f.stat().st_mtime_ns for f in (tmp_path / "postings" / "dataset_run_id=a").rglob("*.parquet")}
    index = K.read_postings(spark, path)
    found = {(r["query_id"], r["tweet_id"]) for r in K.keyword_search(a.unionByName(b), q, index=index).collect()}
    assert found == {(1, 1), (1, 2), (2, 2), (3, 1)}
    plan = K.containing(K.searchable(a), q.withColumnRenamed("query", "word"), index)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Join Cross" not in plan


def test_postings_leave_the_text_behind(spark):
    m = K.searchable(spark.createDataFrame([message(1, "abcd abcd"), message(2, "ab", None), message(3, None, None)], MSG), ("text",))
    out = K.postings(m)
    assert sorted((r["gram"], r["tweet_id"]) for r in out.collect()) == [(" ab", 1), ("abc", 1), ("bcd", 1), ("cd ", 1), ("d a", 1)]
    assert out.columns == ["gram", "tweet_id"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert "[tweet_id" in plan and "text#" not in generate.rsplit("[", 1)[1]


def test_cluster_search(spark):
    rows = [
        message(1, "it took three weeks and came in pieces", "Delivery or order issue"), message(2, "where is it, I have been waiting", "Delivery or order issue", sentiment="NEGATIVE"),
        message(3, "where is it, I have been waiting", "Delivery or order issue", inbound=False), message(4, "too short", "Delivery or order issue"), message(5, "a refund is what I was promised here", "Other"),
        message(6, None, "Refund delay or failure"), message(7, "it took three weeks and came in pieces", "Delivery or order issue"),
    ]
    asked = [(1, "My DELIVERY is late"), (2, "refund please"), (3, "quantum physics"), (4, None), (5, ""), (6, "order issue or subscription")]
    out = [tuple(r) for r in K.cluster_search(spark.createDataFrame(rows, MSG), spark.createDataFrame(asked, Q), limit=2).select("query_id", "rank", "tweet_id", "by_cluster").collect()]
    assert sorted(out) == [(1, 1, 2, True), (1, 2, 7, True), (2, 1, 5, False), (6, 1, 2, True), (6, 2, 7, True)]
    empty = spark.createDataFrame([], MSG)
    assert K.cluster_search(empty, spark.createDataFrame(asked, Q)).count() == 0
    assert K.cluster_search(spark.createDataFrame(rows, MSG), spark.createDataFrame([], Q)).count() == 0


def test_filtered_search(spark):
    rows = [
        message(1, "my router drops the line", company="Acme", day=1), message(2, "my ROUTER drops the line", company="ACME", day=3), message(3, "the router is dead, again", company="Other", sentiment="negative"),
        message(4, "a router from the help desk", inbound=False, author="AcmeHelp"), message(5, "a router of a third party", inbound=False, author="bob", company="acme", day=2), message(6, "router", company="Acme"),
        message(7, "router with no side known", inbound=None, author=None, company="acme", day=1), message(8, "poor support, what a pity", company="acme"),
    ]
    asked = [(1, "what is this router doing?", "aCme"), (2, "router", None), (3, "what about this", None), (4, "poor support", None), (5, "abc", None), (6, None, None), (7, "router", "nobody")]
    out = K.filtered_search(spark.createDataFrame(rows, MSG), spark.createDataFrame(asked, Q + ", company string"), limit=4).collect()
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["tweet_id"])
    assert found == {1: [2, 5, 7, 1], 2: [3, 2, 5, 7], 4: [8]}
