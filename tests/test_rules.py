"""Literal cases of the rules, and edge rows."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vocspark.functions import labels, search_text
from vocspark.functions import text as X
from vocspark.operators import conversation, filters, kpi, retrieval, threads, trends

MSG = "tweet_id long, conversation_id string, inbound boolean, created_at timestamp, response_tweet_id string, in_response_to_tweet_id long, priority string, sentiment string, text string"
T0 = datetime(2024, 1, 1, 10)


def of(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("out", column)
    return [r["out"] for r in rows.orderBy("i").collect()]


def test_clean_text(spark):
    out = of(spark, ["@Support My internet is down! Check http://status.telecomcorp.com", None, "", "Olá  você ☹ ^RR"], X.clean_text("text"))
    assert "internet is down" in out[0] and "http" not in out[0] and "@" not in out[0]
    assert out[1:] == ["", "", "olá você"]


def test_language(spark):
    assert of(spark, ["Obrigado pela ajuda", "Hola, gracias", "merci", "danke", "アプリ", "你好", "안녕", "مرحبا", "नमस्ते", "привет", "hello", None], X.detect_language("text")) == ["pt", "es", "fr", "de", "ja", "zh", "ko", "ar", "hi", "ru", "en", "en"]


def test_sentiment(spark):
    out = of(spark, ["It keeps crashing", "Thanks for the helpful support, the problem is fixed!", "", None], X.sentiment_vote("text"))
    assert [r["sentiment"] for r in out] == ["negative", "positive", "neutral", "neutral"]
    assert [r["score"] for r in of(spark, ["error", "love", "love error"], X.sentiment_fast("text"))] == [-1, 1, 0]


def test_topics_and_clusters(spark):
    out = of(spark, ["App crash on start", "it crashes", "refund my charge", "wrong charge"], X.topic_rule("text"))
    assert len({r["topic_id"] for r in out}) == 2
    assert of(spark, ["foo, bar, baz", "please, foo", ", ,"], X.cluster_name("text")) == ["Foo & Bar Inquiries", "Foo Inquiries", "General Support & Conversational Inquiries"]


def test_context_and_intent(spark):
    line = ["The app keeps crashing after the latest update."]
    c, i, e = of(spark, line, X.context("text"))[0], of(spark, line, X.intent("text"))[0], of(spark, line, X.entities("text"))[0]
    assert (c["sentiment"], c["topic"], c["pain_point"]) == ("negative", "app_crash", "application instability")
    assert i["intent"] == "technical_issue" and e["product"] == "mobile app"


def test_flags_and_dates(spark):
    assert of(spark, ["Yes", " 1", "no", None], labels.flag("text")) == [True, True, False, False]
    out = of(spark, ["2024-01-02T03:04:05Z", "Tue Oct 31 22:10:47 +0000 2017", "never", None], F.date_format(labels.timestamp("text"), "yyyy-MM-dd HH:mm:ss"))
    assert out == ["2024-01-02 03:04:05", "2017-10-31 22:10:47", None, None]
    with pytest.raises(ValueError, match="missing columns: b"):
        labels.require(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"])


def test_four_messages(spark):
    at = [T0, T0 + timedelta(minutes=5), T0 + timedelta(minutes=15), T0 + timedelta(minutes=20)]
    rows = [(1, "c", True, at[0], "2", None, "high", "negative", "x"), (2, "c", False, at[1], "3", 1, "normal", "neutral", "x"), (3, "c", True, at[2], "4.0", 2, "normal", "neutral", "x"), (4, "c", False, at[3], None, 3, "normal", "neutral", "x")]
    m = spark.createDataFrame(rows, MSG)
    assert {r["tweet_id"]: r["response_time_minutes"] for r in threads.response_times(m).collect()} == {1: 5.0, 2: None, 3: 5.0, 4: None}
    s = conversation.states(m).first()
    assert (s["resolved"], s["escalated"], s["reopened"], s["messages_count"]) == (True, True, True, 4)


def test_thread_roots(spark):
    rows = [(5, None, True, T0, None, 4, "n", "n", "x"), (4, None, True, T0, None, 3, "n", "n", "x"), (3, None, True, T0, None, None, "n", "n", "x"), (9, None, True, T0, None, 77, "n", "n", "x"), (9, None, True, T0, None, 77, "n", "n", "x"), (20, None, True, T0, None, 21, "n", "n", "x"), (21, None, True, T0, None, 20, "n", "n", "x")]
    out = threads.conversation_roots(spark.createDataFrame(rows, MSG))
    assert {(r["tweet_id"], r["conversation_id"]) for r in out.collect() if r["tweet_id"] < 20} == {(5, "3"), (4, "3"), (3, "3"), (9, "77")}
    assert out.count() == 7


def test_many_gaps_and_conversations(spark):
    m = spark.range(55_000).select((F.col("id") + 1).alias("tweet_id"), (F.col("id") % 2 == 0).alias("inbound"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 120).alias("created_at"), (F.col("id") + 2).cast("string").alias("response_tweet_id"))
    gaps = threads.response_times(m).where("inbound").agg(F.min("response_time_minutes"), F.max("response_time_minutes"), F.count("response_time_minutes")).first()
    assert tuple(gaps) == (2.0, 2.0, 27_500)
    c = spark.range(6000).select(F.col("id").alias("tweet_id"), F.floor(F.col("id") / 3).cast("string").alias("conversation_id"), (F.col("id") % 3 == 0).alias("inbound"), F.timestamp_seconds("id").alias("created_at"), F.lit("normal").alias("priority"), F.lit("neutral").alias("sentiment"))
    r = conversation.rates(conversation.states(c)).first()
    assert (r["total_conversations"], r["resolution_rate"], r["escalation_rate"], r["reopen_rate"]) == (2000, 100.0, 0.0, 0.0)


def test_empty_messages(spark):
    m = spark.createDataFrame([], MSG + ", fcr boolean, response_time_minutes double")
    assert conversation.rates(conversation.states(m)).first()["status"] == "no_data_available"
    k = kpi.overall(m).first()
    assert k["total_records"] == 0 and k["resolution_rate"] == 0.0
    assert [r["messages"] for r in kpi.sla_tiers(m).collect()] == [0, 0, 0, 0]


def test_spikes(spark):
    day = lambda i: (T0 + timedelta(days=i)).date()
    rows = [("crash", day(i), v) for i, v in enumerate((2, 2, 25))] + [("billing", day(i), 5) for i in range(3)]
    out = trends.spikes(spark.createDataFrame(rows, "category string, date date, volume long"), window=2)
    hit = {(r["category"], r["date"]): r["spike_detected"] for r in out.collect()}
    assert hit[("crash", day(2))] and not hit[("billing", day(2))]


def test_resolution_of_a_day(spark):
    m = spark.createDataFrame([(T0, True, "open", False, "negative", 1.0), (T0, False, "open", False, "positive", 2.0)], "created_at timestamp, fcr boolean, resolution_status string, escalated boolean, sentiment string, response_time_minutes double")
    assert trends.multi_period(m).first()["resolution"] == 50.0


def test_keep_or_all(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("b", None)], "q string, inbound boolean")
    assert sorted(r["q"] for r in filters.keep_or_all(df, F.col("inbound"), "q").collect()) == ["a", "b", "b"]


def test_spelling(spark):
    words = "my phone keeps freezing after update battery".split()
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, ordinal int")
    texts = spark.createDataFrame([(1, "my phne keeps frezing after updte"), (2, "avrg handset sloooow x1y batttery")], "id int, text string")
    out = {r["id"]: r["corrected"] for r in search_text.corrected_texts(texts, vocabulary, "id", "text").collect()}
    assert out == {1: "my phone keeps freezing after update", 2: "average phone sloooow x1y battery"}


def test_spelling_by_keys_equals_every_pair(spark):
    """Keys with letters taken out find what comparing with each word finds, whatever the lengths."""
    import random

    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))
    vocabulary = sorted({word(draw.choice((3, 4, 5, 8, 13, 14, 15, 30))) for _ in range(150)})
    asked = {word(n) for n in (3, 4, 5, 6) for _ in range(40)}
    for w in vocabulary:
        for _ in range(3):
            letters = list(w)
            for _ in range(draw.randrange(1, 4)):
                at = draw.randrange(len(letters) + 1)
                letters[at : at + draw.randrange(2)] = draw.choice(("", "a", "d"))
            asked.add("".join(letters))
    asked = sorted(a for a in asked if len(a) >= 3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def best(a):
        forms = [a, re.sub(r"(.)\1{2,}", r"\1\1", a), re.sub(r"(.)\1+", r"\1", a)]
        known = [f for f in forms if f in vocabulary]
        if known:
            return known[0]
        scored = [(10 * d - 2 * (w[-1] == a[-1]) + abs(len(w) - len(a)), i, w) for i, w in enumerate(vocabulary) if w[0] == a[0] and (d := distance(a, w)) <= (1 if len(a) <= 4 else 2)]
        return min(scored)[2] if scored else a

    given = spark.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "word string, ordinal int")
    out = search_text.correct_tokens(spark.createDataFrame([(a,) for a in asked], "token string"), given).collect()
    assert {r["token"]: r["corrected"] for r in out} == {a: best(a) for a in asked}
    assert sum(best(a) != a for a in asked) > 100


def test_spelling_of_whole_texts(spark):
    words = spark.createDataFrame([("battery", 0, True), ("banana", 1, False), ("update", 2, True)], "word string, ordinal int, target boolean")
    texts = spark.createDataFrame([(1, 'My "batery", avg SLA!'), (2, None), (3, "  "), (4, "bananas - updat ...")], "id int, text string")
    out = {r["id"]: r["corrected"] for r in search_text.corrected_texts(texts, words, "id", "text").collect()}
    assert out == {1: 'my "battery", average SLA!', 2: "", 3: "", 4: "bananas - update ..."}
    assert search_text.correct_tokens(texts.selectExpr("text as token").limit(0), words).count() == 0
    plan = search_text.correct_tokens(texts.selectExpr("text as token"), words)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_query_gate(spark):
    texts = ["xyz123 qwerty asdfghjkl", "phone", "", "?", "...", "hi", "help", "bcdfghjk is odd here", "who is the president of France", "Why are deliveries delayed this week?", None]
    assert of(spark, texts, search_text.quality_status("text")) == ["gibberish", "too_generic", "empty", "gibberish", "gibberish", "greeting", "greeting", "gibberish", "out_of_domain", "valid", "empty"]


def test_intents_and_negation(spark):
    assert len(of(spark, ["Why are deliveries delayed AND what is our average response time?"], search_text.sub_queries("text"))[0]) == 2
    texts = ["customers who are not having login issues but have delivery delays", "ignore freezing, show me battery drain issues", "battery draining without phone freezing", "plain question here"]
    out = of(spark, texts, search_text.focus_and_excluded("text"))
    assert "delivery" in out[0]["focus"] and "login" in out[0]["excluded"]
    assert out[1]["focus"] == "battery drain issues" and "frozen" in out[1]["excluded"]
    assert out[2]["focus"] == "battery draining" and "freezing" in out[2]["excluded"]
    assert out[3]["focus"] == texts[3] and out[3]["excluded"] == []


def test_demojize(spark):
    assert of(spark, ["Low 🔋 #help 🦊 @me http://x.y", None], search_text.demojize("text")) == ["Low battery help fox face", ""]


def test_diversify_and_rerank(spark):
    texts = ["I cannot access my account", "I can't access my account", "can not access my account!", "I cannot access my account today", "Delivery is late again", "Battery drains fast"]
    c = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "query_id long, id long, rank int, text string")
    out = retrieval.diversify(c, 0.6, 3).collect()
    assert sum(r["kept"] for r in out) <= 3 and sum(not r["kept"] for r in out) >= 3
    docs = [(1, "app crash", 101, "issue", True, "u1", 0.5, []), (1, "app crash", 102, "My app keeps crashing with an error after the update and the screen is frozen, cannot use it at all", True, "u2", 0.5, []), (1, "app crash", 103, "Please DM us your details", False, "support", 0.5, [])]
    ranked = retrieval.rerank(spark.createDataFrame(docs, "query_id long, query string, id long, text string, inbound boolean, author_id string, score double, excluded array<string>"))
    assert ranked.where("rank = 1").first()["id"] == 102


def test_chunks(spark):
    rows = [(i, "c", i % 2 == 0, T0 + timedelta(minutes=i), None, None, "n", "n", f"text {i}") for i in range(4)]
    out = retrieval.chunks(spark.createDataFrame(rows, MSG)).collect()
    assert sorted(r["text"].count("[") for r in out if r["chunk_type"] == "diagnostic_dialogue") == [1, 2, 3, 3]
    assert sum(r["chunk_type"] == "problem_declaration" for r in out) == 1


def test_vector_topk_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(99, None)], "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in retrieval.vector_topk(v, v.where("vec_id < 9"), 3).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert {tuple(r) for r in retrieval.vector_topk(v, v.where("vec_id < 9"), 3).collect()} == whole and len(whole) == 27


def test_circle_of_replies_has_its_least_id(spark):
    from vocspark.operators import threads

    rows = [(1, None), (2, 1), (3, 2), (10, 12), (11, 10), (12, 11), (13, 12), (5, 13), (20, 99)]
    messages = spark.createDataFrame([(i, up, None, "x", "y") for i, up in rows], "tweet_id long, in_response_to_tweet_id long, created_at timestamp, root string, id string")
    out = {r["tweet_id"]: r["conversation_id"] for r in threads.conversation_roots(messages).collect()}
    assert out == {1: "1", 2: "1", 3: "1", 10: "10", 11: "10", 12: "10", 13: "10", 5: "10", 20: "99"}


def test_upsert_keeps_columns_of_any_name(spark):
    from vocspark.sources import io

    old = spark.createDataFrame([("r", 1, "a", "p"), ("s", 1, "b", "p")], "run_id string, created_at int, _new string, newest string")
    new = spark.createDataFrame([("r", 1, "c", "q")], "run_id string, created_at int, _new string, newest string")
    assert sorted(map(tuple, io.upsert(old, new, ["run_id"]).collect())) == [("r", 1, "c", "q"), ("s", 1, "b", "p")]


def test_late_rows_and_ending_states(spark, tmp_path):
    """A row past the watermark is left out in append mode, and an idle conversation ends once."""
    from datetime import datetime

    from vocspark.streaming import jobs

    schema = "conversation_id string, tweet_id long, created_at timestamp, inbound boolean, priority string, sentiment string"
    path = str(tmp_path / "in")
    parts = [[("a", 1, datetime(2024, 1, 1, 10), True, "normal", "negative")], [("b", 2, datetime(2024, 1, 5, 10), False, "normal", "positive")], [("c", 3, datetime(2024, 1, 1, 11), True, "normal", "positive")], [("z", 4, datetime(2024, 2, 1), True, "normal", "neutral")]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        stream = lambda: jobs.read_stream(spark, path, spark.createDataFrame([], schema).schema, 100)
        days = jobs.run_to_files(jobs.trend(stream()), str(tmp_path / "days"), str(tmp_path / "p1"), "append")
        states = jobs.run_to_files(jobs.conversation_states(stream()), str(tmp_path / "states"), str(tmp_path / "p2"))
    assert {(r["period"], r["total"], r["negative"]) for r in days.collect()} == {("2024-01-01 00:00", 1, 1), ("2024-01-05 00:00", 1, 0)}
    ended = [r["conversation_id"] for r in states.where("ended").collect()]
    assert sorted(set(ended)) == sorted(ended) and {"a", "b"} <= set(ended) and "z" not in ended


def test_rows_that_do_not_fit_go_to_the_side(spark):
    from pyspark.sql import types as T

    from vocspark.sources import io

    raw = spark.createDataFrame([("1", "2.5"), ("x", "2"), ("3", "y"), (None, None)], "Id string, names string")
    good, bad = io.match_rows(raw, T.StructType([T.StructField("ID", T.LongType()), T.StructField("NAMES", T.DoubleType())]))
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2.5), (None, None)]
    assert sorted((r["Id"], r["bad_columns"]) for r in bad.collect()) == [("3", ["NAMES"]), ("x", ["ID"])]


@pytest.mark.parametrize(
    "query, focus",
    (
        ("My phone is not freezing, but the battery is draining very fast", "my phone battery is draining very fast"),
        ("it is not slow, other than that the app crashes", "it app crashes"),
        ("The app is not slow but the app crashes", "the app crashes"),
        ("customers who are not having login issues but have delivery delays", "have delivery delays"),
        ("not slow but late", "late"),
        ("ignore crashes, why are deliveries late", "deliveries late"),
        ("ignore freezing, show me battery drain issues", "battery drain issues"),
        ("a plain question", "a plain question"),
    ),
)
def test_focus_of_negated_queries(query, focus):
    from vocspark.functions.search_text import _split_focus

    assert _split_focus(query)[0] == focus


def test_diversity_figures(spark):
    rows = [(1, 10, 1, "My phone is dead."), (1, 11, 2, "my phone is DEAD"), (1, 12, 3, "the parcel never came to me"), (1, 13, 4, " "), (1, 14, 5, "the parcel never came to us"), (2, 20, 1, None), (3, 30, 1, "a b c"), (3, 31, 2, "d e f"), (3, 32, 3, "g h i")]
    c = spark.createDataFrame(rows, "query_id long, id long, rank int, text string")
    judged = retrieval.diversify(c, 0.65, 2)
    found = {(r["id"]): (r["kept"], r["duplicate_of"], r["duplicate_similarity"] and round(r["duplicate_similarity"], 2)) for r in judged.collect()}
    assert found == {10: (True, None, None), 11: (False, 10, 1.0), 12: (True, None, None), 30: (True, None, None), 31: (True, None, None)}
    assert sorted(map(tuple, retrieval.diversity(c, judged).collect())) == [(1, 5, 2, 1, 0.4), (2, 1, 0, 0, 0.0), (3, 3, 2, 0, 0.667)]
    assert retrieval.diversity(c.limit(0), judged.limit(0)).count() == 0


def test_sketched_medians_merge(spark):
    from vocspark.operators import convdoc

    view = spark.range(40_000).selectExpr("id % 7 as day", "id % 3 as kind", "id % 5 <> 0 as resolved", "case when id % 11 <> 0 then pow(id % 9973, 2) end as duration_minutes")
    kept = convdoc.resolution_sketches(view, "day", "kind")
    assert kept.count() == 21 and kept.select(F.max(F.length("sketch"))).first()[0] < 20_000
    for by in (["kind"], []):
        times = {tuple(r[c] for c in by): r for r in convdoc.sketched_times(kept, *by).collect()}
        for r in view.where("resolved").groupBy(*by).agg(F.count("*").alias("n"), F.avg("duration_minutes").alias("mean"), F.percentile("duration_minutes", [0.5 - convdoc.RANK_ERROR, 0.5 + convdoc.RANK_ERROR]).alias("p")).collect():
            t = times[tuple(r[c] for c in by)]
            assert t["resolved"] == r["n"] and t["average_minutes"] == pytest.approx(r["mean"]) and r["p"][0] <= t["median_minutes"] <= r["p"][1]
    nothing = convdoc.sketched_times(convdoc.resolution_sketches(view.where("duration_minutes is null"), "kind"), "kind")
    assert all(r["median_minutes"] is None and r["average_minutes"] is None for r in nothing.collect()) and nothing.count() == 3


def test_drop_run_touches_no_other(spark, tmp_path):
    from vocspark.sources import io

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a/b =c"), (2, "d"), (3, None), (4, "d")], "n int, dataset_run_id string")
    io.append_messages(rows, path)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet") if "=d" in str(f)}
    assert io.drop_run(spark, path, "a/b =c") and not io.drop_run(spark, path, "a/b =c") and not io.drop_run(spark, path, "no such run")
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert io.drop_run(spark, path, None)
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 4]
    assert before == {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")} and not list((tmp_path / "t").glob("_dropped*"))


def test_emerging_issues_keep_growth_from_the_limit_on(spark):
    """Four categories grow by 20 %, under 20 %, over it, and from nothing; the last observed day counts."""
    counts = {"at": (5, 6), "under": (6, 7), "over": (2, 5), "first": (0, 3), "less": (5, 2)}
    rows = [(c, T0.date() + timedelta(days=4 * day), f"{c}-{day}-{i}") for c, per_day in counts.items() for day, n in enumerate(per_day) for i in range(n)]
    rows += rows[:3]
    found = trends.emerging_issues(spark.createDataFrame(rows, "issue_category string, date date, conversation_id string")).collect()
    assert {r["category"]: (r["previous"], r["conversations"], round(r["growth"], 6)) for r in found} == {"at": (5, 6, 20.0), "over": (2, 5, 150.0)}


def test_metrics_share_their_passes(spark, monkeypatch):
    """Seven metrics of totals and four of topics read the messages twice; each equals what it gives alone."""
    from tests.conftest import SF
    from vocspark.operators import dispatch
    from vocspark.sources import adapters

    passes = []
    for base, make in dict(dispatch.BASES).items():
        monkeypatch.setitem(dispatch.BASES, base, lambda m, base=base, make=make: passes.append(base) or make(m))
    m = adapters.from_events(spark, SF)
    names = ["kpi_summary", "response_time", "resolution_rate", "escalation_rate", "reopen_rate", "fcr", "direct_rates", "topics_batch", "priorities", "cluster_sentiment_stats", "customer_pain_points"]
    found = dispatch.run_metrics(m, names, sentiment="negative")
    assert sorted(passes) == ["topics", "totals"]
    for n, df in found.items():
        alone = dispatch.METRICS[n](m.where("sentiment = 'negative'"))
        assert df.columns == alone.columns, n
        assert sorted(map(str, df.collect())) == sorted(map(str, alone.collect())), n
        assert n.startswith("topics") or "events.parquet" not in "".join(df.inputFiles())
    with pytest.raises(KeyError, match="nope"):
        dispatch.run_metrics(m, ["fcr", "nope"])


def test_cluster_names_of_letters_whose_case_is_no_letter_equal_sql(spark, tmp_path):
    """ß, ligatures, İ and the last Σ of a word change case letter by letter, and all spaces are trimmed, as in SQL."""
    import random

    import duckdb

    from vocspark import plans

    draw = random.Random(7)
    texts = ["a, ßbc,x", "ŉ, ﬁN", "ᾳ　,  ΑΣ ΣΑΣ,ΟΔΟΣ", "İM, İos", "sİgn", "KelvinK", None, ", ,", "ǆ,ǅ,Ǆ", "\U00010400b,\U00010d50c"]
    texts += ["".join(draw.choice(",, ßŉﬁᾳΣσİıǅẞᲉꟜƛ　 ̇ÀàЖж\U00010428bBgGiI.'\n\t") for _ in range(12)) for _ in range(300)]
    rows = [(i, 1, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("c7_cluster_name", "c6_topic_rule", "c1_clean_text"):
        expected = con.sql(plans.oracles()[name]).df()
        found = plans.queries()[name](spark, str(tmp_path)).select(*expected.columns).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected.itertuples(index=False))), name
    every = spark.range(1, 0x110000).where("id not between 55296 and 57343 and id <> 65279").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = every.select("id", X.lower(F.col("c")).alias("low"), X.upper(F.col("c")).alias("up")).toArrow()
    con.register("found", found)
    assert con.sql("select count(*), count_if(low <> lower(chr(cast(id as int)))), count_if(up <> upper(chr(cast(id as int)))) from found").fetchall() == [(1112062, 0, 0)]
