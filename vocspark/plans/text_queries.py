"""Queries of the text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocspark.functions import text as T
from vocspark.functions import wordlists as W
from vocspark.plans.registry import case, matches, over_conversations, over_documents, over_events, text

L = r"\p{L}\p{N}_"
CLEAN = rf"https?://\S+|www\.\S+|@[{L}]+|\s*\^[a-zA-Z0-9]{{1,4}}\b|[^{L}\s.,!?#\-']"


def _any(column: str, words) -> str:
    return matches(column, "|".join(words))


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), {text(CLEAN)}, ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def _simple_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, 'http\S+|www\S+', '', 'g'), '@[{L}]+', '', 'g'), '\s+', ' ', 'g'), ' ')"


def _language_sql(c: str) -> str:
    return case(
        [(matches(c, rf"(?i)(^|[^{L}])({'|'.join(words)})($|[^{L}])"), text(code)) for code, words in W.LANGUAGE_WORDS]
        + [(matches(c, f"[{a}-{b}]"), text(code)) for code, a, b in W.LANGUAGE_SCRIPTS],
        "'en'",
    )


def _hits(c: str, words, weight: int = 1) -> str:
    return " + ".join(f"{weight if ' ' in w else 1} * cast(contains({c}, {text(w)}) as integer)" for w in words)


def _category_sql(c: str) -> str:
    scores = ", ".join(f"{_hits(f'lower({c})', words, 2)}" for _, words in W.ISSUE_CATEGORIES)
    names = ", ".join(text(n) for n, _ in W.ISSUE_CATEGORIES)
    return f"case when list_max([{scores}]) > 0 then [{names}][list_position([{scores}], list_max([{scores}]))] else 'Other' end"


def _subcategory_sql(c: str, category: str) -> str:
    def best(subs):
        scores = ", ".join("(" + " + ".join(f"cast(contains(lower({c}), {text(w)}) as integer)" for w in words) + ")" for _, words in subs)
        return f"case when list_max([{scores}]) > 0 then [{', '.join(text(n) for n, _ in subs)}][list_position([{scores}], list_max([{scores}]))] else 'General' end"

    return case([(f"{category} = {text(name)}", best(subs)) for name, subs in W.ISSUE_SUBCATEGORIES.items()], "'General'")


def _cluster_sql(c: str) -> str:
    stop = "[" + ", ".join(map(text, W.CLUSTER_STOPWORDS)) + "]"
    tokens = f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '' and not list_contains({stop}, lower(x)))"
    cap = f"list_transform({tokens}, lambda x: upper(x[1:1]) || lower(x[2:]))"
    rest = f"case when len({cap}) >= 2 then {cap}[1] || ' & ' || {cap}[2] || ' Inquiries' when len({cap}) = 1 then {cap}[1] || ' Inquiries' else 'General Support & Conversational Inquiries' end"
    return case([(_any(f"lower({c})", words), text(title)) for title, words in W.CLUSTER_TITLES], rest)


def _department_sql(c: str) -> str:
    return case([(f"contains(lower({c}), {text(t.lower())})", text(n)) for t, n in W.DEPARTMENT_OF_TITLE] + [(_any(f"lower({c})", w), text(n)) for n, w in W.DEPARTMENT_OF_WORD], text(W.OTHER_DEPARTMENT))


def _whole(c: str, words) -> str:
    return matches(c, rf"(^|[^{L}])({'|'.join(words)})($|[^{L}])")


low = "lower(text)"

over_conversations("c1_clean_text", lambda m: m.select("tweet_id", T.clean_text("text").alias("clean_text")), f"select tweet_id, {_clean_sql('text')} as clean_text from cv")
over_documents("c1_clean_documents", lambda d: d.select("doc_id", F.md5(T.clean_text("text")).alias("clean_md5")), f"select doc_id, md5({_clean_sql('text')}) as clean_md5 from documents")
over_conversations(
    "c2_simple_clean",
    lambda m: m.select("tweet_id", "created_at", T.simple_clean("text").alias("clean_text")).where("length(clean_text) > 0").select("tweet_id", "clean_text", F.unix_timestamp("created_at").alias("at")),
    f"select tweet_id, {_simple_sql('text')} as clean_text, cast(epoch(created_at) as bigint) as at from cv where length({_simple_sql('text')}) > 0",
)
over_conversations("c3_language", lambda m: m.select("tweet_id", T.detect_language("text").alias("language")), f"select tweet_id, {_language_sql('text')} as language from cv")
over_documents("c3_language_documents", lambda d: d.groupBy(T.detect_language("text").alias("language")).agg(F.count("*").alias("documents")), f"select {_language_sql('text')} as language, count(*) as documents from documents group by 1")
_neg, _pos = _any(low, W.NEGATIVE_STEMS), _any(low, W.POSITIVE_STEMS)
over_events(
    "c4_sentiment_fast",
    lambda m: m.select("tweet_id", T.sentiment_fast("text").alias("s")).select("tweet_id", "s.sentiment", "s.score", "s.confidence"),
    f"select tweet_id, case when {_neg} and not {_pos} then 'negative' when {_pos} and not {_neg} then 'positive' else 'neutral' end as sentiment, case when {_neg} and not {_pos} then -1 when {_pos} and not {_neg} then 1 else 0 end as score, case when {_neg} <> {_pos} then 0.88 else 0.70 end::double as confidence from ev",
)
_lead = f"(({_hits(low, W.POSITIVE_VOTES)}) - ({_hits(low, W.NEGATIVE_VOTES)}))"
over_conversations(
    "c5_sentiment_vote",
    lambda m: m.select("tweet_id", T.sentiment_vote("text").alias("s")).select("tweet_id", "s.sentiment", "s.confidence"),
    f"select tweet_id, case when {_lead} < 0 then 'negative' when {_lead} > 0 then 'positive' else 'neutral' end as sentiment, case when {_lead} < 0 then 0.85 when {_lead} > 0 then 0.80 else 0.70 end::double as confidence from cv",
)
over_conversations(
    "c6_topic_rule",
    lambda m: m.select("tweet_id", T.topic_rule("text").alias("t")).select("tweet_id", "t.topic_id", "t.topic_keywords"),
    f"select tweet_id, {case([(_any(low, s), str(i)) for i, _, s in W.TOPIC_DOMAINS], '6')} as topic_id, {case([(_any(low, s), text(k)) for _, k, s in W.TOPIC_DOMAINS], text(W.OTHER_TOPIC[1]))} as topic_keywords from cv",
)
over_conversations(
    "c7_cluster_name",
    lambda m: m.select("tweet_id", T.cluster_name(T.topic_rule("text")["topic_keywords"]).alias("by_topic"), T.cluster_name("text").alias("by_text")),
    f"select tweet_id, {_cluster_sql(case([(_any(low, s), text(k)) for _, k, s in W.TOPIC_DOMAINS], text(W.OTHER_TOPIC[1])))} as by_topic, {_cluster_sql('text')} as by_text from cv",
)
over_events("c8_department", lambda m: m.select("tweet_id", "text", T.cluster_name("topic_keywords").alias("cluster")).select("tweet_id", T.department("cluster").alias("by_cluster"), T.department("text").alias("by_text")), f"select tweet_id, {_department_sql('(' + _cluster_sql('topic_keywords') + ')')} as by_cluster, {_department_sql('text')} as by_text from ev")
over_conversations("c9_issue_category", lambda m: m.select("tweet_id", T.issue_category("text").alias("issue_category")), f"select tweet_id, {_category_sql('text')} as issue_category from cv")
over_conversations(
    "c10_issue_subcategory",
    lambda m: m.select("tweet_id", "text", T.issue_category("text").alias("c")).select("tweet_id", "c", T.issue_subcategory("text", "c").alias("s")).select("tweet_id", F.col("s").alias("issue_subcategory"), F.concat_ws(" - ", "c", "s").alias("customer_pain_point")),
    f"select tweet_id, s as issue_subcategory, c || ' - ' || s as customer_pain_point from (select tweet_id, c, {_subcategory_sql('text', 'c')} as s from (select tweet_id, text, {_category_sql('text')} as c from cv))",
)
_first = _any(low, W.RELABEL_STEPS[0][2])
over_events(
    "c11_relabel",
    lambda m: m.withColumn("topic", F.when(F.col("tweet_id") % 2 == 0, F.lit(W.PENDING_TOPIC)).otherwise(F.col("topic_keywords"))).select("tweet_id", T.relabel("text", "topic").alias("r")).select("tweet_id", "r.topic_keywords", "r.pain_point"),
    "select tweet_id, "
    + case([(_first, text(W.RELABEL_STEPS[0][0])), ("t = 'Pending AI Discovery'", case([(_any(low, s), text(n)) for n, _, s in W.RELABEL_STEPS[1:]], text(W.RELABEL_REST[0])))], "t")
    + " as topic_keywords, "
    + case([(_first, text(W.RELABEL_STEPS[0][1])), ("t = 'Pending AI Discovery'", case([(_any(low, s), text(p)) for _, p, s in W.RELABEL_STEPS[1:]], text(W.RELABEL_REST[1])))], "null")
    + " as pain_point from (select *, case when tweet_id % 2 = 0 then 'Pending AI Discovery' else topic_keywords end as t from ev)",
)
over_conversations(
    "c12_intent",
    lambda m: m.select("tweet_id", T.intent("text").alias("i")).select("tweet_id", "i.intent", "i.confidence"),
    f"select tweet_id, i as intent, case when i = 'general_support' then 0.65 else 0.88 end::double as confidence from (select tweet_id, {case([(_whole(low, w), text(n)) for n, w in W.INTENTS], text('general_support'))} as i from cv)",
)
over_conversations(
    "c13_entities",
    lambda m: m.select("tweet_id", T.entities("text").alias("e")).select("tweet_id", "e.*"),
    f"select tweet_id, case when contains({low}, 'ios') or contains({low}, 'iphone') then 'iOS' when contains({low}, 'android') then 'Android' when contains({low}, 'web') then 'web' end as platform, case when contains({low}, 'app') then 'mobile app' end as product, case when contains({low}, 'login') then 'login problem' when contains({low}, 'crash') then 'app crash' end as issue, case when contains({low}, 'this week') then 'this week' end as date from cv",
)
_cn, _cp = _any(low, W.CONTEXT_NEGATIVE), _any(low, W.CONTEXT_POSITIVE)
over_conversations(
    "c14_context",
    lambda m: m.select("tweet_id", T.context("text").alias("c")).select("tweet_id", "c.*"),
    f"select tweet_id, case when {_cn} then 'negative' when {_cp} then 'positive' else 'neutral' end as sentiment, case when {_cn} then 0.9 when {_cp} then 0.82 else 0.7 end::double as confidence, "
    f"case when {_any(low, ['crash', 'unstable'])} then 'app_crash' when {_any(low, ['login', 'password'])} then 'login_problem' when contains({low}, 'refund') then 'refund_request' else 'general_support' end as topic, "
    f"case when {_any(low, ['crash', 'unstable'])} then 'application instability' when {_any(low, ['login', 'password'])} then 'account access friction' when {_any(low, ['refund', 'charge'])} then 'billing or refund friction' else 'unspecified support friction' end as pain_point, "
    f"case when {_any(low, ['crash', 'unstable'])} then 'high' when {_any(low, ['login', 'password', 'refund', 'charge'])} then 'medium' else 'low' end as severity from cv",
)
over_events("c19_sentiment_score", lambda m: m.groupBy(T.sentiment_score("sentiment").alias("score")).agg(F.count("*").alias("messages")), "select case sentiment when 'positive' then 1 when 'negative' then -1 else 0 end as score, count(*) as messages from ev group by 1")
over_events("c20_shown_sentiment", lambda m: m.select("tweet_id", T.shown_sentiment("sentiment", "text").alias("shown")), f"select tweet_id, case when {_any(low, [w for w in W.STRONG_NEGATIVE])} then 'negative' else lower(coalesce(sentiment, 'neutral')) end as shown from ev")
over_events(
    "c21_date_parts",
    lambda m: m.select("tweet_id", F.date_format("created_at", "yyyy-MM").alias("month"), F.date_format("created_at", "yyyy-MM-dd HH:00").alias("hour"), F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week"), F.year("created_at").alias("y"), F.month("created_at").alias("m")),
    "select tweet_id, strftime(created_at, '%Y-%m') as month, strftime(created_at, '%Y-%m-%d %H:00') as hour, strftime(date_trunc('week', created_at), '%Y-%m-%d') as week, year(created_at) as y, month(created_at) as m from ev",
)

SQL = {"cluster": _cluster_sql, "category": _category_sql, "subcategory": _subcategory_sql, "simple": _simple_sql, "clean": _clean_sql, "language": _language_sql, "department": _department_sql}
