"""Queries of search text rules and batch retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocspark.functions import search_text as S
from vocspark.operators import keywords as K
from vocspark.operators import retrieval as R
from vocspark.operators import vectors as V
from vocspark.operators.neargroups import near_groups
from vocspark.plans.registry import over_conversations, over_documents, register, text
from vocspark.plans.text_queries import L
from vocspark.sources import adapters
from vocspark.sources.shared import fresh

# --- text rules
over_conversations("c15_demojize", lambda m: m.select("tweet_id", S.demojize("text").alias("plain")))


def _spelling(m):
    return S.correct_tokens(m.select(F.explode(F.split("text", r"\s+")).alias("token")).where("token rlike '^[a-zA-Z]+$'"), S.frequent_words(m, "text", 30))


_FIXED = ", ".join(f"({text(a)}, {text(b)})" for a, b in (*S.SYNONYMS, *S.ABBREVIATIONS, *((a, a.upper()) for a in S.CAPITALS), *((a, a) for a in S.ACRONYMS)))
_NO_TARGETS = ", ".join(map(text, S.NO_TARGETS))
over_conversations(
    "c16_spell_correction",
    _spelling,
    rf""", tk as (select distinct lower(w) as token from (select unnest(string_split_regex(text, '\s+')) as w from cv) where regexp_full_match(w, '[a-zA-Z]+')),
v as materialized (select word, count(*) as n from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as word from cv) where length(word) >= 3 group by 1 having count(*) >= 30),
fx(token, fixed) as (values {_FIXED}), ch as (select token, string_split(token, '') as c from tk),
fm as (select token, array_to_string(list_filter(c, lambda x, i: i < 3 or x <> c[i - 1] or x <> c[i - 2]), '') as pairs, array_to_string(list_filter(c, lambda x, i: i < 2 or x <> c[i - 1]), '') as singles from ch),
st as materialized (select fm.token, coalesce(fixed, a.word, b.word, s.word) as settled from fm left join fx using (token) left join v a on a.word = fm.token left join v b on b.word = pairs left join v s on s.word = singles),
near as (select token, word, n, levenshtein(token, word) as d from st join v on word[1] = token[1] and word not in ({_NO_TARGETS}) and abs(length(word) - length(token)) <= 2 where settled is null and length(token) >= 3 and d <= case when length(token) <= 4 then 1 else 2 end),
best as (select token, arg_min(word, (10 * d - 4 - case when word[-1] = token[-1] then 2 else 0 end + abs(length(word) - length(token)), -n, word)) as nearest from near group by token)
select token, coalesce(settled, nearest, token) as corrected from st left join best using (token)""",
)
over_conversations(
    "c17_query_gate",
    lambda m: m.select("tweet_id", S.quality_status("text").alias("status")),
    rf""", p as (select tweet_id, trim(coalesce(text, '')) as raw, lower(trim(coalesce(text, ''))) as low from cv), w as (select *, list_filter(string_split_regex(low, '[^a-z0-9_''-]+'), lambda w: w <> '') as words, regexp_replace(low, '^[.,!?]+|[.,!?]+$', '', 'g') as bare from p),
f as (select *, len(words) <= 4 and len(list_filter(words, lambda w: regexp_matches(w, '^({'|'.join(S.MASHED)})'))) >= greatest(1, len(words) // 2) as mash,
  len(list_filter(words, lambda w: regexp_full_match(w, '[a-z]{{6,}}') and (not regexp_matches(w, '[aeiouy]') or (length(w) >= 8 and length(regexp_replace(w, '[^aeiouy]', '', 'g')) / length(w) < 0.15)))) > 0 as unsayable from w)
select tweet_id, case when raw = '' then 'empty' when not regexp_matches(raw, '\p{{L}}') or mash or unsayable then 'gibberish' when bare in ({', '.join(map(text, S.GREETINGS))}) then 'greeting'
  when len(string_split_regex(raw, '\s+')) = 1 and length(raw) < 15 then 'too_generic' when regexp_matches(low, {text('|'.join(f'(?:{p})' for p in S.OUT_OF_DOMAIN))}) then 'out_of_domain' else 'valid' end as status from f""",
)
over_conversations(
    "c18_sub_queries",
    lambda m: m.select("tweet_id", F.posexplode(S.sub_queries("text")).alias("no", "part")).select("tweet_id", "no", F.md5("part").alias("part_md5")),
    r""", p as (select tweet_id, trim(text) as raw, list_filter(list_transform(string_split_regex(trim(text), '(?i)\s+(?:and also|in addition to|as well as|also|plus|and|;)\s+'), lambda x: trim(x)), lambda x: len(string_split_regex(x, '\s+')) >= 2) as parts from cv),
q as (select tweet_id, case when len(parts) >= 2 then parts else [raw] end as parts from p) select tweet_id, cast(generate_subscripts(parts, 1) - 1 as integer) as no, md5(unnest(parts)) as part_md5 from q""",
)
over_conversations("c18_negation_focus", lambda m: m.select("tweet_id", S.focus_and_excluded("text").alias("f")).select("tweet_id", "f.focus", F.array_join("f.excluded", ",").alias("excluded")))

# --- vectors
_VECTORS = """qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0), sims as (select query_id, vec_id as id, round(list_cosine_similarity(cast(q as double[]), cast(embedding as double[])), 6) as similarity from qv cross join embeddings),
top as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims)"""


def _hits(spark, d, k=15):
    v = adapters.read(spark, d, "embeddings")
    return R.vector_topk(v, v.where("vec_id % 50 = 0"), k)


register("i1_vector_topk", _hits, f"with {_VECTORS} select query_id, id, similarity, rank from top where rank <= 15")


def _indexed(spark, d, probes=None):
    v = adapters.read(spark, d, "embeddings")
    index = V.build_index(v)
    return V.search_index(index, v.where("vec_id % 50 = 0"), probes=probes)


register("i1_vector_index", _indexed)
register("i1_vector_index_all_cells", lambda spark, d: _indexed(spark, d, V.MOST_CELLS), f"with {_VECTORS} select query_id, id, similarity, rank from top where rank <= 15")
register("i2_ingest_points", lambda spark, d: R.ingest_points(adapters.from_events(spark, d).withColumn("key", F.when(F.col("tweet_id") % 2 == 0, F.col("tweet_id").cast("string")).otherwise(F.col("conversation_id"))), "key").select("id", F.md5("document").alias("document_md5"), "payload.topic_keywords"))
register("i17_embedding_clusters", lambda spark, d: R.embedding_clusters(adapters.read(spark, d, "embeddings")))
register(
    "i17_density_clusters",
    lambda spark, d: V.density_clusters(adapters.read(spark, d, "embeddings"), 0.36, 3),
    """with recursive s as materialized (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score from embeddings a cross join embeddings b where score >= 0.36),
n as materialized (select a as id, count(*) as n_near, count(*) >= 3 as is_core from s group by a), link as materialized (select a, b from s join n x on x.id = a and x.is_core join n y on y.id = b and y.is_core),
reach as (select id, id as root from n where is_core union select link.b, reach.root from reach join link on link.a = reach.id), topic as (select id, min(root) as topic_id from reach group by id),
border as (select a as id, arg_min(topic_id, (-score, b)) as topic_id, max(score) as score from s join topic on topic.id = b group by a)
select id, coalesce(t.topic_id, e.topic_id, -1) as topic_id, is_core, n_near, case when is_core then 1.0 else coalesce(e.score, 0.0) end as confidence from n left join topic t using (id) left join border e using (id)""",
)


# --- keywords and candidates
def _messages(spark, d):
    return adapters.threaded(adapters.from_conversations(spark, d)).withColumn("topic_keywords", F.lit("General Support"))


def _queries(m):
    """The whole opening messages of the conversations whose id is divisible by 50 ask."""
    return m.where("tweet_id % 5000 = 1").select(F.col("tweet_id").alias("query_id"), F.col("text").alias("query"))


def _candidates(spark, d, limit=10):
    m = _messages(spark, d)
    q = _queries(m)
    hits = K.keyword_search(m, q, limit)
    return hits.join(q, "query_id").join(m, "tweet_id").select("query_id", "query", F.col("tweet_id").alias("id"), "rank", "text", "inbound", "author_id", "topic_keywords", (1 / (1 + F.col("rank"))).alias("score"), F.array(F.lit("delayed"), F.lit("login")).alias("excluded"))


_PLAIN_QUERY = r"trim(regexp_replace(lower(query), '[^\p{L}\p{N}_\s]', '', 'g'))"
_STOP = "[" + ", ".join(map(text, K.KEYWORD_STOPWORDS)) + "]"
_KEYWORDS = rf"""{adapters.CONVERSATIONS_SQL}, q as (select tweet_id as query_id, text as query from cv where tweet_id % 5000 = 1),
qw as (select query_id, query, list_slice(list_filter(string_split_regex({_PLAIN_QUERY}, '\s+'), lambda w: length(w) > 2 and not list_contains({_STOP}, w)), 1, 4) as words from q),
kw as (select query_id, tweet_id, row_number() over (partition by query_id order by case when sentiment = 'negative' then 0 else 1 end, tweet_id desc) as rank from cv, qw where inbound and length(text) >= 25 and len(list_filter(words, lambda w: contains(lower(text || ' General Support'), w))) > 0),
cand as (select kw.query_id, q.query, kw.tweet_id as id, rank, cv.text, inbound, author_id, 1.0 / (1 + rank) as score from kw join q using (query_id) join cv on cv.tweet_id = kw.tweet_id where rank <= 10)"""
register("i3_keyword_search", lambda spark, d: K.keyword_search(_messages(spark, d), _queries(_messages(spark, d))), f"with {_KEYWORDS} select query_id, tweet_id, rank from kw where rank <= 10")


def _by_postings(spark, d):
    """The same search over postings that two runs have added to a stored index, the first of them twice."""
    m, path = _messages(spark, d), fresh(spark, "postings")
    half = lambda n: m.where(F.col("tweet_id") % 2 == n)
    for n in (0, 1, 0):
        K.write_postings(half(n), path, f"run_{n}")
    return K.keyword_search(m, _queries(m), index=K.read_postings(spark, path))


register("i3_posting_index", _by_postings, f"with {_KEYWORDS} select query_id, tweet_id, rank from kw where rank <= 10")

# Events of four kinds have a cluster; the openings ask, and some of them name a company, product or region.
_EVENT_CLUSTERS = {"error": "Application malfunction", "purchase": "Incorrect or unexpected charges", "click": "Delivery or order issue", "signup": "Account access problem"}
_ASKED = {"company": ("query_id // 100 % 3 = 0", "Borealis"), "region": ("query_id // 100 % 4 = 0", "EUROPE"), "product": ("query_id // 100 % 7 = 0", "product_3")}


def _clustered(spark, d):
    named = {adapters.EVENT_TOPICS[kind]: cluster for kind, cluster in _EVENT_CLUSTERS.items()}
    topics = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))
    return adapters.from_events(spark, d).withColumn("topic_keywords", F.coalesce(F.try_element_at(topics, F.col("topic_keywords")), F.col("topic_keywords")))


def _filtered(spark, d):
    asked = {c: F.expr(f"case when {when.replace('//', 'div')} then '{value}' end") for c, (when, value) in _ASKED.items()}
    return K.filtered_search(adapters.from_events(spark, d), _queries(_messages(spark, d)).withColumns(asked))


_PHRASE = "case " + " ".join(f"when contains(lower(query), {text(a)}) then {text(b)}" for a, b in K.CLUSTER_PHRASES) + " end"
_EVENT_TOPIC = "case topic_keywords " + " ".join(f"when {text(adapters.EVENT_TOPICS[a])} then {text(b)}" for a, b in _EVENT_CLUSTERS.items()) + " else topic_keywords end"
register(
    "i3_cluster_search",
    lambda spark, d: K.cluster_search(_clustered(spark, d), _queries(_messages(spark, d))),
    rf"""with {adapters.CONVERSATIONS_SQL}, {adapters.EVENTS_SQL}, em as materialized (select tweet_id, text, case when sentiment = 'negative' then 0 else 1 end as tone, {_EVENT_TOPIC} as cluster from ev where inbound and length(text) >= 25),
q as materialized (select tweet_id as query_id, text as query, {_PHRASE} as cluster from cv where tweet_id % 5000 = 1),
top as (select * from (select *, row_number() over (partition by cluster order by tone, tweet_id desc) as rank from em) where rank <= 15),
hit as (select query_id, top.tweet_id, rank, true as by_cluster from q join top using (cluster)),
qw as (select query_id, list_slice(list_filter(string_split_regex({_PLAIN_QUERY}, '\s+'), lambda w: length(w) > 2 and not list_contains({_STOP}, w)), 1, 4) as words from q where query_id not in (select query_id from hit)),
by_word as (select query_id, tweet_id, row_number() over (partition by query_id order by tone, tweet_id desc) as rank from em, qw where len(list_filter(words, lambda w: contains(lower(text || chr(1) || cluster), w))) > 0)
select * from hit union all select query_id, tweet_id, rank, false from by_word where rank <= 15""",
)
_FIRST_STOP = "[" + ", ".join(map(text, K.FIRST_STOPWORDS)) + "]"
_FITS = " and ".join(f"(not ({when}) or lower({c}) = {text(value.lower())})" for c, (when, value) in _ASKED.items())
register(
    "i3_filtered_search",
    _filtered,
    rf"""with {adapters.CONVERSATIONS_SQL}, {adapters.EVENTS_SQL}, q as (select tweet_id as query_id, {_PLAIN_QUERY.replace('query', 'text')} as plain from cv where tweet_id % 5000 = 1),
fk as materialized (select query_id, coalesce(list_filter(string_split_regex(plain, '\s+'), lambda w: length(w) > 3 and not list_contains({_FIRST_STOP}, w))[1], case when length(plain) > 3 then plain end) as word from q),
em as materialized (select * from ev where length(text) >= 15 and (inbound or not (contains(lower(author_id), 'help') or contains(lower(author_id), 'support'))))
select query_id, tweet_id, rank from (select query_id, tweet_id, row_number() over (partition by query_id order by case when sentiment = 'negative' then 0 else 1 end, created_at desc, tweet_id desc) as rank from em join fk on contains(lower(text), word) and {_FITS}) where rank <= 5""",
)


def _tokens(c: str, extra: str = "") -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({c}), '[^{L}{extra}]+'), lambda t: regexp_full_match(t, '[a-z0-9_{extra}]+')))"


_QSTOP = "[" + ", ".join(map(text, S.QUERY_STOPWORDS)) + "]"
_QT = f"list_filter({_tokens('query', '-')}, lambda t: not list_contains({_QSTOP}, t))"
_SYM = "[" + ", ".join(map(text, S.SYMPTOMS)) + "]"
_N = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
_SCORES = f"""sc as (select *, case when {_N} = 0 then 0.0 when {_N} <= 2 then 0.1 when {_N} <= 5 then 0.3 when {_N} <= 10 then 0.6 else 0.5 * case when {_N} <= 35 then 0.9 else 1.0 end + 0.5 * least(1.0, 0.35 * len(list_intersect({_tokens('text')}, {_SYM}))) end as specificity,
  case when len({_QT}) = 0 then 0.5 else len(list_intersect({_QT}, {_tokens('text', '-')})) * 1.0 / len({_QT}) end as intent,
  case when regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in S.CANNED).replace("'", "''")}') then 0.15 when not inbound or regexp_matches(lower(author_id), 'support|help|care') then 0.4 else 0.95 end as metadata,
  regexp_matches(' ' || regexp_replace(lower(text), '[^{L}]+', ' ', 'g') || ' ', ' (delayed|login) ') as bad from cand)"""
register("i4_candidate_scores", lambda spark, d: R.rerank(_candidates(spark, d), 100).select("query_id", "id", "specificity", "intent", "metadata"), f"with {_KEYWORDS}, {_SCORES} select query_id, id, specificity::double as specificity, intent, metadata::double as metadata from sc")
register(
    "i5_rerank",
    lambda spark, d: R.rerank(_candidates(spark, d)).select("query_id", "id", "rerank_score", "rank"),
    f"with {_KEYWORDS}, {_SCORES}, b as (select *, 0.35 * score + 0.25 * specificity + 0.2 * intent + 0.2 * metadata as blend from sc), r as (select query_id, id, round(case when bad then greatest(0.01, blend - 0.75) else blend end, 6) as rerank_score from b) select * from (select *, row_number() over (partition by query_id order by rerank_score desc, id) as rank from r) where rank <= 5",
)
register("i6_drop_excluded", lambda spark, d: R.drop_excluded(_candidates(spark, d)).select("query_id", "id"), f"with {_KEYWORDS}, {_SCORES} select query_id, id from (select *, bool_and(bad) over (partition by query_id) as all_bad from sc) where all_bad or not bad")


def _lists(spark, d):
    c = _candidates(spark, d)
    again = R.rerank(c, 10).select("query_id", F.lit(1).alias("list_no"), F.col("rank").alias("depth"), "id")
    return c.select("query_id", F.lit(0).alias("list_no"), F.col("rank").alias("depth"), "id").unionByName(again)


_LISTS = f"""{_KEYWORDS}, {_SCORES}, rr as (select query_id, id, row_number() over (partition by query_id order by round(case when bad then greatest(0.01, 0.35 * score + 0.25 * specificity + 0.2 * intent + 0.2 * metadata - 0.75) else 0.35 * score + 0.25 * specificity + 0.2 * intent + 0.2 * metadata end, 6) desc, id) as depth from sc),
ls as (select query_id, 0 as list_no, rank as depth, id from cand union all select query_id, 1, depth, id from rr)"""
register("i7_interleave", lambda spark, d: R.interleave(_lists(spark, d)), f"with {_LISTS} select query_id, id, row_number() over (partition by query_id order by depth, list_no) as place from (select *, row_number() over (partition by query_id, id order by depth, list_no) as n from ls) where n = 1")
register("i8_rank_fusion", lambda spark, d: R.fuse(_lists(spark, d)), f"with {_LISTS} select query_id, id, sum(1.0 / (60 + depth)) as rrf from ls group by 1, 2")
register("i9_diversify", lambda spark, d: R.diversify(_candidates(spark, d)))
register("i9_diversity", lambda spark, d: (lambda c: R.diversity(c, R.diversify(c)))(_candidates(spark, d)))
_FORM = r"trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_PLAIN = "lower(coalesce(text, ''))"
for _pattern, _plain in R._CONTRACTIONS:
    _PLAIN = f"regexp_replace({_PLAIN}, {text(rf'\b(?:{_pattern})\b')}, '{_plain}', 'g')"
over_documents(
    "i10_near_groups",
    near_groups,
    f"""with recursive f as materialized (select doc_id as id, {_FORM.format(_PLAIN)} as form from documents), e as materialized (select min(id) as node, form, string_split(form, ' ') as w from f group by form),
sh as materialized (select distinct node, unnest(case when len(w) < 3 then [form] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s from e), n as (select node, count(*) as n from sh group by node),
c as (select x.node as a, y.node as b, count(*) as common from sh x join sh y on x.s = y.s and x.node <> y.node group by all),
link as materialized (select a, b from c join n p on p.node = a join n q on q.node = b where common >= 0.65 * (p.n + q.n - common) - 1e-7),
reach as (select node as id, node as root from e union select link.b, reach.root from reach join link on link.a = reach.id), g as (select id as node, min(root) as group_id from reach group by id), k as (select a as node, count(*) as n_links from link group by a)
select f.id, group_id, coalesce(n_links, 0) as n_links from f join e using (form) join g using (node) left join k using (node)""",
)
register(
    "i11_distinct_snippets",
    lambda spark, d: R.distinct_snippets(_candidates(spark, d, 20)).select("query_id", "place", "id", F.md5("snippet").alias("snippet_md5")),
    f"with {_KEYWORDS.replace('rank <= 10', 'rank <= 20')}, o as (select *, row_number() over (partition by query_id, text order by rank) as n from cand) select query_id, place, id, md5(substr(text, 1, 500)) as snippet_md5 from (select *, row_number() over (partition by query_id order by rank) as place from o where n = 1) where place <= 12",
)
register(
    "i12_composite_relevance",
    lambda spark, d: R.composite_relevance(_candidates(spark, d)).select("query_id", "id", "composite", "best", "in_domain"),
    f"with {_KEYWORDS}, c as (select query_id, id, round(0.5 * score + 0.3 * case when len({_QT}) = 0 then 0.5 else len(list_intersect({_QT}, {_tokens('text', '-')})) * 1.0 / len({_QT}) end + 0.2 * len(list_intersect({_QT}, ['general support'])), 6) as composite from cand) select * from (select *, max(composite) over (partition by query_id) as best, max(composite) over (partition by query_id) >= 0.35 as in_domain from c) where composite >= 0.35",
)
_WORDS = r"cast(len(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')) as integer)"
over_conversations(
    "i13_chunks",
    lambda m: R.chunks(adapters.threaded(m)).withColumn("text", F.md5("text")),
    f""", o as (select *, row_number() over (partition by conversation_id order by created_at, tweet_id) - 1 as i, count(*) over (partition by conversation_id) as turns, case when inbound then '[Customer]: ' else '[Agent]: ' end || text as said from cv),
w as (select conversation_id || '_turn_' || i as chunk_id, 'diagnostic_dialogue' as chunk_type, array_to_string(list(said) over x, ' ' || chr(10) || ' ') as text, bool_or(inbound) over x as inbound from o where turns > 1 window x as (partition by conversation_id order by i rows between current row and 2 following)),
p as (select conversation_id, arg_min(text, i) as opening from o where inbound and turns > 1 group by 1)
select chunk_id, chunk_type, md5(text) as text, inbound, {_WORDS.format(c='text')} as token_estimate from w union all select conversation_id || '_problem', 'problem_declaration', md5('[Customer Issue Declaration]: ' || opening), true, {_WORDS.format(c='opening')} from p union all select conversation_id || '_c0', 'single_turn', md5(text), inbound, {_WORDS.format(c='text')} from o where turns = 1""",
)


def _fill(spark, d):
    """A vector's number is that of the conversation whose opening it stands for."""
    opening = lambda c: (F.col(c) * 100 + 1).alias(c)
    hits = _hits(spark, d, 6).select(opening("query_id"), opening("id"), "rank")
    lexical = K.keyword_search(_messages(spark, d), _queries(_messages(spark, d))).withColumnRenamed("tweet_id", "id")
    return R.hybrid_fill(hits, lexical, 10)


register(
    "i14_hybrid_fill",
    _fill,
    f"with {_KEYWORDS}, {_VECTORS}, b as (select query_id * 100 + 1 as query_id, id * 100 + 1 as id, rank, 0 as source from top where rank <= 6 union all select query_id, tweet_id, rank, 1 from kw where rank <= 10), o as (select *, row_number() over (partition by query_id, id order by source, rank) as n from b) select query_id, id, source, place from (select *, row_number() over (partition by query_id order by source, rank) as place from o where n = 1) where place <= 10",
)
register(
    "i15_log_summary",
    lambda spark, d: R.log_summary(_hits(spark, d, 1).select((F.col("query_id") % 40 + 5.0).alias("latency_ms"), "similarity", (F.col("id") % 3 != 0).alias("in_domain"))),
    f"with {_VECTORS} select count(*) as queries, avg(query_id % 40 + 5.0) as avg_latency_ms, avg(similarity) as avg_similarity, avg((id % 3 <> 0)::int) * 100 as in_domain_rate from top where rank = 1",
)
over_documents(
    "i16_topic_words",
    lambda d: R.topic_words(d, "lang", "text"),
    r"with w as (select lang as topic, unnest(string_split_regex(lower(text), '[^\p{L}]+')) as word from documents), tf as (select topic, word, count(*) as tf from w where length(word) >= 3 group by 1, 2), f as (select word, sum(tf) as f from tf group by 1), a as (select sum(tf) * 1.0 / count(distinct topic) as a from tf), s as (select topic, word, tf, round(tf * ln(1 + a / f), 6) as score from tf join f using (word) cross join a) select * from (select *, row_number() over (partition by topic order by score desc, word) as rank from s) where rank <= 6",
)
