"""Batch retrieval: a table of queries against a table of messages or vectors."""

from __future__ import annotations

import difflib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions import search_text as S

#: Queries whose vectors are held at once (64 dimensions take 5 MB); more are taken in blocks.
QUERY_BLOCK = 10_000


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 15, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` most similar vectors by cosine for each query.

    Blocks of queries are broadcast; the vectors stream past them once a block, each batch as one
    matrix product that keeps its own best ``k``, and only these are ranked. Ties go to the
    smaller id. Null vectors match nothing.
    """
    spark = vectors.sparkSession
    held = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v")).where("v is not null")
    blocks = max(1, -(-held.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        rows = held.where(F.expr(f"pmod(xxhash64(query_id), {blocks}) = {block}")).toPandas() if blocks > 1 else held.toPandas()
        if not len(rows):
            continue
        matrix = np.stack(rows["v"]).astype(np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), matrix))  # at most QUERY_BLOCK rows

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                batch = batch[batch["v"].notna()]
                for at in range(0, len(batch), 4096):
                    part = batch.iloc[at : at + 4096]
                    m = np.stack(part["v"]).astype(np.float64)
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
                    scores = np.round(matrix @ m.T, 6)
                    order = np.lexsort((np.broadcast_to(part["id"].to_numpy(), scores.shape), -scores), axis=1)[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": part["id"].to_numpy()[order].ravel(), "similarity": np.take_along_axis(scores, order, axis=1).ravel()})

        found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(best, "query_id long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def _uuid5(values: pd.Series) -> pd.Series:
    return values.map(lambda v: str(uuid.uuid5(uuid.NAMESPACE_URL, v)), na_action="ignore")


def ingest_points(messages: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, document, payload): messages with text under a stable id: the number itself, else a UUID of the name."""
    raw = F.col(id_col).cast("string")
    rows = messages.where(F.length(F.trim(text_col)) > 0)
    rest = [c for c in messages.columns if c not in (id_col, text_col)]
    return rows.select(F.when(raw.rlike("^[0-9]+$"), raw).otherwise(F.pandas_udf(_uuid5, "string")(raw)).alias("id"), F.col(text_col).alias("document"), F.struct(*rest).alias("payload"))


def rerank(candidates: DataFrame, top: int = 5) -> DataFrame:
    """Candidates (query_id, query, id, text, inbound, author_id, score, excluded) by a blend of four scores.

    0.35 similarity + 0.25 specificity + 0.2 intent + 0.2 metadata, less 0.75 (0.01 at least) if an
    excluded term occurs.
    """
    text = F.coalesce("text", F.lit(""))
    out = candidates.withColumns({"specificity": S.specificity(text), "intent": S.intent_match(F.col("query"), text), "metadata": S.metadata_signal(text, F.col("inbound"), F.col("author_id"))})
    blend = F.col("score") * 0.35 + F.col("specificity") * 0.25 + F.col("intent") * 0.2 + F.col("metadata") * 0.2
    bad = has_term(text, F.col("excluded"))
    out = out.withColumn("rerank_score", F.round(F.when(bad, F.greatest(F.lit(0.01), blend - 0.75)).otherwise(blend), 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id"))).where(F.col("rank") <= top)


def has_term(text: Column, terms: Column) -> Column:
    """Whether a text has one of ``terms`` as whole words; a null or empty list has none."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    return F.coalesce(F.exists(terms, lambda t: spaced.contains(F.concat(F.lit(" "), F.lower(t), F.lit(" ")))), F.lit(False))


def drop_excluded(candidates: DataFrame) -> DataFrame:
    """Candidates without excluded terms; a query of which none would be left keeps all."""
    from vocspark.operators.filters import keep_or_all

    return keep_or_all(candidates, ~has_term(F.coalesce("text", F.lit("")), F.col("excluded")), "query_id")


def interleave(lists: DataFrame) -> DataFrame:
    """(query_id, id, place) from (query_id, list_no, depth, id): one of each list in turn, the first occurrence of an id counts."""
    first = lists.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("depth", "list_no"))).where("n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "list_no"))).select("query_id", "id", "place")


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, rrf): reciprocal rank fusion of lists (query_id, list_no, depth from 1, id)."""
    return lists.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("depth"))).alias("rrf"))


_CONTRACTIONS = ((r"can'?t|can\s+not", "cannot"), (r"won'?t", "will not"), (r"don'?t", "do not"), (r"isn'?t", "is not"), (r"i'?m", "i am"))


def comparable(c: Column) -> Column:
    """Lower case, contractions spelled out, punctuation off, spaces squeezed."""
    text = F.lower(c)
    for pattern, plain in _CONTRACTIONS:
        text = F.regexp_replace(text, rf"\b(?:{pattern})\b", plain)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def diversify(candidates: DataFrame, threshold: float = 0.65, most: int = 5) -> DataFrame:
    """(query_id, id, rank, kept, duplicate_of, duplicate_similarity): ranked results without near repeats, greedily, up to ``most`` kept.

    Results of a query are few (a candidate limit), so each query is one group. Those after the
    last kept one are not judged and not returned, nor are results without text.
    """

    def likeness(a: str, b: str) -> float:
        return 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, kept = [], []
        for r in pdf.sort_values("rank").itertuples():
            twin, near = next(((k.id, x) for k in kept if (x := likeness(r.form, k.form)) >= threshold), (None, None))
            rows.append((r.query_id, r.id, r.rank, near is None, twin, near))
            if near is None:
                kept.append(r)
                if len(kept) == most:
                    break
        return pd.DataFrame(rows, columns=["query_id", "id", "rank", "kept", "duplicate_of", "duplicate_similarity"]).astype({"duplicate_of": "Int64", "duplicate_similarity": "float64"})

    forms = candidates.where(F.length(F.trim("text")) > 0).select("query_id", "id", "rank", comparable(F.col("text")).alias("form"))
    return forms.groupBy("query_id").applyInPandas(judge, "query_id long, id long, rank int, kept boolean, duplicate_of long, duplicate_similarity double")


def diversity(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, original_count, deduped_count, removed_count, diversity_ratio) of each query from what ``diversify`` has judged.

    The ratio is that of kept to all candidates, those without text and those not judged among them.
    """
    counts = judged.groupBy("query_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"))
    out = candidates.groupBy("query_id").agg(F.count("*").alias("original_count")).join(counts, "query_id", "left")
    out = out.select("query_id", "original_count", F.coalesce("kept", F.lit(0)).alias("deduped_count"), F.coalesce("removed", F.lit(0)).alias("removed_count"))
    return out.withColumn("diversity_ratio", F.round(F.col("deduped_count") / F.col("original_count"), 3))


def distinct_snippets(candidates: DataFrame, most: int = 12, chars: int = 500) -> DataFrame:
    """The first ``most`` different texts of each query, cut to ``chars``."""
    once = candidates.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("rank"))).where("n = 1")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return ranked.where(F.col("place") <= most).select("query_id", "place", "id", F.substring("text", 1, chars).alias("snippet"))


def composite_relevance(candidates: DataFrame, least: float = 0.35) -> DataFrame:
    """0.5 similarity + 0.3 lexical + 0.2 topic; rows of at least ``least``, with the query's maximum and whether it is in domain."""
    q = S.query_tokens(F.col("query"))
    lexical = F.when(F.size(q) == 0, 0.5).otherwise(F.size(F.array_intersect(q, S.tokens(F.coalesce("text", F.lit("")), "-"))) / F.greatest(F.size(q), F.lit(1)))
    topic_words = F.filter(F.transform(F.split(F.coalesce("topic_keywords", F.lit("")), ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    topic = F.when(F.size(topic_words) == 0, lexical).otherwise(F.size(F.array_intersect(q, topic_words)) / F.greatest(F.size(topic_words), F.lit(1)))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))) * 0.5 + lexical * 0.3 + topic * 0.2, 6)
    out = candidates.withColumn("composite", score).withColumn("best", F.max("composite").over(Window.partitionBy("query_id")))
    return out.withColumn("in_domain", F.col("best") >= least).where(F.col("composite") >= least)


def chunks(messages: DataFrame) -> DataFrame:
    """(chunk_id, chunk_type, text, inbound, token_estimate): the opening customer turn and windows of three turns, step one.

    Windows at the end are shorter and stay. A conversation of one message is a chunk of its own.
    """
    by = Window.partitionBy("conversation_id").orderBy("created_at", "tweet_id")
    m = messages.withColumn("i", F.row_number().over(by) - 1).withColumn("turns", F.count("*").over(Window.partitionBy("conversation_id")))
    tokens = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    said = F.concat(F.when(F.col("inbound"), "[Customer]: ").otherwise("[Agent]: "), F.coalesce("text", F.lit("")))
    three = by.rowsBetween(0, 2)
    windows = m.withColumn("said", said).where("turns > 1").withColumn("text", F.array_join(F.collect_list("said").over(three), " \n ")).withColumn("any_in", F.max(F.col("inbound").cast("int")).over(three) == 1)
    windows = windows.select(F.concat("conversation_id", F.lit("_turn_"), F.col("i").cast("string")).alias("chunk_id"), F.lit("diagnostic_dialogue").alias("chunk_type"), "text", F.col("any_in").alias("inbound"), tokens(F.col("text")).alias("token_estimate"))
    first = m.where("inbound and turns > 1").groupBy("conversation_id").agg(F.min_by("text", "i").alias("opening"))
    problems = first.select(F.concat("conversation_id", F.lit("_problem")).alias("chunk_id"), F.lit("problem_declaration").alias("chunk_type"), F.concat(F.lit("[Customer Issue Declaration]: "), "opening").alias("text"), F.lit(True).alias("inbound"), tokens(F.col("opening")).alias("token_estimate"))
    singles = m.where("turns = 1").select(F.concat("conversation_id", F.lit("_c0")).alias("chunk_id"), F.lit("single_turn").alias("chunk_type"), "text", "inbound", tokens(F.col("text")).alias("token_estimate"))
    return windows.unionByName(problems).unionByName(singles)


def hybrid_fill(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int = 10) -> DataFrame:
    """Vector hits first, then keyword hits not yet there, up to ``limit`` for each query."""
    both = vector_hits.select("query_id", "id", "rank", F.lit(0).alias("source")).unionByName(keyword_hits.select("query_id", "id", "rank", F.lit(1).alias("source")))
    once = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("source", "rank"))).where("n = 1")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "rank")))
    return ranked.where(F.col("place") <= limit).select("query_id", "id", "source", "place")


def log_summary(logs: DataFrame) -> DataFrame:
    """Queries, mean latency and similarity, and the in-domain rate of a retrieval log."""
    return logs.agg(F.count("*").alias("queries"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("similarity").alias("avg_similarity"), (F.avg(F.coalesce("in_domain", F.lit(False)).cast("int")) * 100).alias("in_domain_rate"))


def topic_words(documents: DataFrame, topic: str, text: str, top: int = 6, letters: int = 3) -> DataFrame:
    """(topic, word, score, rank): class-based tf-idf, tf log(1 + A / f), with A the mean number of words per topic."""
    words = documents.select(F.col(topic).alias("topic"), F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= letters)
    tf = words.groupBy("topic", "word").agg(F.count("*").alias("tf"))
    f = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    mean = tf.agg((F.sum("tf") / F.count_distinct("topic")).alias("a"))
    scored = tf.join(f, "word").crossJoin(F.broadcast(mean)).withColumn("score", F.round(F.col("tf") * F.log(1 + F.col("a") / F.col("f")), 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "word"))).where(F.col("rank") <= top).select("topic", "word", "tf", "score", "rank")


def embedding_clusters(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """(id, topic_id, confidence): k-means over normalised embeddings; confidence falls with the distance to the centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(vector_col, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-30)))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(unit).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic_id").fit(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    gap = F.aggregate(F.zip_with(vector_to_array("features"), F.get(centres, F.col("topic_id")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(rows).select("id", "topic_id", (1 / (1 + F.sqrt(gap))).alias("confidence"))


