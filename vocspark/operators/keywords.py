"""Keyword search of a table of queries in a table of messages, by postings of three-character runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocspark.sources.scratch import Scratch

# Fixed values from here to HELPERS: stop words of both searches, phrases that name a cluster, first hit first, and names of agents.
KEYWORD_STOPWORDS = ("what", "which", "where", "tell", "show", "give", "have", "with", "this", "that", "like", "about", "the", "a", "an", "is", "are", "was", "were", "for", "from", "and", "or", "inquiries", "inquiry")
FIRST_STOPWORDS = ("what", "which", "where", "tell", "show", "give", "have", "with", "this", "that", "like", "about", "customer", "issue", "inquiries", "inquiry", "support", "poor")
CLUSTER_PHRASES = (
    ("poor customer support", "Poor customer support"), ("support inquiries", "Poor customer support"), ("customer service", "Poor customer support"),
    ("application malfunction", "Application malfunction"), ("crashes", "Application malfunction"), ("stability", "Application malfunction"), ("app crash", "Application malfunction"),
    ("delivery", "Delivery or order issue"), ("order issue", "Delivery or order issue"), ("tracking", "Delivery or order issue"), ("shipment", "Delivery or order issue"),
    ("incorrect or unexpected charges", "Incorrect or unexpected charges"), ("billing", "Incorrect or unexpected charges"), ("invoices", "Incorrect or unexpected charges"), ("charges", "Incorrect or unexpected charges"), ("payment", "Incorrect or unexpected charges"),
    ("account access problem", "Account access problem"), ("password", "Account access problem"), ("auth", "Account access problem"), ("login", "Account access problem"), ("2fa", "Account access problem"),
    ("poor or unstable connectivity", "Poor or unstable connectivity"), ("connectivity", "Poor or unstable connectivity"), ("network", "Poor or unstable connectivity"), ("signal", "Poor or unstable connectivity"),
    ("technical failure", "Technical failure"), ("plan or subscription problem", "Plan or subscription problem"), ("subscription", "Plan or subscription problem"),
    ("refund delay or failure", "Refund delay or failure"), ("refund", "Refund delay or failure"), ("dispute", "Refund delay or failure"),
)
HELPERS = ("help", "support")

#: Parts of a posting table by gram.
SLICES = 64

#: Between the columns of a text: no query has it.
GAP = "\x01"


def plain_query(c: Column) -> Column:
    """A query in lower case without punctuation."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def content_words(c: Column, most: int = 4) -> Column:
    """The first ``most`` words over two letters that are no stop words."""
    words = F.filter(F.split(plain_query(c), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(list(KEYWORD_STOPWORDS)))
    return F.slice(words, 1, most)


def first_keyword(c: Column) -> Column:
    """The first word over three letters that is no stop word, else the whole query if it has over three letters, else null."""
    words = F.filter(F.split(plain_query(c), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(list(FIRST_STOPWORDS)))
    return F.coalesce(F.get(words, F.lit(0)), F.when(F.length(plain_query(c)) > 3, plain_query(c)))


def named_cluster(c: Column) -> Column:
    """The cluster of the first phrase of the list that a query has; null without one."""
    low = F.lower(c)
    return F.coalesce(*(F.when(low.contains(phrase), cluster) for phrase, cluster in CLUSTER_PHRASES))


def _body() -> Column:
    return F.coalesce("clean_text", "text", F.lit(""))


def searchable(messages: DataFrame, columns: tuple[str, ...] = ("text", "clean_text", "topic_keywords")) -> DataFrame:
    """Messages with ``low`` (what is searched, in lower case), ``tone`` (0 for negative, else 1) and a clean_text, null where there is none."""
    if "clean_text" not in messages.columns:
        messages = messages.withColumn("clean_text", F.lit(None).cast("string"))
    low = F.lower(F.concat_ws(GAP, *(c for c in columns if c in messages.columns)))
    return messages.withColumns({"low": low, "tone": F.coalesce((F.lower("sentiment") != "negative").cast("int"), F.lit(1))})


def _grams(c: Column) -> Column:
    cut = lambda i: F.substring(c, i, F.lit(3))
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), cut))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame) -> DataFrame:
    """(gram, tweet_id): every run of three characters of ``low``, once a row; the text stays behind."""
    return rows.select("tweet_id", F.explode(_grams(F.col("low"))).alias("gram")).select("gram", "tweet_id")


def _slice() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(SLICES)).cast("int")


def write_postings(messages: DataFrame, path: str, run_id: str, files: int = 1) -> None:
    """Add the postings of a run's messages to a stored index; a run written again replaces itself alone.

    Each part is dealt to ``files`` tasks by message, so that a frequent run of characters is not
    one task's: about one for each 10 million messages.
    """
    rows = postings(searchable(messages)).withColumns({"dataset_run_id": F.lit(run_id), "slice": _slice(), "file": F.pmod(F.xxhash64("tweet_id"), F.lit(files))})
    rows = rows.repartition("slice", "file").drop("file").sortWithinPartitions("slice", "gram", "tweet_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_run_id", "slice").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(gram, tweet_id, slice) of all runs of a stored index."""
    return spark.read.schema("gram string, tweet_id long, dataset_run_id string, slice int").parquet(path).select("gram", "tweet_id", "slice")


def containing(rows: DataFrame, words: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``rows`` with each of ``words`` (word), of three characters or more, that is somewhere in their ``low``.

    A word meets the postings of its rarest run only, and the texts of what it finds there are
    looked through. Without a stored ``index`` the postings of the words' own runs are made once
    and kept for the session. ``rows`` may be some of the messages of the index.
    """
    asked = words.where("word is not null").select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    grams = asked.select("gram").distinct()
    if index is None:
        found = Scratch(rows.sparkSession, "postings").keep(postings(rows).join(grams, "gram", "left_semi"))
    else:
        found = index.join(grams.withColumn("slice", _slice()), ["slice", "gram"], "left_semi").select("gram", "tweet_id")
    counts = found.groupBy("gram").agg(F.count("*").alias("n"))
    number = F.coalesce("n", F.lit(0))
    rarest = asked.join(counts, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(number, "gram")).alias("gram"), F.min(number).alias("n")).where("n > 0")
    pairs = rarest.select("word", "gram").join(found, "gram").select("word", "tweet_id").distinct()
    return rows.join(pairs, "tweet_id").where(F.col("low").contains(F.col("word")))


def _best(hits: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def _newest() -> list[Column]:
    return [F.col("tone"), F.desc("tweet_id")]


def _from_customers(messages: DataFrame, shortest: int) -> DataFrame:
    return searchable(messages).where(F.col("inbound") & (F.length(_body()) >= shortest))


def keyword_search(messages: DataFrame, queries: DataFrame, limit: int = 10, shortest: int = 25, index: DataFrame | None = None) -> DataFrame:
    """(query_id, tweet_id, rank): customer messages that contain one of a query's content words.

    Negative messages come first, then the newest id; a message that occurs twice is found once.
    Each distinct word of all ``queries`` (query_id, query) finds its first ``limit`` messages, and
    a query's first ones are among those of its words, so that no query is held against all
    messages. A query without content words, or null, finds nothing.
    """
    asked = queries.select("query_id", F.explode(content_words(F.col("query"))).alias("word")).distinct()
    rows = _from_customers(messages, shortest).select("tweet_id", "tone", "low")
    found = containing(rows, asked, index).select("word", "tone", "tweet_id").distinct()
    first = _best(found, ["word"], _newest(), limit).drop("rank")
    hits = asked.join(first, "word").select("query_id", "tone", "tweet_id").distinct()
    return _best(hits, ["query_id"], _newest(), limit).select("query_id", "tweet_id", "rank")


def cluster_search(messages: DataFrame, queries: DataFrame, limit: int = 15, shortest: int = 25, index: DataFrame | None = None) -> DataFrame:
    """(query_id, tweet_id, rank, by_cluster): messages of the cluster that a query's phrase names, else those of its words.

    A query whose cluster has no customer message, or that names none, goes to ``keyword_search``;
    where that finds nothing either there is no row.
    """
    named = queries.select("query_id", named_cluster(F.col("query")).alias("cluster"))
    asked = F.col("topic_keywords").isin(sorted({c for _, c in CLUSTER_PHRASES}))
    rows = _from_customers(messages, shortest).where(asked).select(F.col("topic_keywords").alias("cluster"), "tone", "tweet_id").distinct()
    # at most ``limit`` rows for each of the clusters in the list
    first = F.broadcast(_best(rows, ["cluster"], _newest(), limit))
    hits = named.join(first, "cluster").select("query_id", "tweet_id", "rank", F.lit(True).alias("by_cluster"))
    filled = F.broadcast(first.select("cluster").distinct())
    rest = queries.withColumn("cluster", named_cluster(F.col("query"))).join(filled, "cluster", "left_anti")
    return hits.unionByName(keyword_search(messages, rest, limit, shortest, index).withColumn("by_cluster", F.lit(False)))


def filtered_search(messages: DataFrame, queries: DataFrame, limit: int = 5, shortest: int = 15, index: DataFrame | None = None) -> DataFrame:
    """(query_id, tweet_id, rank): messages with a query's first keyword, of its company, product and region where it names them.

    ``queries`` is (query_id, query) with any of company, product and region; null filters nothing,
    and names are compared in lower case. Messages of agents stay out; those whose side is unknown
    are taken. Negative ones come first, then the newest, then the greatest id.
    """
    names = [c for c in ("company", "product", "region") if c in queries.columns]
    asks = queries.select("query_id", first_keyword(F.col("query")).alias("word"), *(F.lower(c).alias(f"asked_{c}") for c in names)).where("word is not null").distinct()
    kinds = ["word", *(f"asked_{c}" for c in names)]
    helper = reduce(lambda a, b: a | b, (F.lower("author_id").contains(h) for h in HELPERS))
    customer = F.coalesce("inbound", F.lit(True)) | ~F.coalesce(helper, F.lit(True))
    rows = searchable(messages, ("text", "clean_text")).where((F.length(_body()) >= shortest) & customer).select("tweet_id", "tone", "created_at", "low", *names)
    same_word = containing(rows, asks, index)
    fits = reduce(lambda a, b: a & b, (F.col(f"asked_{c}").isNull() | (F.lower(c) == F.col(f"asked_{c}")) for c in names), F.lit(True))
    found = same_word.join(asks.select(*kinds).distinct(), "word").where(fits).select(*kinds, "tone", "created_at", "tweet_id").distinct()
    first = _best(found, kinds, [F.col("tone"), F.desc_nulls_last("created_at"), F.desc("tweet_id")], limit)
    same = reduce(lambda a, b: a & b, (F.col(f"q.{k}").eqNullSafe(F.col(f"f.{k}")) for k in kinds))
    return asks.alias("q").join(first.alias("f"), same).select("query_id", "tweet_id", "rank")
