"""Normalisation of labels, flags, ids and dimensions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions import text as T
from vocspark.functions import wordlists as W


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(c: Column | str) -> Column:
    """Whether a text flag says yes: one of the true words, in any case; null says no."""
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin(list(W.TRUE_WORDS)), F.lit(False))


def flag_or_null(c: Column | str) -> Column:
    """true/1/yes/y/t and false/0/no/n/f, else null."""
    low = F.lower(F.trim(_col(c).cast("string")))
    return F.when(low.isin("true", "1", "yes", "y", "t"), True).when(low.isin("false", "0", "no", "n", "f"), False)


def sentiment(c: Column | str) -> Column:
    """positive, negative or neutral; anything else is neutral."""
    low = F.lower(_col(c))
    return F.when(low.isin("positive", "negative"), low).otherwise("neutral")


SENTIMENT_ALIASES = {"pos": "positive", "neg": "negative", "neu": "neutral", "mixed": "neutral"}


def sentiment_alias(c: Column | str) -> Column:
    """As ``sentiment``, with short forms understood; null and unknown are Unknown."""
    low = F.lower(F.trim(_col(c)))
    found = F.when(low.isin("positive", "negative", "neutral"), low)
    for short, whole in SENTIMENT_ALIASES.items():
        found = F.when(low == short, whole).otherwise(found)
    return F.coalesce(found, F.lit("Unknown"))


def timestamp(c: Column | str) -> Column:
    """ISO 8601 or ``EEE MMM dd HH:mm:ss Z yyyy``, null for anything else."""
    c = _col(c).cast("string")
    # The long form's day name is no input of the date.
    plain = F.regexp_replace(c, r"^[A-Za-z]{3} ", "")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(plain, F.lit("MMM dd HH:mm:ss Z yyyy")))


def topic(c: Column | str) -> Column:
    """Topic label; null, other, unclassified and nan are General Support."""
    c = _col(c)
    return F.when(c.isNull() | c.isin("other", "unclassified", "nan"), "General Support").otherwise(c)


def handle(c: Column | str) -> Column:
    """First @handle of a text, null for none."""
    found = F.regexp_extract(F.coalesce(_col(c), F.lit("")), rf"@([{T.LETTER}]+)", 1)
    return F.when(found != "", found)


def company(company: Column | str, author: Column | str, inbound: Column | str, text: Column | str) -> Column:
    """A company that is not a number, else a non-customer's author id, else the first handle, else General Enterprise."""
    named = F.trim(_col(company))
    named = F.when((named != "") & ~named.rlike("^[0-9]+$"), named)
    agent = F.when(~_col(inbound) & ~_col(author).rlike("^[0-9]+$"), _col(author))
    return F.coalesce(named, agent, handle(text), F.lit("General Enterprise"))


REGION_CUTS = ((52, "North America"), (74, "Europe"), (88, "Asia Pacific"), (95, "Latin America"))
REGION_REST = "Middle East & Africa"


def bucket(c: Column | str, buckets: int = 100) -> Column:
    """A number from 0 to ``buckets`` - 1 from the first 32 bits of the value's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(_col(c), F.lit(""))), 1, 8), 16, 10).cast("long") % buckets


# Support handles, their companies, and the regions of those that have one of their own.
COMPANY_OF_HANDLE = (
    ("AmazonHelp", "Amazon"), ("AppleSupport", "Apple"), ("Uber_Support", "Uber"), ("Delta", "Delta Air Lines"), ("SpotifyCares", "Spotify"),
    ("AmericanAir", "American Airlines"), ("British_Airways", "British Airways"), ("comcastcares", "Comcast / Xfinity"), ("XboxSupport", "Microsoft Xbox"), ("VirginTrains", "Virgin Trains"),
    ("TMobileHelp", "T-Mobile"), ("SouthwestAir", "Southwest Airlines"), ("Tesco", "Tesco"), ("hulu_support", "Hulu"), ("AskPlayStation", "Sony PlayStation"),
    ("Safaricom_Care", "Safaricom"), ("VerizonSupport", "Verizon"), ("ChipotleTweets", "Chipotle"), ("sprintcare", "Sprint"), ("Ask_Spectrum", "Charter Spectrum"),
)
OTHER_COMPANY = "Global Enterprise"
REGION_OF_HANDLES = (
    ("Europe", ("British_Airways", "SpotifyCares", "VirginTrains", "Tesco")),
    ("North America", ("Delta", "AmericanAir", "comcastcares", "TMobileHelp", "SouthwestAir", "hulu_support", "VerizonSupport", "ChipotleTweets", "sprintcare", "Ask_Spectrum", "AppleSupport")),
    ("Middle East & Africa", ("Safaricom_Care",)),
)


def company_of_handle(c: Column | str) -> Column:
    """The company of a support handle, else the common name of all others."""
    known = F.create_map(*(F.lit(x) for pair in COMPANY_OF_HANDLE for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(_col(c), F.lit(""))), F.lit(OTHER_COMPANY))


def region(c: Column | str) -> Column:
    """The region of a known handle, else one by the value's bucket of 100."""
    b, name = bucket(c), F.lit(REGION_REST)
    for cut, label in reversed(REGION_CUTS):
        name = F.when(b < cut, label).otherwise(name)
    for label, handles in reversed(REGION_OF_HANDLES):
        name = F.when(_col(c).isin(*handles), label).otherwise(name)
    return name


REGION_TITLES = (
    ("North America", ("us", "america", "canada")),
    ("Europe", ("eu", "europe", "uk")),
    ("Asia Pacific", ("asia", "apac", "india", "japan")),
    ("Latin America", ("latam", "latin", "brazil", "mexico")),
    ("Middle East & Africa", ("africa", "middle", "mea")),
)


def region_title(c: Column | str) -> Column:
    """Display title of a region code or name; an unknown one in capitals."""
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    name = F.initcap(low)
    for title, words in reversed(REGION_TITLES):
        hit = F.lit(False)
        for w in words:
            hit = hit | ((low == w) if len(w) <= 3 else low.contains(w))
        name = F.when(hit, title).otherwise(name)
    return name


def priority_of(response_minutes: Column | str, sentiment: Column | str) -> Column:
    """urgent for a slow answer or negative tone, else normal."""
    return F.when((_col(response_minutes) > 120) | (_col(sentiment) == "negative"), "urgent").otherwise("normal")


def first_existing(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that ``df`` has; exact names before any letter case."""
    exact = [c for c in candidates if c in df.columns]
    if exact:
        return exact[0]
    low = {c.lower(): c for c in df.columns}
    return next((low[c.lower()] for c in candidates if c.lower() in low), None)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has all ``columns``; raises ValueError that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> dict[str, str | None]:
    """Names of the text, timestamp and id columns: those given, else known names, else by content.

    Without a known text column, it is the string column with the greatest mean length, found in
    one aggregation over all string columns.
    """
    mapping = mapping or {}
    known = {
        "text": ["text", "clean_text", "message", "content", "body", "comment", "tweet", "review"],
        "created_at": ["created_at", "timestamp", "date", "datetime", "time", "start_time"],
        "tweet_id": ["tweet_id", "id", "message_id", "conversation_id"],
    }
    found = {k: mapping.get(k) or first_existing(df, names) for k, names in known.items()}
    strings = [c for c, kind in df.dtypes if kind == "string"]
    if not found["text"] and strings:
        row = df.agg(*(F.avg(F.length(c)).alias(c) for c in strings)).first()
        found["text"] = max(strings, key=lambda c: row[c] or 0)
    return found


def normalise(df: DataFrame, run_id: str | None = None, user_id: str | None = None) -> DataFrame:
    """``df`` with the canonical names of response time, topic and sentiment, and run and user stamps."""
    aliases = {
        "response_time_minutes": (["response_time_minutes", "average_response_time_minutes", "first_response_time_minutes", "response_time"], lambda c: F.col(c).cast("string").try_cast("double")),
        "topic_keywords": (["topic_keywords", "pain_point", "customer_pain_point", "complaint_category", "topic", "intent", "issue_type"], topic),
        "sentiment": (["sentiment", "sentiment_end", "sentiment_start", "sentiment_label", "sentiment_class"], sentiment),
    }
    for name, (candidates, rule) in aliases.items():
        source = first_existing(df, candidates)
        if source:
            df = df.withColumn(name, rule(source))
    if run_id is not None:
        df = df.withColumn("dataset_run_id", F.lit(run_id))
    return df if user_id is None else df.withColumn("user_id", F.lit(user_id))
