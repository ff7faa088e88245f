"""Rules over search queries and snippets: emoji, spelling, quality gate, negation, intents, scores."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.text import LETTER

# Emoji and the words they stand for, in the order in which they are replaced.
EMOJI = (
    ("🔋", "battery"), ("💀", "dead"), ("🔥", "overheating"), ("😡", "angry frustrated"), ("🤬", "angry outraged"), ("📶", "wifi signal"), ("📱", "phone device"), ("💻", "laptop computer"), ("💳", "payment card billing"), ("💰", "money billing"),
    ("💸", "money refund"), ("📦", "package order delivery"), ("🚚", "shipping delivery transit"), ("✈️", "flight baggage travel"), ("⏳", "slow delayed waiting"), ("⌛", "delayed response time"), ("⏱️", "response time sla"), ("🔒", "password account locked"), ("🔑", "auth login key"), ("❌", "failed error not working"),
    ("🚫", "blocked forbidden error"), ("😭", "crying upset complaint"), ("😢", "sad unhappy complaint"), ("👍", "good satisfied resolved"), ("✨", "great awesome"), ("😊", "happy satisfied"), ("💔", "broken heartbroken"), ("⚠️", "warning issue alert"), ("🚨", "critical urgent emergency"),
)
# Fixed values from here to EMPTY_WORDS: short forms, synonyms, symptom words, reply patterns and word lists that results depend on.
ABBREVIATIONS = (
    ("avrg", "average"), ("avg", "average"), ("msgs", "messages"), ("msg", "message"), ("mins", "minutes"), ("min", "minute"), ("hrs", "hours"), ("hr", "hour"), ("sec", "seconds"), ("secs", "seconds"), ("ph", "phone"), ("phn", "phone"), ("updt", "update"),
    ("cust", "customer"), ("supp", "support"), ("serv", "service"), ("pwd", "password"), ("passwd", "password"), ("cant", "cannot"), ("dont", "do not"), ("wont", "will not"), ("isnt", "is not"), ("didnt", "did not"), ("hasnt", "has not"), ("havent", "have not"),
)
SYNONYMS = (
    ("handset", "phone"), ("handsets", "phones"), ("cellphone", "phone"), ("cellphones", "phones"), ("smartphone", "phone"), ("smartphones", "phones"), ("hanging", "freezing"), ("hangs", "freezes"), ("hung", "frozen"),
    ("firmware", "software update"), ("wlan", "wifi"), ("hotspot", "wifi"), ("sluggish", "slow"), ("depleted", "drained"), ("bricked", "broken"), ("overbilled", "overcharged"), ("tariff", "plan"), ("tariffs", "plans"),
)
CAPITALS = ("sla", "fcr", "csat", "kpi", "api", "2fa", "p0", "p1", "voc")
ACRONYMS = ("kpis", "apis", "ui", "ux", "mfa", "sim", "wifi", "os", "ios", "p2", "p3")
NO_TARGETS = (
    "emea", "apac", "latam", "fcr", "sla", "csat", "kpi", "kpis", "p0", "p1", "p2", "voc", "api", "2fa", "nah", "nan", "am", "an", "as", "at", "be", "by", "do", "he",
    "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we",
)
SYMPTOMS = (
    "crash", "crashed", "crashing", "crashes", "freeze", "freezing", "frozen", "freezes", "stuck", "hanging", "slow", "lag", "lagging", "latency", "delay", "delayed", "delays", "dropped", "error", "errors", "broken", "failed", "failing", "failure",
    "bug", "bugs", "glitch", "glitches", "malfunction", "drain", "draining", "heating", "overheating", "cannot", "can't", "unable", "unusable", "unresponsive", "refund", "refunded", "charge", "charged", "overcharge", "lost", "missing", "damaged", "wrong", "late",
)
CANNED = (
    r"please\s+(?:dm|direct message|send us a dm|email)\s+us", r"we'?d\s+like\s+to\s+help.*please\s+reach\s+out", r"thanks\s+for\s+reaching\s+out.*dm\s+us",
    r"apologies\s+for\s+the\s+inconvenience.*please\s+contact", r"our\s+team\s+is\s+looking\s+into\s+this", r"hi\s+there,\s+please\s+send",
)
QUERY_STOPWORDS = ("the", "a", "an", "is", "are", "in", "on", "of", "to", "for", "with", "my", "our", "why", "what", "how")
MASHED = ("asdf", "ghjk", "qwer", "zxcv", "hjkl", "poiuy", "lkjhg", "mnbvc", "12345", "xyz123")
GREETINGS = ("hi", "hello", "hey", "greetings", "help", "howdy", "sup", "good morning", "good afternoon", "good evening", "need help")
OUT_OF_DOMAIN = (
    r"capital\s+of", r"president\s+of", r"prime\s+minister", r"population\s+of", r"weather\s+in", r"weather\s+forecast", r"who\s+won\s+the", r"world\s+cup", r"super\s+bowl", r"recipe\s+for", r"how\s+to\s+(?:bake|cook)", r"chocolate\s+cake",
    r"speed\s+of\s+light", r"quantum\s+physics", r"black\s+hole", r"solar\s+system", r"who\s+(?:wrote|directed)", r"lyrics\s+of", r"tell\s+me\s+a\s+joke", r"write\s+a\s+poem", r"derivative\s+of", r"square\s+root\s+of",
)
INFLECTIONS = (
    ("freeze", "freezing", "frozen", "freezes"), ("crash", "crashing", "crashed", "crashes"), ("drain", "draining", "drains", "drained"), ("login", "logging", "sign in", "signing in"), ("lag", "lagging", "lags", "slow", "slowly"),
    ("drop", "dropped", "dropping", "drops"), ("heat", "heating", "overheat", "overheating", "hot"), ("disconnect", "disconnecting", "disconnected", "disconnects"), ("delay", "delayed", "delays", "delaying", "late"),
)
EMPTY_WORDS = ("the", "and", "for", "with", "have", "has", "been", "very", "much", "issues", "issue", "problem", "problems")


def _name_emoji(texts: pd.Series) -> pd.Series:
    """Pictographs become their Unicode names; Spark has no function for these."""
    named = lambda c: f" {unicodedata.name(c, ' ').lower()} " if ord(c) > 0x1F000 else c
    return texts.map(lambda t: t if t.isascii() else "".join(map(named, t)), na_action="ignore")


def demojize(c: Column | str) -> Column:
    """Emoji as words, links and handles blanked, hashtags unwrapped, spaces squeezed."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for emoji, words in EMOJI:
        text = F.replace(text, F.lit(emoji), F.lit(f" {words} "))
    text = F.pandas_udf(_name_emoji, "string")(text)
    text = F.regexp_replace(F.regexp_replace(text, r"https?://\S+|www\.\S+", " "), rf"@[{LETTER}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"#([{LETTER}]+)", " $1 "), r"\s+", " "))


def tokens(c: Column, extra: str = "") -> Column:
    """Distinct lower-case ASCII words between other characters than letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(c), rf"[^{LETTER}{extra}]+"), lambda t: t.rlike(f"^[a-z0-9_{extra}]+$")))


def query_tokens(c: Column) -> Column:
    return F.array_except(tokens(c, "-"), F.array(*map(F.lit, QUERY_STOPWORDS)))


def specificity(c: Column | str) -> Column:
    """Up to ten words by their number alone; longer texts half by length, half by distinct symptom words."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    symptoms = F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, SYMPTOMS))))
    long = F.when(n <= 35, 0.9).otherwise(1.0) * 0.5 + F.least(F.lit(1.0), symptoms * 0.35) * 0.5
    return F.when(n == 0, 0.0).when(n <= 2, 0.1).when(n <= 5, 0.3).when(n <= 10, 0.6).otherwise(long)


def intent_match(query: Column, text: Column) -> Column:
    """Share of a query's content words that a text has; one half for a query without any."""
    words = query_tokens(query)
    return F.when(F.size(words) == 0, 0.5).otherwise(F.size(F.array_intersect(words, tokens(text, "-"))) / F.size(words))


def metadata_signal(text: Column, inbound: Column, author: Column) -> Column:
    """0.15 for a canned reply, 0.4 for an agent, 0.95 for a customer, else 0.7."""
    canned = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in CANNED))
    agent = F.coalesce(~inbound, F.lit(False)) | F.lower(author).rlike("support|help|care")
    customer = F.coalesce(inbound, F.lit(False)) | (inbound.isNull() & text.contains("@"))
    return F.when(canned, 0.15).when(agent, 0.4).when(customer, 0.95).otherwise(0.7)


def quality_status(c: Column | str) -> Column:
    """empty, gibberish, greeting, too_generic, out_of_domain or valid."""
    raw = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    low = F.lower(raw)
    words = F.filter(F.split(low, r"[^a-z0-9_'-]+"), lambda w: w != "")
    mashed = lambda w: w.rlike("^(" + "|".join(MASHED) + ")")
    mash = (F.size(words) <= 4) & (F.size(F.filter(words, mashed)) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))
    vowels = lambda w: F.length(F.regexp_replace(w, "[^aeiouy]", ""))
    unsayable = F.exists(words, lambda w: w.rlike("^[a-z]{6,}$") & ((vowels(w) == 0) | ((F.length(w) >= 8) & (vowels(w) / F.length(w) < 0.15))))
    bare = F.regexp_replace(low, r"^[.,!?]+|[.,!?]+$", "")
    single = (F.size(F.split(raw, r"\s+")) == 1) & (F.length(raw) < 15)
    return (
        F.when(raw == "", "empty").when(~raw.rlike(r"\p{L}"), "gibberish").when(mash | unsayable, "gibberish").when(bare.isin(list(GREETINGS)), "greeting")
        .when(single, "too_generic").when(low.rlike("|".join(f"(?:{p})" for p in OUT_OF_DOMAIN)), "out_of_domain").otherwise("valid")
    )


SPLIT_INTENTS = r"(?i)\s+(?:and also|in addition to|as well as|also|plus|and|;)\s+"


def sub_queries(c: Column | str) -> Column:
    """Clauses of at least two words if there are two of them, else the whole query."""
    raw = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    parts = F.filter(F.transform(F.split(raw, SPLIT_INTENTS), lambda p: F.trim(p)), lambda p: F.size(F.split(p, r"\s+")) >= 2)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(raw))


def _inflected(words: list[str]) -> list[str]:
    out = set()
    for w in words:
        out.add(w)
        group = next((g for g in INFLECTIONS if w in g), ())
        out.update(group)
        if not group and w.endswith("ing") and len(w) > 4:
            out.update((w[:-3], w[:-3] + "es", w[:-3] + "ed"))
    return sorted(out)


# How a request begins after what it wants left out.
OPENERS = ("tell me about", "show me", "look at", "focus on", "what about", "how about", "why is", "why are")
_DIRECTIVE = re.compile(r"^(?:ignore|skip|exclude|excluding|aside from)\s+([^,;\n]+?)[,;\s]+(?:" + "|".join(OPENERS) + r")?\s*(.+)$")
_POSTFIX = re.compile(r"^(.+?)\s+(?:without|excluding|not including|except for|and not)\s+(.+)$")
# What joins a negated clause to the one that is asked for, and words of a clause that are no subject.
CONNECTIVES = ("but", "however", "instead", "yet", "though", "except that", "other than that", "rather than")
DETERMINERS = ("the", "my", "a", "an")
VERBS = ("is", "are", "was", "were", "has", "have", "keeps", "keep", "starts", "started")
_CONTRAST = re.compile(r"[,;\s]+(?:" + "|".join(CONNECTIVES) + r")\s+")
_NEGATIVE = re.compile(r"\b(?:not|no|never|without|cannot|can't|won't|isn't|aren't|don't|doesn't|didn't)\b")


def _subject(clause: str) -> str:
    """What a negated clause is about: its first word, with the one before if that is a determiner; nothing if no negation follows."""
    words = clause.split()
    size = 2 if words[:1] in (["my"], ["the"]) else 1
    rest = words[size + (words[size : size + 1] != [] and words[size] in VERBS) :]
    return " ".join(words[:size]) if len(rest) > 1 and rest[0] in ("not", "never", "without", "no", "isn't") else ""


def _with_subject(subject: str, clause: str) -> str:
    """The clause about the subject, unless it names one of the subject's longer words itself."""
    if not subject or any(len(w) > 2 and w in clause for w in subject.split()):
        return clause
    first, _, rest = clause.partition(" ")
    return f"{subject} {rest.strip() if first in DETERMINERS and rest else clause}"


def _split_focus(query: str) -> tuple[str, list[str]]:
    """(what to look for, what to leave out)."""
    low = query.lower().strip()
    found = _DIRECTIVE.match(low)
    if found:
        left_out, focus = found[1], found[2]
    elif (found := _POSTFIX.match(low)) and not _NEGATIVE.search(found[1]):
        focus, left_out = found[1], found[2]
    else:
        parts = _CONTRAST.split(low, maxsplit=1)
        if len(parts) < 2 or not _NEGATIVE.search(parts[0]) or _NEGATIVE.search(parts[1]):
            return query, []
        left_out, focus = parts[0][_NEGATIVE.search(parts[0]).end() :], _with_subject(_subject(parts[0]), parts[1].strip())
    words = [w for w in re.findall(r"[a-z]{3,}", left_out) if w not in EMPTY_WORDS]
    return focus.strip(), _inflected(words)


def _focus_rows(queries: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_split_focus(q or "") for q in queries], columns=["focus", "excluded"])


def focus_and_excluded(c: Column | str) -> Column:
    """struct<focus, excluded> of directive, postfix and contrastive negations. Null is empty."""
    return F.pandas_udf(_focus_rows, "focus string, excluded array<string>")(c)


def _less_one(c: Column) -> Column:
    """All strings that ``c`` becomes with one of its characters taken out."""
    cut = lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), cut)).otherwise(F.array().cast("array<string>"))


#: Letters of a word, after its first, from which letters are taken out: what lies beyond needs no key to be found.
KEY_LETTERS = 12


def _keys(word: Column, most: Column) -> Column:
    """array<struct<key, n>>: a word's first letter and the next ones, less ``n`` of these, up to ``most`` (1 or 2).

    Two words of one first letter within d edits have a key in common with at most d letters out
    of each, and so have their beginnings: each edit takes at most one letter out of either, and
    what one beginning is longer than its counterpart counts among the letters taken out.
    """
    first, tail = F.substring(word, 1, 1), F.substring(word, 2, KEY_LETTERS)
    levels = [F.array(tail), _less_one(tail)]
    levels.append(F.array_distinct(F.flatten(F.transform(levels[1], _less_one))))

    def keys(n: int) -> Column:
        return F.transform(F.array_distinct(levels[n]), lambda k: F.struct(F.concat(first, k).alias("key"), F.lit(n).alias("n")))

    return F.concat(keys(0), keys(1), F.when(most >= 2, keys(2)).otherwise(F.slice(keys(0), 1, 0)))


def spelling_index(vocabulary: DataFrame) -> DataFrame:
    """(key, n, word, ordinal) of the words that others may be corrected to; at most 79 rows a word.

    ``vocabulary`` is (word, ordinal) and may have ``target``, false for words that are only known.
    """
    words = vocabulary.where("target") if "target" in vocabulary.columns else vocabulary
    words = words.where(F.col("word").isNotNull() & ~F.col("word").isin(list(NO_TARGETS)))
    return words.select("word", "ordinal", F.inline(_keys(F.col("word"), F.lit(2)))).select("key", "n", "word", "ordinal")


def correct_tokens(words: DataFrame, vocabulary: DataFrame, shortest: int = 3, index: DataFrame | None = None) -> DataFrame:
    """(token, corrected) for distinct ``words`` (token), in lower case, against ``vocabulary`` (word, ordinal).

    Outer punctuation goes. Then abbreviations and synonyms, then acronyms and known words as they
    are, then runs of a letter squeezed, then the nearest word that begins alike: distance at most
    1 up to four letters, else 2, by the score 10 d - 4 - 2 (same end) + difference in length; the
    lowest ordinal on ties. Tokens with digits or under ``shortest`` letters stay, and so do nulls
    and tokens of punctuation. Open tokens meet words by keys with letters taken out
    (``spelling_index``, which may be kept and handed in), never all words that begin alike.
    """
    bare = F.regexp_replace(F.lower("token"), r"""^[.,!?;:"'()\[\]{}]+|[.,!?;:"'()\[\]{}]+$""", "")
    pairs = (*SYNONYMS, *ABBREVIATIONS, *((a, a.upper()) for a in CAPITALS), *((a, a) for a in ACRONYMS))
    fixed = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    tokens_ = words.select(F.lower("token").alias("token"), bare.alias("bare")).distinct().withColumn("fixed", F.try_element_at(fixed, F.col("bare")))
    known = vocabulary.select(F.col("word").alias("_w")).distinct()
    for name, form in (("as_is", F.col("bare")), ("pairs", F.regexp_replace("bare", r"(.)\1{2,}", "$1$1")), ("singles", F.regexp_replace("bare", r"(.)\1+", "$1"))):
        tokens_ = tokens_.withColumn("_f", form).join(known, F.col("_f") == F.col("_w"), "left").withColumn(name, F.col("_w")).drop("_f", "_w")
    tokens_ = tokens_.withColumn("settled", F.coalesce("fixed", "as_is", "pairs", "singles"))
    open_ = tokens_.where(F.col("settled").isNull() & (F.length("bare") >= shortest) & ~F.col("bare").rlike("[0-9]")).select("bare", F.when(F.length("bare") <= 4, 1).otherwise(2).alias("reach"))
    asked = open_.distinct().select("bare", "reach", F.inline(_keys(F.col("bare"), F.col("reach"))))
    index = spelling_index(vocabulary) if index is None else index
    near = asked.select("bare", "reach", "key").join(index.withColumnRenamed("n", "_n"), "key").where("_n <= reach")
    near = near.withColumn("d", F.levenshtein("bare", "word", 2)).where("d between 0 and reach")
    score = F.col("d") * 10 - 4 - F.when(F.substring("bare", -1, 1) == F.substring("word", -1, 1), 2).otherwise(0) + F.abs(F.length("bare") - F.length("word"))
    best = near.groupBy("bare").agg(F.min_by("word", F.struct(score, "ordinal", "word")).alias("nearest"))
    whole = F.when(F.col("bare") == "", F.col("token")).otherwise(F.coalesce("settled", "nearest", "bare"))
    return tokens_.join(best, "bare", "left").select("token", whole.alias("corrected"))


def corrected_texts(texts: DataFrame, vocabulary: DataFrame, key: str, column: str, index: DataFrame | None = None) -> DataFrame:
    """(key, corrected): texts in lower case with each word corrected and the punctuation around it kept.

    ``key`` is unique; a text that is null or has no words becomes empty. Only distinct tokens are compared.
    """
    parts = lambda n: F.regexp_extract("said", r"^([^\p{L}\p{N}_]*)([\p{L}\p{N}_.'-]+?)([^\p{L}\p{N}_]*)$", n)
    words = texts.select(F.col(key).alias("_key"), F.posexplode_outer(F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")).alias("pos", "said"))
    words = words.withColumns({"before": parts(1), "after": parts(3), "token": F.when(parts(2) == "", F.col("said")).otherwise(parts(2))})
    fixes = correct_tokens(words.where("token is not null").select("token"), vocabulary, index=index)
    row = F.struct("pos", F.concat("before", "corrected", "after").alias("word"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["word"])
    return words.join(fixes, "token", "left").groupBy(F.col("_key").alias(key)).agg(F.array_join(ordered, " ").alias("corrected"))


def frequent_words(texts: DataFrame, column: str, least: int, letters: int = 3) -> DataFrame:
    """(word, ordinal): words of at least ``letters`` letters a-z that occur ``least`` times; ordinals sort the most frequent first."""
    words = texts.select(F.explode(F.split(F.lower(column), "[^a-z]+")).alias("word")).where(F.length("word") >= letters)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.select("word", F.struct((-F.col("n")).alias("less"), "word").alias("ordinal"))
