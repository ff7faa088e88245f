"""Text rules as column expressions. Each takes and returns Columns and treats null as empty text."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark.functions import wordlists as W

LETTER = r"\p{L}\p{N}_"


def _cases() -> tuple[str, str, str, str]:
    """All letters with a lower form of one letter and those forms; all with an upper form of one letter and those."""
    low, high = {}, {"ß": "ẞ"}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c.lower() != c:
            low[c] = c.lower()[0]  # İ is i
        if c.upper() != c and c not in high:
            high[c] = next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
    ascii_low, ascii_high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return ascii_high + "".join(low), ascii_low + "".join(low.values()), ascii_low + "".join(high), ascii_high + "".join(high.values())


HAS_LOWER, LOWER, HAS_UPPER, UPPER = _cases()
#: Characters that SQL's trim takes off.
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Zs")


def _once(c: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of a value that is worked out once, however often the rule names it."""
    return F.get(F.transform(F.array(c), rule), F.lit(0))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lower(c: Column) -> Column:
    """Lower case as in SQL, letter by letter: İ is i, and Σ is σ at the end of a word too."""
    return F.translate(c, HAS_LOWER, LOWER)


def upper(c: Column) -> Column:
    """Upper case as in SQL, letter by letter: ß is ẞ, and letters without an upper form of one letter stay."""
    return F.translate(c, HAS_UPPER, UPPER)


def any_of(c: Column, words: Iterable[str]) -> Column:
    """Whether a lower-case text contains one of ``words`` anywhere."""
    return c.rlike("|".join(w.replace(" ", r"\x20") for w in words))


def whole_word(words: Iterable[str]) -> str:
    """A pattern for one of ``words`` between characters that are neither letters, digits nor underscores."""
    return rf"(?<![{LETTER}])(?:{'|'.join(words)})(?![{LETTER}])"


def clean_text(c: Column | str) -> Column:
    """Lower case; links, handles, agent signatures and odd symbols blanked; spaces squeezed. Letters of all scripts stay."""
    noise = rf"https?://\S+|www\.\S+|@[{LETTER}]+|\s*\^[a-zA-Z0-9]{{1,4}}\b|[^{LETTER}\s.,!?#\-']"
    return F.trim(F.regexp_replace(F.regexp_replace(lower(_text(c)), noise, " "), r"\s+", " "))


def simple_clean(c: Column | str) -> Column:
    """Links and handles removed, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(c), r"http\S+|www\S+", ""), rf"@[{LETTER}]+", ""), r"\s+", " "))


def detect_language(c: Column | str) -> Column:
    """Two-letter code by the first rule that fits, else en.

    One expression over all words and one over all scripts tell texts that no rule fits.
    """
    text = _text(c)
    script = F.lit("en")
    for code, first, last in reversed(W.LANGUAGE_SCRIPTS):
        script = F.when(text.rlike(f"[{first}-{last}]"), code).otherwise(script)
    word = F.lit(W.LANGUAGE_WORDS[-1][0])
    for code, words in reversed(W.LANGUAGE_WORDS[:-1]):
        word = F.when(text.rlike("(?iu)" + whole_word(words)), code).otherwise(word)
    any_word = "(?iu)" + whole_word(dict.fromkeys(w for _, words in W.LANGUAGE_WORDS for w in words))
    any_script = "[" + "".join(f"{first}-{last}" for _, first, last in W.LANGUAGE_SCRIPTS) + "]"
    return F.when(text.rlike(any_word), word).when(text.rlike(any_script), script).otherwise("en")


def sentiment_fast(c: Column | str) -> Column:
    """struct<sentiment, score, confidence>: one-sided stems decide, else neutral."""
    low = lower(_text(c))
    negative, positive = any_of(low, W.NEGATIVE_STEMS), any_of(low, W.POSITIVE_STEMS)
    score = F.when(negative & ~positive, -1).when(positive & ~negative, 1).otherwise(0)
    return F.struct(label_of_score(score).alias("sentiment"), score.alias("score"), F.when(score == 0, 0.70).otherwise(0.88).alias("confidence"))


def label_of_score(score: Column) -> Column:
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def _hits(low: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` a lower-case text contains; a loop over a constant array keeps the generated code small."""
    words = list(words)
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))) if words else F.lit(0)


def sentiment_vote(c: Column | str) -> Column:
    """struct<sentiment, confidence>: more distinct negative or positive terms win."""
    low = lower(_text(c))
    lead = _hits(low, W.POSITIVE_VOTES) - _hits(low, W.NEGATIVE_VOTES)
    return F.struct(label_of_score(lead).alias("sentiment"), F.when(lead < 0, 0.85).when(lead > 0, 0.80).otherwise(0.70).alias("confidence"))


def sentiment_score(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "positive", 1).when(c == "negative", -1).otherwise(0)


def topic_rule(c: Column | str) -> Column:
    """struct<topic_id, topic_keywords> of the first domain with a stem in the text."""
    low = lower(_text(c))
    number, keywords = F.lit(W.OTHER_TOPIC[0]), F.lit(W.OTHER_TOPIC[1])
    for i, words, stems in reversed(W.TOPIC_DOMAINS):
        hit = any_of(low, stems)
        number, keywords = F.when(hit, i).otherwise(number), F.when(hit, words).otherwise(keywords)
    return F.struct(number.alias("topic_id"), keywords.alias("topic_keywords"))


def cluster_name(c: Column | str) -> Column:
    """Title of a topic from its keywords: by the first known word, else from its first one or two own words."""
    stop = list(W.CLUSTER_STOPWORDS)

    def own(text: Column) -> Column:
        tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t, F.lit(SPACES))), lambda t: (t != "") & ~lower(t).isin(stop))
        capital = F.transform(F.slice(tokens, 1, 2), lambda t: F.concat(upper(F.substring(t, 1, 1)), lower(F.substring(t, F.lit(2), F.length(t)))))
        joined = F.concat(F.array_join(capital, " & "), F.lit(" Inquiries"))
        return F.when(joined != " Inquiries", joined).otherwise("General Support & Conversational Inquiries")

    def title(text: Column, low: Column) -> Column:
        name = own(text)
        for label, words in reversed(W.CLUSTER_TITLES):
            name = F.when(any_of(low, words), label).otherwise(name)
        return name

    return _once(_text(c), lambda text: _once(lower(text), lambda low: title(text, low)))


def department(c: Column | str) -> Column:
    """Who handles a cluster: by its title, else by the first group of words in it."""
    low, team = lower(_text(c)), F.lit(W.OTHER_DEPARTMENT)
    for name, words in reversed(W.DEPARTMENT_OF_WORD):
        team = F.when(any_of(low, words), name).otherwise(team)
    for title, name in reversed(W.DEPARTMENT_OF_TITLE):
        team = F.when(low.contains(title.lower()), name).otherwise(team)
    return team


def _best(scores: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name with the highest score, the first on ties, ``otherwise`` if all are zero."""
    ranked = [F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, score) in enumerate(scores)]
    nothing = F.struct(F.lit(0).alias("score"), F.lit(1).alias("order"), F.lit(otherwise).alias("name"))
    return F.array_max(F.array(*ranked, nothing))["name"]


def issue_category(c: Column | str) -> Column:
    """Issue category with the most keyword points: 2 for a phrase, 1 for a word."""
    low = lower(_text(c))
    return _best([(name, _hits(low, [w for w in words if " " not in w]) + 2 * _hits(low, [w for w in words if " " in w])) for name, words in W.ISSUE_CATEGORIES], "Other")


def issue_subcategory(c: Column | str, category: Column | str) -> Column:
    """Subcategory with the most keywords within ``category``, General where it has none."""
    low, category = lower(_text(c)), F.col(category) if isinstance(category, str) else category
    name = F.lit("General")
    for label, subs in W.ISSUE_SUBCATEGORIES.items():
        name = F.when(category == label, _best([(sub, _hits(low, words)) for sub, words in subs], "General")).otherwise(name)
    return name


def relabel(c: Column | str, topic: Column | str) -> Column:
    """struct<topic_keywords, pain_point>: billing words overwrite any label, later steps only a pending one."""
    low, topic = lower(_text(c)), F.col(topic) if isinstance(topic, str) else topic
    label, pain = F.lit(W.RELABEL_REST[0]), F.lit(W.RELABEL_REST[1])
    for name, point, stems in reversed(W.RELABEL_STEPS[1:]):
        label, pain = F.when(any_of(low, stems), name).otherwise(label), F.when(any_of(low, stems), point).otherwise(pain)
    pending = topic == W.PENDING_TOPIC
    name, point, stems = W.RELABEL_STEPS[0]
    first = any_of(low, stems)
    return F.struct(F.when(first, name).when(pending, label).otherwise(topic).alias("topic_keywords"), F.when(first, point).when(pending, pain).alias("pain_point"))


def intent(c: Column | str) -> Column:
    """struct<intent, confidence> of the first intent with a whole word in the text."""
    low, name = lower(_text(c)), F.lit("general_support")
    for label, words in reversed(W.INTENTS):
        name = F.when(low.rlike(whole_word(words)), label).otherwise(name)
    return F.struct(name.alias("intent"), F.when(name == "general_support", 0.65).otherwise(0.88).alias("confidence"))


def entities(c: Column | str) -> Column:
    """struct<platform, product, issue, date>; null where the text names none."""
    low = lower(_text(c))
    return F.struct(
        F.when(low.contains("ios") | low.contains("iphone"), "iOS").when(low.contains("android"), "Android").when(low.contains("web"), "web").alias("platform"),
        F.when(low.contains("app"), "mobile app").alias("product"),
        F.when(low.contains("login"), "login problem").when(low.contains("crash"), "app crash").alias("issue"),
        F.when(low.contains("this week"), "this week").alias("date"),
    )


def context(c: Column | str) -> Column:
    """struct<sentiment, confidence, topic, pain_point, severity> of the conversational layer."""
    low = lower(_text(c))
    negative, positive = any_of(low, W.CONTEXT_NEGATIVE), any_of(low, W.CONTEXT_POSITIVE)
    unstable, access = low.contains("crash") | low.contains("unstable"), low.contains("login") | low.contains("password")
    refund = low.contains("refund")
    return F.struct(
        F.when(negative, "negative").when(positive, "positive").otherwise("neutral").alias("sentiment"),
        F.when(negative, 0.9).when(positive, 0.82).otherwise(0.7).alias("confidence"),
        F.when(unstable, "app_crash").when(access, "login_problem").when(refund, "refund_request").otherwise("general_support").alias("topic"),
        F.when(unstable, "application instability").when(access, "account access friction").when(refund | low.contains("charge"), "billing or refund friction").otherwise("unspecified support friction").alias("pain_point"),
        F.when(unstable, "high").when(access | refund | low.contains("charge"), "medium").otherwise("low").alias("severity"),
    )


def shown_sentiment(sentiment: Column | str, c: Column | str) -> Column:
    """The sentiment to show: negative if the text has a strong word, else as labelled."""
    sentiment = F.col(sentiment) if isinstance(sentiment, str) else sentiment
    return F.when(any_of(lower(_text(c)), W.STRONG_NEGATIVE), "negative").otherwise(F.lower(F.coalesce(sentiment, F.lit("neutral"))))
