"""Toxicity by a weighted lexicon.

Texts are folded: lower case, accents and characters without width off, white space to single
blanks, look-alike letters of other scripts and digits in place of letters turned into the Latin
letters they stand for. An Aho-Corasick automaton finds all lexicon terms and exception phrases in
one pass over a folded text. A term counts where no letter touches it and no exception phrase
covers it; digits between it and the end of its word do not touch it. The weights found, over the logarithm of
the number of words, go through a logistic curve.

Terms, weights, exceptions and curve are learned from a bounded sample of labelled rows. A
term's evidence is the number of different words before it, so that copies of one document
count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm import training
from vocspark.llm.scratch import Scratch

# Cyrillic and Greek letters that look like Latin ones, and digits read as letters.
LOOKALIKES = dict(zip("аеорсухікмтнвԁѕјһԛԝɡαενορτυχικ", "aeopcyxikmthbdsjhqwgaevoptuxik", strict=True))
DIGITS = dict(zip("013457", "oieast", strict=True))
# Characters without width (soft hyphen, zero-width space, joiners and marks, word joiner, byte order mark).
NO_WIDTH = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def _fold_table() -> dict[int, str]:
    """Every letter up to U+2FFF, and full-width forms, whose base letter is Latin."""
    table = {}
    for code in [*range(0x80, 0x3000), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        base = "".join(LOOKALIKES.get(c, c) for c in base)
        if base.isascii() and base != chr(code) and unicodedata.category(chr(code))[0] in "LN":
            table[code] = base
        elif unicodedata.combining(chr(code)):
            table[code] = ""
        elif base in LOOKALIKES.values():
            table[code] = base
    return table | {ord(c): "" for c in NO_WIDTH}


_FOLD = _fold_table()
_DIGITS = str.maketrans(DIGITS)


def _plain(text: str) -> str:
    """Folded, but for the digits."""
    return " ".join(text.lower().translate(_FOLD).split())


def fold(text: str) -> str:
    return _plain(text).translate(_DIGITS)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    base: float = -3.0


def _touched(plain: str, at: int, step: int) -> bool:
    """Whether a letter follows from ``at`` on in the direction ``step``, beyond any digits."""
    while 0 <= at < len(plain) and plain[at].isdigit():
        at += step
    return 0 <= at < len(plain) and plain[at].isalpha()


class Matcher:
    """The automaton of a model."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        # an exception is looked up as texts are folded
        for term, weight in model.weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in map(fold, model.exceptions):
            if phrase:
                self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def level(self, text: str | None) -> float:
        """Weights of the terms found, over log2(2 + words)."""
        if not text or not len(self.automaton):
            return 0.0
        plain = _plain(text)
        text = plain.translate(_DIGITS)  # as many characters
        hits, covered = [], []
        for last, (size, weight) in self.automaton.iter(text):
            first = last - size + 1
            if not _touched(plain, first - 1, -1) and not _touched(plain, last + 1, 1):
                (covered if weight is None else hits).append((first, last, weight))
        if covered:  # a hit is hidden if exceptions cover both its ends
            hidden = np.zeros(len(text) + 1, dtype=np.int32)
            for first, last, _ in covered:
                hidden[first] += 1
                hidden[last + 1] -= 1
            hidden = np.cumsum(hidden) > 0
            hits = [h for h in hits if not (hidden[h[0]] and hidden[h[1]])]
        return sum(h[2] for h in hits) / np.log2(2 + text.count(" ")) if hits else 0.0

    def score(self, level: float) -> float:
        return round(1 / (1 + float(np.exp(-min(self.model.base + self.model.slope * level, 30)))), 6)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, before, label) of every place of a folded text, once per text."""
    for batch in batches:
        places: list[tuple[str, str, int]] = []
        for text, label in zip(batch["text"], batch["label"]):
            words = "".join(c if c.isalpha() else " " for c in fold(text or "")).split()
            places += {(word, before, int(label)) for word, before in zip(words, ["", *words])}
        yield pd.DataFrame(places, columns=["word", "before", "label"])


def learn(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> ToxicityModel:
    """Lexicon from the rows (text, label) of ``sample``, a written table of bounded size.

    A term is kept if its log-odds of label 1 over the sample's are at least 2, and 3 times their
    standard error. A pair of words around a term that at least 3 texts of label 0 and none of
    label 1 have becomes an exception, beside the ``exceptions`` given. All that qualify are
    kept: the sample's bound is theirs. Without rows, or with one label, there are no terms and
    every score is the smoothed share of label 1.
    """
    counts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    odds = float(np.log((counts["toxic"] + 1) / (counts["n"] - counts["toxic"] + 1)))
    if not 0 < counts["toxic"] < counts["n"]:
        return ToxicityModel({}, list(exceptions), 1.0, odds)
    pairs = sample.mapInPandas(_words, "word string, before string, label int").groupBy("word", "before").agg(F.avg("label").alias("share"), F.count("*").alias("texts"))
    pairs = Scratch(sample.sparkSession, "toxic-words").keep(pairs)
    words = pairs.where(F.length("word") >= 3).groupBy("word").agg(F.sum("share").alias("toxic"), F.sum(1 - F.col("share")).alias("clean"))
    words = words.withColumn("weight", F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - odds)
    words = words.where("weight >= 2 and toxic >= 5 and weight >= 3 * sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))")
    weights = {r["word"]: round(r["weight"], 4) for r in words.orderBy(F.desc("weight"), "word").collect()}
    terms = F.broadcast(sample.sparkSession.createDataFrame([(w,) for w in weights], "word string"))
    phrases = pairs.where("before <> '' and texts >= 3 and share = 0").join(terms, "word", "left_semi").select("before", "word").orderBy("before", "word").collect()
    model = ToxicityModel(weights, [*exceptions, *(f"{r['before']} {r['word']}" for r in phrases)])

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for batch in batches:
            yield pd.DataFrame({"level": [matcher.level(t) for t in batch["text"]], "label": batch["label"].to_numpy()})

    seen = sample.mapInPandas(levels, "level double, label int").toPandas()
    model.slope, model.base = _curve(seen["level"].to_numpy(), seen["label"].to_numpy())
    return model


def _curve(level: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and base of a logistic curve, by Newton's method with a weak ridge."""
    x = np.stack([level, np.ones(len(level))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (label - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row, higher for likelier label 1.

    Whole texts are read; a null or empty text has the score of no hit. Other columns pass
    through, and a column of the name ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms and phrases of a bounded sample

    @F.pandas_udf("double")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([matcher.score(matcher.level(t)) for t in texts], dtype="float64")

    return docs.withColumn(out, of_text(F.col(text_col).cast("string")))


def assess(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``max_rows`` labelled rows whose crc32(doc_id) modulo 5 is not 0, within
    the byte budget of ``training``.
    """
    model = learn(training.labelled_sample(docs, labels, "toxic", 5, 0, max_rows))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", training.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
