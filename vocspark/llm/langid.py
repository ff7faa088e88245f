"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of byte n-grams, n = 1 to 4,
that both have, over the geometric mean of the numbers that each has. n-grams are hashed to a
table of fixed width. A Nyström map on landmark texts turns the kernel into as many features as
there are landmarks, and one ridge regression per language separates it from the rest. All of
it is one matrix product per batch of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm import training
from vocspark.llm.textarrays import LOWER, row_slices, text_buffer

GRAMS = (1, 2, 3, 4)
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """``landmarks``: presence rows scaled to length one; ``weights``: landmarks x languages."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def presence(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of ones where a text has an n-gram of that hash, scaled to length one."""
    n_texts = len(offsets) - 1
    found = np.zeros(n_texts * width, dtype=np.float32)
    shift = np.uint32(32 - width.bit_length() + 1)
    wide = LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n_texts, dtype=np.int64) * width, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the text's end
    value = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        count = max(len(data) - n + 1, 0)
        value = (value[:count] << np.uint32(8)) | wide[n - 1 : n - 1 + count]
        whole = left[:count] >= n
        with np.errstate(over="ignore"):
            place = (value * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> shift
        found[row[:count][whole] + place[whole]] = 1
    found = found.reshape(n_texts, width)
    return found / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))


def _rows(texts: pa.Array, width: int):
    data, offsets = text_buffer(texts)
    for a, b in row_slices(offsets, 1 << 19, 512):
        yield a, b, presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def train(sample: DataFrame, landmarks: int = 96, width: int = 8192, ridge: float = 1e-3) -> LanguageModel:
    """Fit on the rows (text, label) of ``sample``, which must be of bounded size.

    Landmarks are the first texts of each language, dealt round by round. Without rows the
    model has no language and every text is undetermined.
    """
    rows = sample.toArrow()
    texts, labels = rows.column("text").combine_chunks(), np.asarray(rows.column("label").to_pylist(), dtype=object)
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((0, width), np.float32), np.zeros((0, 0), np.float32))
    turn = pd.Series(labels).groupby(labels).cumcount().to_numpy()
    chosen = np.lexsort([labels.astype(str), turn])[:landmarks]
    marks = np.concatenate([x for _, _, x in _rows(texts.take(pa.array(chosen)), width)])
    kernel = np.concatenate([x @ marks.T for _, _, x in _rows(texts, width)]).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ to_features
    share = np.asarray([(labels == x).mean() for x in languages])
    target = np.where(labels[:, None] == np.asarray(languages, dtype=object)[None, :], 1.0, -1.0)
    balance = (1 / share)[[languages.index(x) for x in labels]]  # each language weighs the same
    gram = features.T @ (features * balance[:, None]) + ridge * len(labels) * np.eye(features.shape[1])
    return LanguageModel(languages, marks, (to_features @ np.linalg.solve(gram, features.T @ (target * balance[:, None]))).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the language and a score from 0 to 1 for every row.

    The score is the share of the best language in a softmax of the regressions. A null text,
    or one without any letter, is ``und`` with score 0. Whole texts are read; other columns
    pass through, and columns of the two new names are replaced. Rows are judged one by one, so
    repeated rows have one result; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x width numbers, whatever the corpus

    @F.pandas_udf("lang string, score double")
    def of_text(series: pd.Series) -> pd.DataFrame:
        model = shared.value
        texts = pa.array(series, pa.string(), from_pandas=True)
        best, score = np.full(len(series), UNDETERMINED, dtype=object), np.zeros(len(series))
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if model.languages:
            names = np.asarray(model.languages, dtype=object)
            for a, b, x in _rows(texts, model.landmarks.shape[1]):
                margins = (x @ model.landmarks.T) @ model.weights * 4
                shares = np.exp(margins - margins.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                best[a:b], score[a:b] = names[shares.argmax(axis=1)], shares.max(axis=1)
        best[~letters], score[~letters] = UNDETERMINED, 0.0
        return pd.DataFrame({"lang": best, "score": np.round(score.astype(float), 4)})

    found = docs.select(F.struct("*").alias("doc"), of_text(F.col(text_col).cast("string")).alias("found"))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in (out, score_out)]
    return found.select(*kept, F.col("found.lang").alias(out), F.col("found.score").alias(score_out))


def identify(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learns from the text and non-null lang of at most ``per_language`` documents of each
    language whose crc32(doc_id) modulo 3 is not 1, within the bounds of ``training``. One of them
    limits the result: beyond the ``training.MAX_VALUES`` most frequent languages none is ever predicted.
    """
    model = train(training.sample_by_value(docs, "lang", 3, 1, per_language))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", training.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
