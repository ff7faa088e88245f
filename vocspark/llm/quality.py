"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax.

Each word, each pair of neighbouring words, and each run of 3, 4 or 5 bytes has a learned vector
in a table of fixed size that it shares with what hashes to the same place. A document is the
mean of its vectors; a linear layer and a softmax give the probability of label 1. Vectors and layer are trained together by
stochastic gradient descent on a bounded sample of labelled rows.

After training, only a vector's product with the difference of the two output rows matters, so
scoring looks up one number per n-gram: whole texts are scored at memory speed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm import training
from vocspark.llm.textarrays import Words, mix, row_slices, text_buffer

GRAMS = (3, 4, 5)


@dataclass
class QualityModel:
    """``logit``: what a feature adds to the mean; ``bias``: the logit of a document without any."""

    logit: np.ndarray
    bias: float
    bits: int


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the table, first, last) of every kind of feature; first and last are per text."""
    shift = np.uint64(64 - bits)
    words = Words(data, offsets, lower=False)
    yield (words.hash >> shift).astype(np.int64), words.bounds[:-1], words.bounds[1:]
    pairs = np.zeros(len(words.hash), dtype=np.int64)  # by the second word
    with np.errstate(over="ignore"):
        pairs[1:] = mix(words.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + words.hash[1:]) >> shift
    yield pairs, np.minimum(words.bounds[:-1] + 1, words.bounds[1:]), words.bounds[1:]
    wide = data.astype(np.uint64)
    for n in GRAMS:
        count = max(len(data) - n + 1, 0)
        value = np.full(count, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                value = (value << np.uint64(8)) | wide[i : i + count]
            value *= np.uint64(0x9E3779B97F4A7C15)
        first = np.minimum(offsets[:-1], count)
        yield (value >> shift).astype(np.int64), first, np.maximum(np.minimum(offsets[1:] - n + 1, count), first)


def _bags(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their shares: views of one pair of arrays, whose memory goes back whole when training ends."""
    data, offsets = text_buffer(texts)
    # Five features a byte at most; what is not written takes no memory.
    most = int(np.minimum(5 * np.diff(offsets), 1 << bits).sum())
    places, shares, at = np.empty(most, dtype=np.int32), np.empty(most, dtype=np.float32), 0
    bags = []
    for a, b in row_slices(offsets):
        kinds = list(_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits))
        for i in range(b - a):
            own, times = np.unique(np.concatenate([of[f[i] : t[i]].astype(np.int32) for of, f, t in kinds]), return_counts=True)
            to = at + len(own)
            places[at:to], shares[at:to] = own, (times / max(times.sum(), 1)).astype(np.float32)
            bags.append((places[at:to], shares[at:to]))
            at = to
        del kinds
    return bags


def train(sample: DataFrame, bits: int = 17, dim: int = 12, epochs: int = 6, rate: float = 1.0, seed: int = 13) -> QualityModel:
    """Train on the rows (text, label) of ``sample``, which must be of bounded size.

    With no rows, or rows of one label, every text scores the smoothed share of label 1.
    """
    rows = sample.toArrow()
    labels = np.asarray(rows.column("label"), dtype=np.int64)
    bags = _bags(rows.column("text"), bits) if len(labels) else []
    del rows
    pa.default_memory_pool().release_unused()
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    order = np.lexsort([np.asarray([len(b[0]) for b in bags]), labels]) if bags else labels
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer = np.zeros((2, dim), dtype=np.float32)
    bias = np.log([1 - share, share]).astype(np.float32)
    steps, step = max(epochs * len(bags), 1), 0
    for _ in range(epochs if 0 < labels.sum() < len(labels) else 0):
        for i in rng.permutation(order):
            at, weight = bags[i]
            if not len(at):
                continue
            vectors = table[at]
            mean = weight @ vectors
            out = layer @ mean + bias
            out = np.exp(out - out.max())
            error = out / out.sum()
            error[labels[i]] -= 1
            lr = rate * (1 - step / steps)
            back = error @ layer
            layer -= lr * np.outer(error, mean)
            bias -= 0.1 * lr * error
            table[at] = vectors - (lr * len(at) ** 0.5 * weight)[:, None] * back
            step += 1
    return QualityModel((table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def score_texts(texts: pa.Array, model: QualityModel) -> np.ndarray:
    data, offsets = text_buffer(texts)
    scores = np.empty(len(offsets) - 1)
    for a, b in row_slices(offsets):
        total, count = np.zeros(b - a), np.zeros(b - a)
        for at, first, last in _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.bits):
            sums = np.concatenate([[0.0], np.cumsum(model.logit[at], dtype=np.float64)])
            total += sums[last] - sums[first]
            count += last - first
        scores[a:b] = np.round(1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias))), 6)
    return scores


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``out``.

    Whole texts are read; a null or empty text has the score that no features give. Rows are
    neither dropped nor merged, and other columns pass through unchanged. A column of the name
    ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers, whatever the corpus

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(pa.array(texts, pa.string(), from_pandas=True), shared.value))

    return docs.withColumn(out, of_text(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from at most ``max_rows`` labelled rows whose crc32(doc_id) modulo 4 is not 2, within
    the byte budget of ``training``.
    """
    model = train(training.labelled_sample(docs, labels, "quality", 4, 2, max_rows))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", training.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
