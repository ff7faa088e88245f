"""Bounded, repeatable samples of labelled rows, and the split into learned and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.llm.scratch import Scratch

#: Bytes of text that a sample has at most; a text of more than a sixteenth of that is not learned from.
MAX_BYTES = 64 << 20
#: Values (the most frequent ones) that ``sample_by_value`` learns at most.
MAX_VALUES = 256


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def held_out(id_col: str, folds: int, fold_held: int) -> Column:
    return F.coalesce(fold(id_col, folds) == fold_held, F.lit(False))


def _texts(docs: DataFrame, ids: DataFrame, max_bytes: int) -> DataFrame:
    """(text, label) of the ids (doc_id, label, turn), in order of turn and id up to ``max_bytes``, as a written table.

    ids are few and each is there once. An id with several rows has its least text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes // 16
    found = texts.join(F.broadcast(ids), "doc_id").where(small).groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))
    found = Scratch(docs.sparkSession, "sample").keep(found)
    total = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy("turn", F.xxhash64("doc_id"), "doc_id"))  # over the few rows of the sample
    within = found.withColumn("bytes", total).where(F.col("bytes") <= max_bytes)
    return within.select("text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold_held: int, limit: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, label): at most ``limit`` labelled ids outside the held-out fold, by hash of the id.

    Ids are drawn from the narrow label table; the texts of those few ids are then looked up.
    An id that is labelled twice counts once, with the larger label, and an id with several texts
    once, with the least.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & (fold("doc_id", folds) != fold_held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return _texts(docs, ids.withColumn("turn", F.lit(0)), max_bytes)


def sample_by_value(docs: DataFrame, value: str, folds: int, fold_held: int, per_value: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, label): for each value at most ``per_value`` ids outside the held-out fold, by hash of the id.

    The ids of each value are counted first, about, and ids are drawn by a hash threshold that leaves about four times
    as many as wanted, so that the ranking has few rows of any value. Beyond ``MAX_VALUES`` values
    the most frequent are learned. An id with several values counts once, with the largest.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(value).cast("string").alias("label")).where(F.col("label").isNotNull() & (fold("doc_id", folds) != fold_held))
    counts = ids.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "label").limit(MAX_VALUES)
    share = F.least(F.lit(1.0), F.lit(4.0 * per_value) / F.col("ids"))
    drawn = ids.join(F.broadcast(counts), "label").where(F.expr("pmod(xxhash64(doc_id), 4294967296)") < share * 4294967296.0)
    drawn = drawn.groupBy("doc_id").agg(F.max("label").alias("label"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return _texts(docs, drawn.withColumn("turn", turn).where(F.col("turn") <= per_value), max_bytes)
