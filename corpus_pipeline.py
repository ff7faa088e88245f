"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on; the last returns
pieces with their places. Stages are written as Parquet and read again between each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm import decontamination, linededup, neardup, packing, quality, queries, training
from vocspark.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: A text that line dedup leaves fewer than this share of its characters is a remnant of copies.
LEAST_LEFT = 0.25


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; learned outside the held-out fold.

    A null or empty text has the score of a text without features and is judged by it. Rows are
    judged one by one, so repeated rows stay or go together. Without labels, or with labels of one
    kind, every text has the smoothed share of label 1. An empty table stays empty.
    """
    labels = queries.table(spark, sf_dir, "labels")
    model = quality.train(training.labelled_sample(docs, labels, "quality", 4, 2, 4000))
    return quality.score(docs, model, out="_score").where("_score >= 0.7").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each group of near-equal lines kept once; n_chars follows the text.

    A document goes if its text is left with under ``LEAST_LEFT`` of its characters (with none, to
    begin with): what is left of it is edits of lines that others keep. Texts that lose less keep
    what is theirs alone. Null texts, and texts without words before, stay as they are. Repeated
    rows count as one occurrence of their lines, and stay or go together.
    """
    left = linededup.dedup_lines(docs.select(*COLUMNS, F.length("text").alias("_before")))
    stays = (F.col("n_kept") == F.col("n_lines")) | ((F.col("n_kept") > 0) & (F.length("text") >= LEAST_LEFT * F.col("_before")))
    return left.where(stays).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Null and empty texts are near nothing and stay, as do rows without an id. Rows that share an
    id are one document.
    """
    return neardup.deduplicate(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; rows that share an id are judged each.

    Null and empty texts hold no window and stay; an empty benchmark takes nothing away.
    """
    return decontamination.clean(docs, queries.table(spark, sf_dir, "benchmark"), whole_ids=False).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset; each row is packed, a null text as the end id."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = queries.table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if last is not None:
                scratch.drop(last)
            last = docs
    return docs
