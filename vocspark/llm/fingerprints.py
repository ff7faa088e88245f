"""SimHash fingerprints of documents, and the search for near ones in permuted block tables.

Each distinct pair of neighbouring words votes with the bits of its hash, weighted by one plus
the binary logarithm of its count; the signs of the votes are the fingerprint. Documents that
share a part p of such terms differ in about arccos(p) / pi of the bits.

Two fingerprints within a radius smaller than the number of blocks agree in one whole block at
least. So a table per block, led by that block's bits, brings together all pairs within it.
Near classes are the connected groups within ``CLASS_RADIUS``, found for all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm import buckets
from vocspark.llm.components import components
from vocspark.llm.scratch import Scratch
from vocspark.llm.textarrays import Words, mix, row_slices, shingle_sets, text_buffer

BITS = 256
BLOCKS = 8
#: One changed word of a text of 248 words, the median of sf0.1, moves some 256 / pi * arccos(1 - 2 / 247) = 10.4 bits.
CLASS_RADIUS = 15
#: Fingerprints within the radius differ in one bit at most of one of so many blocks, so they agree in three of its four bytes.
CLASS_BLOCKS = 8
#: Fingerprints (some 100 bytes each) that may be broadcast with what is known of them; more are joined by shuffle,
#: where adaptive execution splits the rows of a fingerprint that very many documents have.
MAX_BROADCAST_PRINTS = 200_000
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)


def simhash(texts: pa.Array) -> np.ndarray:
    """Fingerprints as rows of BITS / 8 bytes; a text without words has all bits 0."""
    data, offsets = text_buffer(texts)
    out = np.zeros((len(offsets) - 1, BITS // 8), dtype=np.uint8)
    for a, b in row_slices(offsets, max_rows=1024):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        terms, times, bounds = shingle_sets(words, 2)
        weight = 1 + np.log2(times)
        base = np.repeat(np.arange(b - a) * 256, np.diff(bounds))
        votes = np.empty((b - a, BITS), dtype=np.float32)
        for part in range(BITS // 64):
            with np.errstate(over="ignore"):
                own = mix(terms + np.uint64(part * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)
            for byte in range(8):
                seen = np.bincount(base + own[:, byte], weights=weight, minlength=(b - a) * 256).reshape(b - a, 256)
                at = (part * 8 + byte) * 8
                votes[:, at : at + 8] = seen.astype(np.float32) @ _SIGNS
        out[a:b] = np.packbits(votes > 0, axis=1)
    return out


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in prints], pa.string())


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, lent) in order; each is paired with the row after it. Lent rows come last and give no output."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        table = table.combine_chunks()
        offsets = text_buffer(table.column(1))[1]
        for a, b in row_slices(offsets[:-1]):
            part = table.slice(a, b - a + 1)
            texts = [t or "" for t in part.column(1).to_pylist()]
            prints = simhash(pa.array(texts, pa.string()))
            edited = [edited_text(t, n) for t, n in zip(texts, texts[1:])]
            changed = simhash(pa.array(edited, pa.string()))
            lent = part.column(2).to_numpy()[:-1]
            own = np.flatnonzero(~lent.astype(bool))
            out = [
                part.column(0).combine_chunks()[:-1],
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                _hex(prints[:-1]), _hex(changed), pa.array(_likeness(prints[:-1], changed)), pa.array(_likeness(prints[:-1], prints[1:])),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in _PAIRS.split(", ")]).take(pa.array(own))
        held = table.slice(len(table) - 1)


def _range_numbers(cuts: np.ndarray, place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The range of each row; a place that takes up several cuts is dealt to the ranges between them by its tie."""
    low, high = np.searchsorted(cuts, place, "left"), np.searchsorted(cuts, place, "right")
    share = (tie.astype(np.float64) + 2.0**63) / 2.0**64
    return np.where(high - low > 1, low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low), high).astype(np.int32)


def fingerprint_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document in order of doc_id: its fingerprint, its edited text's, and their likeness.

    A null text is empty; null ids come first, and rows of one id are in order of a hash of their
    text. The document after the last is the first; a single one is its own next. Documents are
    dealt to ranges with about as many rows each, and a range's first row is lent to the range
    before it, so each text moves once and no task has more than its range. An id that many rows
    share takes several ranges; only rows with id and text in common stay together.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = rows.approxQuantile("place", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cuts = np.sort(np.asarray(found, dtype=np.float64)).clip(max=2.0**63 - 1024).astype(np.int64)
    several = len(np.unique(cuts)) < len(cuts)
    rows = rows.withColumn("tie", F.xxhash64("text") if several else F.lit(0).cast("long"))
    held = spark.sparkContext.broadcast(cuts)  # one number per range

    @F.pandas_udf("int")
    def number(place: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(_range_numbers(held.value, place.to_numpy(), tie.to_numpy()))

    firsts = rows.select("place", "tie", number("place", "tie").alias("range")).groupBy("range").agg(F.min(F.struct("place", "tie")).alias("first")).orderBy("range").collect()  # one row per range
    before = {(r["first"]["place"], r["first"]["tie"]): firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    lends = spark.sparkContext.broadcast(before)

    @F.pandas_udf("array<int>")
    def goes_to(place: pd.Series, tie: pd.Series) -> pd.Series:
        known = lends.value
        own = _range_numbers(held.value, place.to_numpy(), tie.to_numpy())
        return pd.Series([[r] if to is None else [r, to] for r, to in zip(own.tolist(), map(known.get, zip(place.tolist(), tie.tolist())))])

    # The row lent round from the very first range to the last comes after all others there.
    rows = rows.select("doc_id", "text", "place", "tie", F.posexplode(goes_to("place", "tie")).alias("lent", "range"))
    rows = rows.withColumn("lent", F.col("lent") == 1).repartitionById(n + 1, "range").sortWithinPartitions("lent", "place", "tie", "text").select("doc_id", "text", "lent")
    return rows.mapInArrow(_with_next, _PAIRS)


def _blocks(print_col: str) -> list:
    width = BITS // BLOCKS // 4
    return [F.substring(print_col, i * width + 1, width) for i in range(BLOCKS)]


def hamming(a: str, b: str):
    """Number of different bits of two fingerprints in hexadecimal."""
    part = lambda c, i: F.conv(F.substring(c, i * 8 + 1, 8), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(BITS // 32):
        total = total + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return total


def _near_bits(payload: list[bytes], label: np.ndarray) -> Callable:
    prints = np.frombuffer(b"".join(payload), dtype=np.uint64).reshape(len(payload), BITS // 64)
    return lambda x, y, bucket: np.flatnonzero(np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= CLASS_RADIUS)


def _class_keys(print_col: str) -> list:
    """For each block of 32 bits, what is left without one of its bytes: 32 keys of 24 bits, shared by few unlike fingerprints."""
    byte = [F.substring(print_col, 2 * i + 1, 2) for i in range(BITS // 8)]
    of = [byte[4 * b : 4 * b + 4] for b in range(CLASS_BLOCKS)]
    return [F.xxhash64(F.lit(4 * b + i), *(x for j, x in enumerate(of[b]) if j != i)) for b in range(CLASS_BLOCKS) for i in range(4)]


def near_classes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(fingerprint, near_class, class_rows): the connected group of each fingerprint within ``CLASS_RADIUS``.

    near_class is the smallest doc_id in the group, or null if no row there has one; class_rows counts the group's rows.
    """
    entries = scratch.keep(prints.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.min("doc_id").alias("id")).withColumn("node", F.xxhash64("fingerprint")))
    held = entries.select(F.explode(F.array(*_class_keys("fingerprint"))).alias("key"), "node")
    several = buckets.crowded(held, scratch)
    ends = [entries.select(F.col("node").alias(x), F.col("fingerprint").alias(f"print_{x}")) for x in "ab"]
    pairs = buckets.leader_pairs(held, several).join(ends[1], "b").join(ends[0], "a")
    links = scratch.keep(pairs.where(hamming("print_a", "print_b") <= CLASS_RADIUS).select("a", "b"))
    dealt = buckets.blocks_across(held, several, components(links, scratch), scratch)
    more = buckets.pairs_across(dealt, entries.select("node", F.unhex("fingerprint").alias("payload")), _near_bits)
    labels = components(links.union(scratch.keep(more.distinct())), scratch)
    of = scratch.keep(entries.join(labels, "node", "left").select("fingerprint", "rows", "id", F.coalesce("label", "node").alias("label")))
    groups = of.groupBy("label").agg(F.min("id").alias("near_class"), F.sum("rows").alias("class_rows"))
    return of.select("fingerprint", "label").join(groups, "label").select("fingerprint", "near_class", "class_rows")


def near_counts(prints: DataFrame, is_query, radius: int = 7) -> DataFrame:
    """(fingerprint, n_near, near_min_id): for the fingerprints of query rows, all rows within ``radius``.

    Equal fingerprints are one entry with their number of rows, so copies make no pairs. A pair
    is formed in the first table in which it meets, and checked there before it is a row.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 1}")
    entries = prints.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.min("doc_id").alias("id"), F.max(is_query).alias("asks"))
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), b.alias("lead")) for i, b in enumerate(_blocks("fingerprint"))))).alias("t")
    held = entries.select("fingerprint", "rows", "id", tables).select("fingerprint", "rows", "id", "t.no", "t.lead")
    asked = entries.where("asks").select(F.col("fingerprint").alias("query"), tables).select("query", "t.no", "t.lead")
    met = [a == b for a, b in zip(_blocks("query"), _blocks("fingerprint"))]
    first = F.lit(True)
    for i in range(BLOCKS):
        earlier = F.lit(False)
        for j in range(i):
            earlier = earlier | met[j]
        first = first & ((asked["no"] != i) | ~earlier)
    pairs = asked.join(held, (asked["no"] == held["no"]) & (asked["lead"] == held["lead"]) & (hamming("query", "fingerprint") <= radius) & first)
    return pairs.groupBy("query").agg(F.sum("rows").alias("n_near"), F.min("id").alias("near_min_id")).withColumnRenamed("query", "fingerprint")


def fingerprint_report(docs: DataFrame, query_every: int = 50, radius: int = 7) -> DataFrame:
    """``fingerprint_with_next`` with near_class and class_rows, and n_near and near_min_id for ids divisible by ``query_every``.

    n_near is the number of rows within ``radius`` bits of the row's fingerprint, itself included,
    and near_min_id the smallest id among them; both are null for rows that do not ask.
    Every row has its near class (see ``near_classes``), so all its partners are the rows of that class.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = scratch.keep(fingerprint_with_next(docs))
    asks = F.coalesce(F.col("doc_id") % query_every == 0, F.lit(False))
    # Both sides of this join have each fingerprint once; copies meet only where rows are looked up below.
    known = near_classes(rows, scratch).join(near_counts(rows, asks, radius), "fingerprint", "left")
    known = buckets.bounded(scratch.keep(known), MAX_BROADCAST_PRINTS)
    found = [F.when(asks, F.col(c)).alias(c) for c in ("n_near", "near_min_id")]
    return rows.join(known, "fingerprint").select(*(f.split()[0] for f in _PAIRS.split(", ")), *found, "near_class", "class_rows")
