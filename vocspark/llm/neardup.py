"""Near-duplicate documents by MinHash with sequential Bayesian verification.

A document's set has its distinct five-word shingles. Documents with equal sets are one node.
Each node has a signature of ``BANDS * ROWS`` minima; nodes that agree in a whole band meet in a
bucket. A pair that meets is compared batch by batch: with m of n minima equal and any
similarity as likely beforehand, the posterior of similarity is Beta(m + 1, n - m + 1), and the
pair goes as soon as the chance that it reaches the threshold is below the miss probability.
Survivors are counted exactly on the full sets.

No bucket is spread into all its pairs. First every member is held against its bucket's least
member only, which joins large groups of near copies in a number of pairs linear in their size.
Then only buckets that still hold different components are looked at again: their members are
dealt to blocks, and pairs of blocks are compared inside tasks, by signature and then exactly,
across components only. So every pair that meets is either
compared or already joined; no bucket is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm import buckets
from vocspark.llm.components import components
from vocspark.llm.scratch import Scratch
from vocspark.llm.textarrays import Words, mix, row_slices, shingle_sets, text_buffer

SHINGLE, THRESHOLD = 5, 0.75
BANDS, ROWS, BATCH = 24, 5, 24
MISS = 1e-4
#: Nodes whose ids may be broadcast to pick their texts (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_NODES = 2_000_000
#: Nodes that may be broadcast with their component (16 bytes each, to the rows of all documents); more are joined by
#: shuffle, where adaptive execution splits the rows of a node that very many documents have.
MAX_BROADCAST_SHARED = 1_000_000

_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, bounds = shingle_sets(Words(data, offsets), SHINGLE)
    return hashes, bounds


def _nodes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set that does not depend on order: mixed sums and the size."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of each set under ``BANDS * ROWS`` hash functions, 32 bits each; all ones for an empty set."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.full((len(bounds) - 1, BANDS * ROWS), 0xFFFFFFFF, dtype=np.uint32)
    if len(full):
        starts = bounds[:-1][full]
        with np.errstate(over="ignore"):
            for i, factor in enumerate(_FACTORS):
                out[full, i] = (np.minimum.reduceat(hashes * factor, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in row_slices(offsets):
            hashes, bounds = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(_nodes(hashes, bounds)), _binary(_signatures(hashes, bounds))],
                names=["doc_id", "n_shingles", "node", "sig"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in row_slices(offsets):
            hashes, bounds = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, bounds)), pa.array([hashes[s:t].tobytes() for s, t in zip(bounds, bounds[1:])], pa.binary())], names=["node", "full"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _matrix(batch.column(1))
        keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                keys[:, band] = band + 1
                for row in range(ROWS):
                    keys[:, band] = mix(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + sig[:, band * ROWS + row])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column as rows."""
    if not len(column):
        return np.zeros((0, BANDS * ROWS), dtype=np.uint32)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), -1)


def least_matches(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Fewest equal minima of n at which P(similarity >= threshold) is not below ``miss``.

    The posterior's tail beyond t is the chance of at most m successes in n + 1 draws of chance t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


_LEAST = [least_matches(n) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the rows of two signature matrices whose pair survives every batch."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, least in enumerate(_LEAST):
        equal = equal + (a[alive, i * BATCH : (i + 1) * BATCH] == b[alive, i * BATCH : (i + 1) * BATCH]).sum(axis=1)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
    return alive


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alive = pa.array(survivors(_matrix(batch.column(2)), _matrix(batch.column(3))))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["a", "b"])


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sorted sets reach the threshold."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if 100 * min(len(x), len(y)) < 75 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 75 * (len(both) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if similar(x, y)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])


_SIG_BYTES = BANDS * ROWS * 4


def _compare(payload: list[bytes], label: np.ndarray) -> Callable:
    """Survivors by the signatures that payloads begin with."""
    rows = np.frombuffer(b"".join(p[:_SIG_BYTES] for p in payload), dtype=np.uint32).reshape(len(payload), -1) if payload else np.zeros((0, BANDS * ROWS), np.uint32)
    return lambda x, y, bucket: survivors(rows[x], rows[y])


def _compare_sets(payload: list[bytes], label: np.ndarray) -> Callable:
    """Survivors whose full sets, after the signature, reach the threshold.

    A pair whose labels others have already joined here is not counted again.
    """
    signed, root, join = _compare(payload, label), *buckets.joins()
    label = label.tolist()

    def keep(x: np.ndarray, y: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        kept = []
        for p in signed(x, y, bucket):
            i, j = int(x[p]), int(y[p])
            if root(label[i]) != root(label[j]) and similar(payload[i][_SIG_BYTES:], payload[j][_SIG_BYTES:]):
                join(label[i], label[j])
                kept.append(p)
        return np.asarray(kept, dtype=np.int64)

    return keep


_PAIR = "a long, b long"


class _Finder:
    """Tables of one run."""

    def __init__(self, docs: DataFrame):
        self.scratch = Scratch(docs.sparkSession, "neardup")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = self.scratch.keep(self.docs.mapInArrow(_describe, "doc_id long, n_shingles long, node long, sig binary"))
        usable = self.rows.where("n_shingles > 0 and doc_id is not null")
        self.nodes = self.scratch.keep(usable.groupBy("node").agg(F.count("*").alias("rows"), F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")))
        self.buckets = self.nodes.select("node", "sig").mapInArrow(_bands, "key long, node long")
        self.several = buckets.crowded(self.buckets, self.scratch)

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, full) for distinct ``nodes``: the full sets, from the texts of their representatives."""
        wanted = self.scratch.keep(nodes.join(self.nodes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct())
        texts = self.docs.join(buckets.bounded(wanted, MAX_BROADCAST_NODES), "doc_id").select("doc_id", "text")
        return self.scratch.keep(texts.mapInArrow(_full_sets, "node long, full binary"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose full sets reach the threshold."""
        pairs = self.scratch.keep(pairs.distinct())
        sets = self.full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        left, right = sets.toDF("a", "full_a"), sets.toDF("b", "full_b")
        return self.scratch.keep(pairs.join(right, "b").join(left, "a").select("a", "b", "full_a", "full_b").mapInArrow(_verify, _PAIR))

    def to_leaders(self) -> DataFrame:
        """Survivors among the pairs of a bucket's least member and each other member."""
        sigs = self.nodes.select("node", "sig")
        pairs = buckets.leader_pairs(self.buckets, self.several)
        pairs = pairs.join(sigs.toDF("b", "sig_b"), "b").join(sigs.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")
        return pairs.mapInArrow(_prune, _PAIR)

    def across(self, labels: DataFrame) -> DataFrame:
        """Links between different components in buckets that hold several.

        Signatures pick the rows with a survivor; only these get their sets, and are counted
        exactly inside the same blocks, so that pairs just below the threshold are never rows.
        """
        sigs = self.nodes.select("node", F.col("sig").alias("payload"))
        dealt = buckets.blocks_across(self.buckets, self.several, labels, self.scratch)
        rows = self.scratch.keep(buckets.rows_across(dealt, sigs, _compare))
        sets = self.full_sets(rows.select("node").distinct())
        payloads = self.nodes.select("node", "sig").join(sets, "node").select("node", F.concat("sig", "full").alias("payload"))
        return self.scratch.keep(buckets.pairs_across(rows, payloads, _compare_sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id is the smallest doc_id reachable over pairs with 100 * intersection >= 75 *
    union of their sets; kept is doc_id = component_id. A null or empty text has no set and no
    link, and is kept. A row without doc_id takes no part: it has no component and is kept.
    Repeated rows each have their result. Other columns are not read. Sets and shingles are known
    by 64-bit hashes; a pair at the threshold itself meets with chance 0.998 directly.
    """
    run = _Finder(docs)
    links = run.confirmed(run.to_leaders())
    labels = components(links, run.scratch)
    more = run.across(labels)
    if more.limit(1).count():
        labels = components(links.union(more), run.scratch)
    # Only nodes of several rows or with links are looked up; any other row is its own component.
    linked = run.scratch.keep(run.nodes.select("node", "rep").join(labels, "node"))
    least = buckets.bounded(linked.groupBy("label").agg(F.min("rep").alias("component_id")), MAX_BROADCAST_NODES)
    of_node = linked.join(least, "label").select("node", "component_id")
    alone = run.nodes.where("rows > 1").join(linked, "node", "left_anti").select("node", F.col("rep").alias("component_id"))
    shared = buckets.bounded(run.scratch.keep(of_node.unionByName(alone)), MAX_BROADCAST_SHARED)
    out = run.rows.select("doc_id", "n_shingles", "node").join(shared, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, all columns kept.

    Rows that share a doc_id are one document: they go if none of them is kept.
    """
    gone = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone"))
    gone = buckets.bounded(Scratch(docs.sparkSession, "neardup-gone").keep(gone), MAX_BROADCAST_NODES)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as sh from places),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id left join n on n.doc_id = d.doc_id
"""
