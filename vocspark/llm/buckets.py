"""Pairs from hash buckets, without spreading any bucket into all its pairs.

``buckets`` has a row (key, node) for each bucket that a node is in. Most buckets have one
member, and grouped minima and maxima, combined before the shuffle, find the others. A bucket
of two is its own pair; a larger one is first held against its least member. When the links
found so are components, only buckets that still hold several of them are compared, inside tasks
and across components only. Large ones are dealt to cells of sizes that can be near, where nodes
have a size, and cells to pairs of blocks. A node is in two cells and is dealt to at most
``MOST_BLOCKS`` pairs of blocks in each, so rows grow as the buckets' members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.scratch import Scratch

BLOCK = 512
#: Blocks of a cell: 36 pairs of blocks are spread over tasks, whatever its number of members.
MOST_BLOCKS = 8
#: Keys of large buckets that may be broadcast (some 24 bytes each); more are joined by shuffle.
MAX_BROADCAST_KEYS = 1_000_000

#: Takes the payloads and labels of all rows; gives what takes the places there of the left and right nodes of some pairs,
#: and the pairs' buckets, and gives the places of the pairs to keep.
Compare = Callable[[list[bytes], np.ndarray], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def crowded(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, members, least, most) of buckets with several members."""
    return scratch.keep(buckets.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most"))


def leader_pairs(buckets: DataFrame, several: DataFrame) -> DataFrame:
    """(a, b): each bucket's least member with each other member."""
    twos = several.where("members = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    large = bounded(several.where("members > 2").select("key", F.col("least").alias("a")), MAX_BROADCAST_KEYS)
    rest = buckets.join(large, "key").where("node <> a").select("a", F.col("node").alias("b"))
    return twos.unionByName(rest).distinct()


def likeliest_leaders(buckets: DataFrame, several: DataFrame) -> DataFrame:
    """(a, b): for each node that is not the least of a bucket of its own, the one that leads most of its buckets, the least on ties."""
    twos = several.where("members = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    large = bounded(several.where("members > 2").select("key", F.col("least").alias("a")), MAX_BROADCAST_KEYS)
    led = twos.unionByName(buckets.join(large, "key").where("node <> a").select("a", F.col("node").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    return led.groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a")).select("a", "b")


def blocks_across(buckets: DataFrame, several: DataFrame, labels: DataFrame, scratch: Scratch, ratio: float = 0.0) -> DataFrame:
    """(key, side, node, label, bucket, size, guest): members of buckets of three or more that hold several components, dealt to pairs of blocks.

    labels (node, label) may lack nodes without links. A key is a pair of blocks of one cell:
    its two blocks have sides 0 and 1, a block with itself has side 2. If ``buckets`` has sizes,
    only nodes whose sizes have a quotient of ``ratio`` at least are near: a bucket over ``BLOCK``
    is cut to cells of such sizes, and each node is a guest in the cell above its own.
    """
    sized = "size" in buckets.columns
    large = bounded(several.where("members > 2").select("key"), MAX_BROADCAST_KEYS)
    size = F.col("size").cast("int") if sized else F.lit(0)
    rows = scratch.keep(buckets.join(large, "key").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), size.alias("size")))
    mixed = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    mixed = scratch.keep(mixed.select("key", "members"))
    if sized:
        step = 1.01 * -math.log(ratio)  # a little wide, so that rounding parts no pair
        own = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / step).cast("int")
        cells = F.when(F.col("members") > BLOCK, F.array(own, own + 1)).otherwise(F.array(F.lit(0)))
    else:
        cells = F.array(F.lit(0))
    hot = bounded(mixed.where(F.col("members") > BLOCK), MAX_BROADCAST_KEYS)
    counted = rows.join(hot, "key").select("key", F.explode(cells).alias("cell")).groupBy("key", "cell").agg(F.count("*").alias("in_cell"))
    counted = bounded(scratch.keep(counted), MAX_BROADCAST_KEYS)
    rows = rows.join(mixed, "key").select("key", "node", "label", "size", F.posexplode(cells).alias("guest", "cell")).join(counted, ["key", "cell"], "left")
    blocks = F.coalesce(F.least(F.ceil(F.col("in_cell") / BLOCK), F.lit(MOST_BLOCKS)), F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    key = F.xxhash64("key", "cell", F.least("block", "other"), F.greatest("block", "other"))
    return rows.select(key.alias("key"), side.alias("side"), "node", "label", F.col("key").alias("bucket"), "size", (F.col("guest") == 1).alias("guest"))


def _in_blocks(dealt: DataFrame, payloads: DataFrame, make: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``make`` over the rows (key, side, node, label, bucket, size, guest, payload) of whole keys."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = table.column(0).to_numpy()
            if not len(keys):
                continue
            last = int(np.argmax(keys == keys[-1]))  # the last key may go on in the next batch
            held = table.slice(last).combine_chunks()
            yield make(table.slice(0, last))
        if held is not None:
            yield make(held)

    rows = dealt.join(payloads, "node").select("key", "side", "node", "label", "bucket", "size", "guest", "payload")
    return rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(made, schema)


def joins() -> tuple[Callable[[int], int], Callable[[int, int], None]]:
    """What gives the root of a label, and what joins two labels, in one task."""
    above: dict[int, int] = {}

    def root(i: int) -> int:
        while above.get(i, i) != i:
            above[i] = above.get(above[i], above[i])
            i = above[i]
        return i

    def join(i: int, j: int) -> None:
        above[root(i)] = root(j)

    return root, join


#: Pairs compared at once.
PAIRS = 1 << 15


def _pairs_of_blocks(keys: np.ndarray, side: np.ndarray, size: np.ndarray, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of rows of each key whose sizes can be near: every two of a block with itself, and those of side 0 with those of side 1."""
    number = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else keys
    at = (number << 32) | size.astype(np.int64)  # rows of a key, by size
    low, high = np.floor(size * ratio).astype(np.int64), np.minimum(np.ceil(size / ratio), (1 << 31) - 1).astype(np.int64) if ratio else np.full(len(size), (1 << 31) - 1)
    for left, right in ((2, 2), (0, 1)):
        mine, theirs = (np.flatnonzero(side == s) for s in (left, right))
        mine, theirs = (x[np.argsort(at[x], kind="stable")] for x in (mine, theirs))
        end = np.searchsorted(at[theirs], (number[mine] << 32) | high[mine], side="right")
        begin = np.arange(1, len(mine) + 1) if left == 2 else np.searchsorted(at[theirs], (number[mine] << 32) | low[mine])
        times = np.maximum(end - begin, 0)
        done = np.concatenate([[0], np.cumsum(times)])
        i = 0
        while i < len(mine):
            to = max(int(np.searchsorted(done, done[i] + PAIRS, side="right")) - 1, i + 1)
            some = times[i:to]
            if done[to] > done[i]:
                yield np.repeat(mine[i:to], some), theirs[np.repeat(begin[i:to] + some - np.cumsum(some), some) + np.arange(done[to] - done[i])]
            i = to


def _met(table: pa.Table, compare: Compare, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of different labels that ``compare`` keeps."""
    keys, side, label, bucket, size = (table.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
    guest = table.column(6).to_numpy(zero_copy_only=False).astype(bool) if table.num_rows else np.zeros(0, bool)
    keep = compare(table.column(7).to_pylist(), label)
    for i, j in _pairs_of_blocks(keys, side, size, ratio):
        other = (label[i] != label[j]) & ~(guest[i] & guest[j])  # guests meet in their own cell
        if other.any():
            x, y = i[other], j[other]
            alive = keep(x, y, bucket[x])
            yield x[alive], y[alive]


def pairs_across(dealt: DataFrame, payloads: DataFrame, compare: Compare, ratio: float = 0.0) -> DataFrame:
    """(a, b): pairs of different labels that ``compare`` keeps."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        node, none = table.column(2).to_numpy(), np.zeros(0, np.int64)
        x, y = (np.concatenate(c) for c in zip((none, none), *_met(table, compare, ratio), strict=True))
        a, b = node[x.astype(np.int64)], node[y.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _in_blocks(dealt, payloads, pairs, "a long, b long")


def rows_across(dealt: DataFrame, payloads: DataFrame, compare: Compare, ratio: float = 0.0) -> DataFrame:
    """The rows of ``dealt`` that are in a pair that ``compare`` keeps."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        used = np.zeros(table.num_rows, dtype=bool)
        for x, y in _met(table, compare, ratio):
            used[x] = used[y] = True
        kept = table.select([0, 1, 2, 3, 4, 5, 6]).filter(pa.array(used)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in kept.columns], names=kept.column_names)

    return _in_blocks(dealt, payloads, rows, "key long, side int, node long, label long, bucket long, size int, guest boolean")
