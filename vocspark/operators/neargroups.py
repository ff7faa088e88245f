"""Groups of texts with nearly the same word shingles, exactly, without pairing whole buckets.

Texts of equal comparable form are one node. A node has bands of several MinHash rows each, so that one
shingle in common puts nobody into a bucket. Every bucket's least node leads it: members are first held
against their leader, which joins large groups in as many comparisons as they have members. Where a
bucket still holds several groups, its members are dealt to blocks and compared inside tasks, and what
leaves a task is only as many links as connect what it found. Comparisons are of whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.operators.components import components, extended
from vocspark.operators.retrieval import comparable
from vocspark.operators.vectors import forest
from vocspark.sources.scratch import Scratch

WORDS = 3
#: Bands and their MinHash rows; at a similarity of 0.65 one of a thousand pairs shares no band, at 0.7 one of ten thousand.
BANDS, ROWS = 26, 3
#: Nodes on either side of a comparison inside a task.
BLOCK = 512
#: Overlaps counted at once.
AT_ONCE = 1 << 22


def shingles(words: Column) -> Column:
    """Distinct 64-bit hashes of all runs of three words; of the whole text if there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(WORDS))))
    # as the element of an array the words are split once, not for each run
    return F.transform(F.array(words), lambda w: F.array_sort(F.array_distinct(runs(w))))[0]


def _band_keys(sets: Column) -> Column:
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    @F.arrow_udf("array<bigint>")
    def keys(column: pa.Array) -> pa.Array:
        flat, bounds = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        out = np.zeros((len(column), BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                key = np.full(len(column), band, dtype=np.uint64)
                for row in range(band * ROWS, (band + 1) * ROWS):
                    mixed = flat * odd[row] + shift[row]
                    least = np.minimum.reduceat((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), bounds[:-1])
                    key = (key ^ least) * np.uint64(0x94D049BB133111EB)
                    key ^= key >> np.uint64(31)
                out[:, band] = key
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * BANDS), pa.array(out.view(np.int64).ravel()))

    return keys(sets)


def _near(x: Column, y: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both >= similarity * (F.size(x) + F.size(y) - both)


def in_blocks(rows: DataFrame, key: str, block: int, scratch: Scratch) -> DataFrame:
    """``rows`` with x, y and side: members of a key dealt to blocks, each two of which meet once, a block also itself.

    The lower block of a pair has side 0, the higher side 1; a block with itself has side 0 only.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, key).withColumn("own", F.expr("pmod(xxhash64(node), blocks)").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "blocks")


def _overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    flat_b, of_b = b.flatten().to_numpy(), np.repeat(np.arange(len(b)), b.value_lengths().to_numpy())
    order = np.argsort(flat_b, kind="stable")
    flat_b, of_b = flat_b[order], of_b[order]
    flat_a, of_a = a.flatten().to_numpy(), np.repeat(np.arange(len(a)), a.value_lengths().to_numpy())
    low, high = np.searchsorted(flat_b, flat_a, "left"), np.searchsorted(flat_b, flat_a, "right")
    hit = np.flatnonzero(high > low)
    done = np.concatenate([[0], np.cumsum((high - low)[hit])])
    at = 0
    while at < len(hit):
        to = max(int(np.searchsorted(done, done[at] + AT_ONCE, "right")) - 1, at + 1)
        some = hit[at:to]
        times = (high - low)[some]
        place = np.repeat(low[some] - np.cumsum(times) + times, times) + np.arange(times.sum())
        out += np.bincount(np.repeat(of_a[some], times) * len(b) + of_b[place], minlength=out.size).reshape(out.shape)
        at = to
    return out


def _blocks_of(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The two blocks that meet, in order of node, and whether they are one."""
    table = table.sort_by("node").combine_chunks()
    side = table.column("side").to_numpy()
    return (table, table, True) if not side.any() and table.column("x")[0] == table.column("y")[0] else (table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)), False)


def _alike(x: pa.Table, y: pa.Table, one: bool, similarity: float) -> np.ndarray:
    """Which sets of x and y have the similarity; of one block each two once."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), dtype=bool)
    a, b = (t.column("sh").combine_chunks() for t in (x, y))
    both = _overlaps(a, b)
    near = both >= similarity * (a.value_lengths().to_numpy()[:, None] + b.value_lengths().to_numpy()[None, :] - both)
    return np.triu(near, 1) if one else near


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: float = 0.35) -> DataFrame:
    """(id, group_id, n_links): connected groups of documents whose comparable texts are equal or within a Jaccard distance of three-word shingles.

    A group is named by its smallest id. n_links counts the other distinct texts that a document's text
    is near to itself; links are counted inside groups, block by block, and no pair leaves a task. Null
    and empty texts are one text. Rows that repeat an id stay rows.
    """
    scratch = Scratch(documents.sparkSession, "near-groups")
    similarity = 1 - distance - 1e-9
    form = comparable(F.coalesce(F.col(text_col), F.lit("")))
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(form).alias("node"), form.alias("form"))
    entries = rows.groupBy("node").agg(F.min("id").alias("least"), F.min("form").alias("form")).withColumn("sh", shingles(F.split("form", " ")))
    nodes = scratch.keep(entries.select("node", "least", "sh").withColumn("keys", _band_keys(F.col("sh"))))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    several = scratch.keep(buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("members")).where("leader <> last"))
    members = scratch.keep(buckets.join(several.select("key", "leader", "members"), "key"))
    sets = nodes.select("node", "sh")

    led = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    both = led.join(sets.toDF("a", "sh_a"), "a").join(sets.toDF("b", "sh_b"), "b")
    first = scratch.keep(both.where(_near(F.col("sh_a"), F.col("sh_b"), similarity)).select("a", "b"))
    labels = components(first, scratch)

    of = members.where("members > 2").select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = of.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = in_blocks(scratch.keep(of.join(mixed, "key")), "key", BLOCK, scratch).join(sets, "node")

    def across(table: pa.Table) -> pa.Table:
        x, y, one = _blocks_of(table)
        near = _alike(x, y, one, similarity) & (x.column("label").to_numpy()[:, None] != y.column("label").to_numpy()[None, :])
        a, b = forest(near, x.column("node").to_numpy(), y.column("node").to_numpy())
        return pa.table([a, b], names=["a", "b"])

    more = scratch.keep(left.groupBy("key", "x", "y").applyInArrow(across, "a long, b long").distinct())
    labels = extended(labels, more, scratch) if more.limit(1).count() else labels

    grouped = in_blocks(labels.withColumnRenamed("label", "key"), "key", BLOCK, scratch).join(sets, "node")

    def counts(table: pa.Table) -> pa.Table:
        x, y, one = _blocks_of(table)
        near = _alike(x, y, one, similarity)
        return pa.table([np.concatenate([x.column("node").to_numpy(), y.column("node").to_numpy()]), np.concatenate([near.sum(axis=1), near.sum(axis=0)])], names=["node", "n"])

    links = grouped.groupBy("key", "x", "y").applyInArrow(counts, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))
    placed = scratch.keep(nodes.select("node", "least").join(labels, "node", "left").join(links, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    names = placed.groupBy("label").agg(F.min("least").alias("group_id"))
    return rows.select("id", "node").join(placed.join(names, "label").select("node", "group_id", "n_links"), "node").select("id", "group_id", "n_links")

