"""Vectors in cells: an inverted-file index for searches, and density clusters.

Cells are the neighbourhoods of centres fitted to a bounded sample; every vector is put into the cell
of its nearest centre. Cells with many vectors are dealt to pieces by hash, so that no task holds a
whole one, and only what can meet in a cell is compared there. Vectors are scaled to length one, and
likeness is the cosine, rounded to six digits as everywhere in the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspark.operators.components import components
from vocspark.sources.scratch import Scratch

#: Rows that cells are fitted to at most, those of the least hashes of their ids.
SAMPLE = 20_000
#: Rows to a cell that are aimed at, and cells at most; beyond that cells grow and are dealt to more pieces.
PER_CELL, MOST_CELLS = 1_000, 1_024
#: Vectors and queries of a piece of a cell.
PIECE, QUERY_PIECE = 16_384, 4_096
#: Vectors on either side of a pair of blocks at most; few and small cells still have ``SPREAD`` blocks of ``LEAST_BLOCK``, for more tasks.
BLOCK, SPREAD, LEAST_BLOCK = 24_576, 8, 1_024
#: Cells that a vector is in on average at most, its home among them, and no more than half of them; else there are fewer cells.
MOST_VISITS = 8
#: Scores that a task holds at once, and pairs that are worked out in double precision at once.
SCORES, PAIRS = 1_048_576, 65_536


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix; all have one length and no null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of length one; null vectors, those with null or non-finite parts, and zeros are left out."""
    raw = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw")).where(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.withColumn("norm", norm).where("norm > 0").select("id", F.transform("raw", lambda x: x / F.col("norm")).alias("v"))


@dataclass
class Cells:
    """Centres of the cells, k x d."""

    centres: np.ndarray

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances of vectors of length one to all centres; the one cell of an empty table is as near to any."""
        if self.centres.shape[1] != vectors.shape[1] and not self.centres.any():
            return np.zeros((len(vectors), len(self.centres)))
        return np.maximum(1 - 2 * vectors @ self.centres.T + (self.centres**2).sum(axis=1), 0)


def fit_cells(units: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8) -> Cells:
    """Centres by k-means over at most ``sample`` rows of (id, v); as many as there are ``PER_CELL`` rows, or ``cells``.

    The sample has the ids of the least hashes; equal ids have one row there. Without rows there is one cell.
    """
    total = units.count()
    share = min(1.0, 1.5 * sample / max(total, 1))
    drawn = units.where(F.expr(f"pmod(xxhash64(id), 4294967296) < {share * 4294967296}")).orderBy(F.xxhash64("id"), "id", "v").limit(sample)
    rows = _matrix(drawn.select("v").toArrow().column("v"))
    if not len(rows):
        return Cells(np.zeros((1, 1)))
    k = min(cells or max(1, min(total // PER_CELL, MOST_CELLS)), len(rows))
    centres = np.unique(rows[: 4 * k], axis=0)
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:k]]
    for _ in range(rounds):
        nearest = Cells(centres).distances(rows).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return Cells(centres)


def in_cells(units: DataFrame, cells: Cells) -> DataFrame:
    """(id, v, cell): every row with its nearest centre, the smaller number on ties."""
    shared = units.sparkSession.sparkContext.broadcast(cells)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.distances(_matrix(batch.column(1))).argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return units.select("id", "v").mapInArrow(nearest, "id long, v array<double>, cell int")


@dataclass
class VectorIndex:
    """``rows`` (id, v, cell) is a written table of all vectors; ``probes`` cells are searched for a query by default."""

    cells: Cells
    rows: DataFrame
    probes: int


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, recall: float = 0.95, k: int = 15, probes: int | None = None) -> VectorIndex:
    """An inverted file over all vectors. ``probes`` is chosen to find that share of the ``k`` nearest, if it isn't given.

    The share is measured within the bounded sample that the cells are fitted to: 200 of its rows ask, and the
    least number of cells is taken that holds the wanted share of each one's ``k`` nearest in the sample, on average.
    """
    scratch = Scratch(vectors.sparkSession, "vector-index")
    units = scratch.keep(unit_vectors(vectors, id_col, vector_col))
    fitted = fit_cells(units, cells)
    rows = scratch.keep(in_cells(units, fitted).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell"))
    if probes is None:
        some = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v"))
        probes = _probes(fitted, some, recall, k)
    scratch.drop(units)
    return VectorIndex(fitted, rows, min(probes, len(fitted.centres)))


def _probes(cells: Cells, rows: np.ndarray, recall: float, k: int) -> int:
    if len(rows) <= k:
        return len(cells.centres)
    asked = rows[:: max(1, len(rows) // 200)][:200]
    best = np.argsort(-(asked @ rows.T), axis=1)[:, :k]
    of = cells.distances(rows).argmin(axis=1)
    rank = np.argsort(np.argsort(cells.distances(asked), axis=1), axis=1)  # of each cell for each query
    held = np.take_along_axis(rank, of[best], axis=1)
    return next(p for p in range(1, len(cells.centres) + 1) if (held < p).mean() >= recall)


def search_index(index: VectorIndex, queries: DataFrame, k: int = 15, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` most similar of the vectors in each query's ``probes`` nearest cells.

    With as many probes as cells the result is exact. Ties go to the smaller id. A query meets a cell's pieces, and a
    piece the cell's queries, in blocks of bounded size, however many there are of either.
    """
    spark = index.rows.sparkSession
    shared, probes = spark.sparkContext.broadcast(index.cells), probes or index.probes

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(shared.value.distances(_matrix(batch.column(1))), axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

    scratch = Scratch(spark, "vector-search")
    asked = scratch.keep(unit_vectors(queries, id_col, vector_col).mapInArrow(probed, "id long, v array<double>, cell int"))
    sizes = index.rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_PIECE).cast("int").alias("blocks")), "cell")
    sizes = F.broadcast(sizes)  # a row for each cell, of which there are MOST_CELLS at most
    own, other = F.expr("pmod(xxhash64(id), pieces)").cast("int"), F.expr("pmod(xxhash64(id), blocks)").cast("int")
    held = index.rows.join(sizes, "cell").select("id", "v", "cell", own.alias("piece"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    asked = asked.join(sizes, "cell").select("id", "v", "cell", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), other.alias("block"))

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = held.column("id").to_numpy(), ["query_id", "id", "similarity"]
        parts = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})]
        if len(ids) and asked.num_rows:
            order = np.argsort(ids, kind="stable")
            ids, matrix, whose, wanted = ids[order], _matrix(held.column("v"))[order], asked.column("id").to_numpy(), _matrix(asked.column("v"))
            for at in range(0, len(wanted), 256):
                scores = np.round(wanted[at : at + 256] @ matrix.T, 6)
                first = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ids are in order, so ties are too
                parts.append(pa.table([np.repeat(whose[at : at + 256], first.shape[1]), ids[first].ravel(), np.take_along_axis(scores, first, axis=1).ravel()], names=names))
        return pa.concat_tables(parts)

    keys = ("cell", "piece", "block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "query_id long, id long, similarity double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the rows (query_id, id) of ``exact`` that ``found`` has."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg((F.count("hit") / F.count("*")).alias("recall"))


def _visits(vectors: np.ndarray, centres: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and which cells it is in: its home, and those within ``reach`` of the plane between the two centres."""
    squares = Cells(centres).distances(vectors)
    home = squares.argmin(axis=1)
    beyond = (squares - squares.min(axis=1, keepdims=True)) / (2 * apart[home])  # distance to the plane
    return home, (beyond <= reach) | (np.arange(len(centres)) == home[:, None])


def _apart(centres: np.ndarray) -> np.ndarray:
    """Distances of the centres."""
    return np.sqrt(np.maximum((centres**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * centres @ centres.T, 1e-30))


def _fit_to_reach(nodes: DataFrame, reach: float) -> Cells:
    """Cells of (node, v) in which vectors have ``MOST_VISITS`` on average at most, judged by 2,000 of them: one where cells part nothing."""
    units = nodes.select(F.col("node").alias("id"), "v")
    fitted, some = fit_cells(units), None
    while len(fitted.centres) > 1:
        some = _matrix(units.orderBy(F.xxhash64("id"), "id").limit(2_000).select("v").toArrow().column("v")) if some is None else some
        apart = _apart(fitted.centres)
        if sum(_visits(some[at : at + 500], fitted.centres, apart, reach)[1].sum() for at in range(0, len(some), 500)) <= min(MOST_VISITS, len(fitted.centres) / 2) * len(some):
            break
        fitted = fit_cells(units, max(1, len(fitted.centres) // 4))
    return fitted


def _dealt(nodes: DataFrame, cells: Cells, reach: float, scratch: Scratch) -> DataFrame:
    """(key, side, node, weight, core, v): all that can be within ``reach``, met in blocks.

    A vector's neighbours are in its home cell, or within ``reach`` of the plane between that cell's centre and their
    own; such ones visit the cell. The home vectors of a cell (side 0) meet all that are there (side 1), block by block.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(cells)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres
        apart = _apart(centres)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                home, there = _visits(_matrix(part.column(3)), centres, apart, reach)
                row, cell = np.nonzero(there)
                for some in (slice(k, k + 8192) for k in range(0, len(row), 8192)):
                    columns = [c.take(pa.array(row[some])) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cell[some].astype(np.int32)), pa.array(cell[some] == home[row[some]])], names=["node", "weight", "core", "v", "cell", "home"])

    rows = scratch.keep(nodes.select("node", "weight", "core", "v").mapInArrow(visits, "node long, weight long, core boolean, v array<double>, cell int, home boolean"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.least(F.lit(max(1, SPREAD // len(cells.centres))), F.ceil(n / LEAST_BLOCK))).cast("int")
    sizes = rows.groupBy("cell").agg(blocks(F.count_if("home")).alias("homes"), blocks(F.count("*")).alias("all"))
    rows = rows.join(F.broadcast(sizes), "cell").where("homes > 0")  # a row for each cell
    mine = rows.where("home").select("*", F.lit(0).alias("side"), F.expr("pmod(xxhash64(node), homes)").cast("int").alias("x"), F.explode(F.expr("sequence(0, all - 1)")).alias("y"))
    them = rows.select("*", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, homes - 1)")).alias("x"), F.expr("pmod(xxhash64(node, 1), all)").cast("int").alias("y"))
    return mine.unionByName(them).select("cell", "x", "y", "side", "node", "weight", "core", "v")


def _sides(table: pa.Table) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(node, weight, core, v) of the home vectors and of all, each in order of node."""
    side, node, weight, core = (table.column(c).to_numpy() for c in ("side", "node", "weight", "core"))
    v = _matrix(table.column("v"))
    order = np.argsort(node, kind="stable")
    return tuple(tuple(c[order[side[order] == s]] for c in (node, weight, core, v)) for s in (0, 1))


def _cosines(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded cosines of some pairs of a row of ``a`` and a row of ``b``."""
    parts = [np.einsum("ij,ij->i", a[row[at : at + PAIRS]], b[col[at : at + PAIRS]]) for at in range(0, len(row), PAIRS)]
    return np.round(np.concatenate([*parts, np.zeros(0)]), 6)


def near_rows(a: np.ndarray, b: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(first row, near, score, slack) of some rows of ``a`` at a time: which rows of ``b`` have that rounded cosine.

    Scores are in single precision, off by ``slack`` at most; pairs that these can't tell are worked out in double.
    """
    if not len(b):
        b = np.zeros((1, a.shape[1])) - 2  # no vector
        yield from ((at, near[:, :0], score[:, :0], slack) for at, near, score, slack in near_rows(a, b, 2.0))
        return
    right = np.ascontiguousarray(b.astype(np.float32).T)
    slack = (a.shape[1] + 4) * 2.0**-23 + 1e-6
    step = max(1, SCORES // len(b))
    for at in range(0, len(a), step):
        score = a[at : at + step].astype(np.float32) @ right
        near = score >= np.float32(similarity + slack)
        row, col = np.nonzero((score >= np.float32(similarity - slack)) ^ near)
        near[row, col] = _cosines(a, b, at + row, col) >= similarity
        yield at, near, score, slack


def forest(near: np.ndarray | Iterator[np.ndarray], mine: np.ndarray, them: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links (row of ``mine``, column of ``them``) as connect all that the rows of ``near`` connect."""
    nodes, at = np.unique(np.concatenate([mine, them]), return_inverse=True)
    label, size, own, other = np.arange(len(nodes)), np.ones(len(nodes), dtype=np.int64), at[: len(mine)], at[len(mine) :]
    a, b = [], []
    for i, row in enumerate(near):
        there = other[np.flatnonzero(row)]
        mark, here = label[there], label[own[i]]
        if (mark == here).all():
            continue
        groups, first = np.unique(mark, return_index=True)
        new = groups != here
        a += [mine[i]] * int(new.sum())
        b += nodes[there[first[new]]].tolist()
        groups = np.append(groups[new], here)
        largest = groups[size[groups].argmax()]
        moved = groups[groups != largest]
        grown = size[moved].sum()
        if grown == len(moved):  # single nodes, whose labels are their places
            label[moved] = largest
        else:
            label[np.isin(label, moved)] = largest
        size[largest] += grown
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def density_clusters(vectors: DataFrame, similarity: float = 0.8, least: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """(id, topic_id, is_core, n_near, confidence): clusters of dense neighbourhoods (DBSCAN), -1 for the rest.

    A vector with at least ``least`` vectors of that cosine (itself among them) is core. Cores within
    it of each other are one cluster, named by its smallest core id. Another vector with a core that
    near is in the cluster of its nearest core (ties: the smaller id), and its confidence is that
    cosine; a core's is 1. All others, and null, zero or non-finite vectors, have topic -1 and
    confidence 0; n_near is null for those without a direction.

    Equal vectors are one node with a weight. Nodes meet in cells (``_dealt``), so that none is
    compared with all, and blocks of a cell emit counts, as few links as connect them and one nearest
    core a node, never their pairs. Rows that repeat an id count as vectors each. Where vectors are
    less apart than ``similarity`` reaches, cells can't part them: there are few cells then, all pairs
    are compared, and each vector is sent to as many tasks as there are blocks of ``BLOCK``.
    """
    scratch = Scratch(vectors.sparkSession, "density")
    units = scratch.keep(unit_vectors(vectors, id_col, vector_col))
    nodes = scratch.keep(units.groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("weight")).select(F.coalesce("least_id", F.lit(-1)).alias("least_id"), F.xxhash64("v").alias("node"), "weight", F.lit(False).alias("core"), "v"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * (similarity - 1e-6))))
    fitted = fit_cells(nodes.select(F.col("node").alias("id"), "v"), cells) if cells else _fit_to_reach(nodes, reach)

    def counts(table: pa.Table) -> pa.Table:
        (mine, _, _, a), (_, weight, _, b) = _sides(table)
        single = (weight == 1).all()
        n = [np.count_nonzero(near, axis=1) if single else (near @ weight.astype(float)).astype(np.int64) for _, near, _, _ in near_rows(a, b, similarity)]
        return pa.table([mine, np.concatenate([*n, np.zeros(0, np.int64)])], names=["node", "n"])

    keys = ("cell", "x", "y")
    near = _dealt(nodes, fitted, reach, scratch).groupBy(*keys).applyInArrow(counts, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_near"))
    counted = scratch.keep(nodes.drop("core").join(near, "node").withColumn("core", F.col("n_near") >= least))

    def links(table: pa.Table) -> pa.Table:
        (mine, _, core, a), (them, _, other, b) = _sides(table)
        them, b = them[other], b[other]
        x, y = forest((row for _, near, _, _ in near_rows(a[core], b, similarity) for row in near), mine[core], them)
        edge, a = mine[~core], a[~core]
        parts = [(x, y, np.full(len(x), np.nan))]
        for at, near, score, slack in near_rows(a, b, similarity):
            row, col = np.nonzero(near & (score >= score.max(axis=1, initial=-2, keepdims=True) - np.float32(2 * slack)))
            exact, best = _cosines(a, b, at + row, col), np.full(len(near), -2.0)
            np.maximum.at(best, row, exact)
            tied = exact == best[row]  # of equal ones all go on, to be told apart by their ids
            parts.append((edge[at + row[tied]], them[col[tied]], exact[tied]))
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], names=["a", "b", "score"])

    found = scratch.keep(_dealt(counted, fitted, reach, scratch).groupBy(*keys).applyInArrow(links, "a long, b long, score double"))
    joined = components(found.where("isnan(score)").select("a", "b"), scratch)
    cores = counted.where("core").select("node", "least_id").join(joined, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    names = cores.groupBy("label").agg(F.min("least_id").alias("topic_id"))
    cores = scratch.keep(cores.join(names, "label").select("node", "least_id", "topic_id"))
    borders = found.where("not isnan(score)").join(cores.select(F.col("node").alias("b"), "least_id", "topic_id"), "b").groupBy(F.col("a").alias("node")).agg(F.min_by(F.struct("topic_id", "score"), F.struct(-F.col("score"), "least_id")).alias("best"))
    of = counted.select("node", "core", "n_near").join(cores.select("node", F.col("topic_id").alias("own")), "node", "left").join(borders, "node", "left")
    of = of.select("node", "n_near", F.col("core").alias("is_core"), F.coalesce("own", "best.topic_id", F.lit(-1)).alias("topic_id"), F.coalesce(F.when(F.col("core"), 1.0), "best.score", F.lit(0.0)).alias("confidence"))
    placed = units.select("id", F.xxhash64("v").alias("node")).join(of, "node").select("id", "topic_id", "is_core", "n_near", "confidence")
    rest = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw"))
    lost = rest.where(~F.coalesce(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("raw", lambda x: x != 0), F.lit(False)))
    return placed.unionByName(lost.select("id", F.lit(-1).cast("long").alias("topic_id"), F.lit(False).alias("is_core"), F.lit(None).cast("long").alias("n_near"), F.lit(0.0).alias("confidence")))
