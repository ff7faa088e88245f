"""Centroid clustering with exact integers, by a bisector tournament.

Vectors are whole numbers, and so are centroids, so no result depends on the order of sums. Of two
centroids a and b (a the smaller number) a vector x is nearer to a where 2 (b - a) x <= b b - a a:
the sign of one dot product with a normal and a threshold, both whole numbers made once a round. A
vector is tested k - 1 times, the winner so far against the next centroid; zero favours the smaller
number. Only the winner's distance is computed.

A round is one pass over the vectors: each task sums the vectors of its clusters, and k x d sums meet
in one aggregate, whatever the number of vectors or the share of a hot one. Centroids are k rows, the
only thing that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.scratch import Scratch

#: A component's largest size; with up to 64 of them, no product, sum of products or squared distance leaves 64 bits.
LARGEST = 1 << 27
MOST_COMPONENTS = 64
CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3


@dataclass
class Bisectors:
    """Centroids (k x d) with ``normals`` (k x k x d) and ``thresholds`` (k x k) of the pairs a < b."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray

    @staticmethod
    def between(centroids: np.ndarray) -> Bisectors:
        squares = (centroids * centroids).sum(axis=1)
        return Bisectors(centroids, 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None])

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of each vector's centroid, after k - 1 sign tests."""
        winner = np.zeros(len(vectors), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", vectors, self.normals[winner, rival]) - self.thresholds[winner, rival]
            winner[side > 0] = rival
        return winner

    def distances(self, vectors: np.ndarray, winner: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[winner]
        return (apart * apart).sum(axis=1)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component) of the vectors with exactly so many components, none null or non-finite.

    Others are left out. A component beyond ``LARGEST`` after scaling is an error, as its squared distance may not fit
    a long. A null id stays; repeated rows stay, each as a vector of its own.
    """
    if components > MOST_COMPONENTS:
        raise ValueError(f"at most {MOST_COMPONENTS} components keep distances within 64 bits")
    raw = F.col(vector_col).cast("array<double>")
    finite = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.where((F.size(raw) == components) & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(raw, lambda v: F.floor(v * scale)).alias("x"))
    fits = F.forall("x", lambda v: (v <= LARGEST) & (v >= -LARGEST))
    return whole.select("vec_id", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}"))).alias("x"))


def first_centroids(whole: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least SHA-256 of ``seed:vec_id``; equal ids by their components, null ids last. Fewer if there are fewer."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = whole.orderBy(by.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's next place: the floor of its vectors' mean, by component; where it has none it stays."""
    shared = whole.sparkSession.sparkContext.broadcast(Bisectors.between(centroids))
    k, d = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0))
            if len(vectors):
                winner = shared.value.nearest(vectors)
                np.add.at(total, winner, vectors)
                count += np.bincount(winner, minlength=k)
        own = np.flatnonzero(count)
        columns = [np.repeat(own, d), np.tile(np.arange(d), len(own)), total[own].reshape(-1), np.repeat(count[own], d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "place", "total", "n"])

    parts = whole.select("x").mapInArrow(sums, "cluster long, place long, total long, n long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("total", "n")]  # sums of longs, in up to 30 digits
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(*exact).collect():  # k x d rows
        out[r["cluster"], r["place"]] = int(r["total"]) // int(r["n"])
    return out


def fit(whole: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after so many rounds over (vec_id, x); a round that moves none is the last, as all others would repeat it."""
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        after = moved(whole, centroids)
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row of (vec_id, x): its nearest centroid and the squared distance."""
    shared = whole.sparkSession.sparkContext.broadcast(Bisectors.between(centroids) if len(centroids) else None)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            if len(vectors):
                winner = shared.value.nearest(vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(winner, pa.int32()), pa.array(shared.value.distances(vectors, winner))], names=["vec_id", "cluster", "distance"])

    return whole.select("vec_id", "x").mapInArrow(nearest, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that ``integer_vectors`` keeps.

    Inertia is the sum of squared distances, of the row's cluster and of all rows; it must fit a long. The digest is of
    the final centroid's components, joined by commas. With fewer vectors than k there are as many centroids; of equal
    centroids the smaller number has all vectors. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    whole = scratch.keep(integer_vectors(vectors, id_col, vector_col, components, scale))
    centroids = fit(whole, k, rounds, seed)
    found = scratch.keep(assigned(whole, centroids))
    scratch.drop(whole)
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    by_cluster = found.groupBy("cluster").agg(exact.alias("sum"))
    digest = vectors.sparkSession.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    total = by_cluster.agg(F.sum("sum").cast("long").alias("inertia"))
    few = by_cluster.select("cluster", F.col("sum").cast("long").alias("cluster_inertia")).join(F.broadcast(digest), "cluster").join(F.broadcast(total), F.lit(True))  # k rows, and one
    return found.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    """The same with the parameters of the query, each round as two steps of a chain of common table expressions."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = [
        "v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)",
        "c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), x) - 1 as k, x from v qualify k < 8)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} as materialized (select v.r, v.vec_id, v.x, min({apart}) as distance, arg_min(c.k, ({apart}, c.k)) as k from v, c{i} c group by all)")
        if i < ROUNDS:
            steps.append(f"s{i} as (select k, p, sum(x[p]) as total, count(*) as n from a{i}, range(1, 65) t(p) group by all)")
            steps.append(f"m{i} as (select k, list(((total - ((total % n) + n) % n) // n)::bigint order by p) as x from s{i} group by k)")
            steps.append(f"c{i + 1} as materialized (select c.k, coalesce(m.x, c.x) as x from c{i} c left join m{i} m using (k))")
    last = f"select vec_id, a.k::int as cluster, distance::bigint as distance, (sum(distance) over (partition by a.k))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c using (k)"
    return f"with {', '.join(steps)} {last}"


ORACLE_SQL = _rounds_sql()
