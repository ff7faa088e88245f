"""Periodic runs against all periods tried, and centroid clustering against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.compare import connection, same
from tests.conftest import SF
from tests.llm import helpers as H
from vocspark.llm import centroids, queries, runs


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- periodic runs
def brute_runs(w):
    """Every stretch of every period, the smallest period of each."""
    found = {}
    w = np.unique(np.asarray(w, dtype=object).astype(str), return_inverse=True)[1]
    for p in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[p:] == w[:-p]).astype(int), [0]])))
        for i, j in edge.reshape(-1, 2).tolist():
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *head, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            w = []
            for _ in range(rng.randrange(0, 9)):
                w += [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 7)
            texts.append(w)
        bounds = np.cumsum([0, *map(len, texts)])
        want = [(s + b, n, p) for w, b in zip(texts, bounds) for s, n, p in brute_runs(w)]
        assert runs.runs_of(np.array(sum(texts, []), dtype=np.uint64), bounds) == want


def test_op11_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    out = queries.op11_periodic_runs(spark, SF).collect()
    assert len(out) == len(docs) and sum(r["n_runs"] > 0 for r in out) > 10
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == brute_report(r["doc_id"], docs[r["doc_id"]]), r["doc_id"]


def test_runs_edge_rows(spark):
    for docs in (H.edge_docs(spark), H.empty_docs(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = runs.digests(runs.collapse_runs(runs.with_planted_runs(docs))).collect()
        assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out), key=str) == sorted(((i, *brute_report(i, t)) for i, t in rows), key=str)
    kept = runs.collapse_runs(H.edge_docs(spark).withColumnRenamed("node", "runs"))
    assert kept.columns.count("runs") == 1 and kept.where("doc_id = 2").first()["collapsed"] == ""


def test_runs_of_long_texts(spark):
    """A text cut into blocks has the words of a whole one; repetitions take n log n steps."""
    long = " ".join(["x y"] * 400_000 + [f"w{i}" for i in range(600_000)] + ["z"] * 300_000)
    row = runs.collapse_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 800_000, 2), (1_400_000, 300_000, 1)]
    assert row["collapsed"] == " ".join(["x y", *(f"w{i}" for i in range(600_000)), "z"])


# --- centroid clustering
def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    own = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(own))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(own)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                own[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in last if o == j) for j in range(k)}
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), sha(",".join(map(str, own[o])))) for i, d, o in last), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, x int, cluster string"


@pytest.mark.parametrize("sf", (SF, SF.replace("0.001", "0.01")))
def test_clusters_equal_sql(spark, sf):
    same(queries.op12_centroid_clustering(spark, sf), connection(sf), centroids.ORACLE_SQL)


def test_clusters_equal_plain_python(spark):
    """Ties, equal vectors under several ids, empty clusters, odd vectors, a hot one."""
    rng = random.Random(2)
    points = [[float(rng.randrange(-3, 4)) / 8 for _ in range(64)] for _ in range(12)]
    rows = [(i, points[i % 12] if i % 3 else points[0]) for i in range(90)]
    rows += [(90, None), (91, [1.0] * 63), (92, [1.0] * 65), (93, [math.nan] * 64), (94, [math.inf, *[0.0] * 63]), (95, [None, *[0.0] * 63]), (None, points[1]), (3, points[5]), (3, points[5]), (96, [-0.0001] * 64), (97, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], VECTORS)
    assert got(centroids.cluster(df)) == plain_clusters(rows)
    few = [(i, v) for i, v in rows if i in (1, 2, 4, 90)]
    assert got(centroids.cluster(df.where("vec_id in (1, 2, 4, 90)"))) == plain_clusters(few)
    assert got(centroids.cluster(df.limit(0))) == []


def test_tournament_breaks_ties_by_number():
    own = np.array([[2, 0], [0, 2], [-2, 0], [2, 0]], dtype=np.int64)
    board = centroids.Bisectors.between(own)
    assert board.nearest(np.array([[1, 1], [-1, 1], [0, 0], [5, 0], [-9, -9]], dtype=np.int64)).tolist() == [0, 1, 0, 0, 2]


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [3e9] * 64, 1, 2, "c")], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(df).collect()
