"""Vector index and density clusters against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vocspark.operators import retrieval, vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute_dbscan(rows, similarity, least):
    """Every pair, then groups of cores and each border's nearest core."""
    ids = [i for i, _ in rows]
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    sims = {(a, b): round(float(unit[a] @ unit[b]), 6) for a in range(len(rows)) for b in range(len(rows)) if ok[a] and ok[b]}
    near = {a: [b for b in range(len(rows)) if sims.get((a, b), -2) >= similarity] for a in range(len(rows))}
    core = {a for a in near if len(near[a]) >= least}
    topic, todo = {}, sorted(core, key=lambda a: ids[a])
    for a in todo:
        stack = [a] if a not in topic else []
        while stack:
            x = stack.pop()
            if x not in topic:
                topic[x] = ids[a]
                stack += [b for b in near[x] if b in core]
    out = []
    for a, i in enumerate(ids):
        if a in core:
            out.append((i, topic[a], True, len(near[a]), 1.0))
        else:
            best = min(((-sims[a, b], ids[b], topic[b]) for b in near[a] if b in core), default=None)
            out.append((i, best[2] if best else -1, False, len(near[a]) if ok[a] else None, -best[0] if best else 0.0))
    return sorted(out)


def planted(n_clusters=6, size=40, noise=80, d=16, spread=0.4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, d))
    points = [c + spread * rng.normal(size=d) for c in centres for _ in range(size)] + [*rng.normal(size=(noise, d))]
    points += [points[3]] * 30 + [2 * points[5]] * 3  # copies, and one direction in two lengths
    order = rng.permutation(len(points))
    return [(int(i), [float(np.float32(x)) for x in points[p]]) for i, p in enumerate(order)]


@pytest.mark.parametrize("cells", (1, 7, 40))
def test_density_clusters_equal_brute_force(spark, cells, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)  # so that cells have several blocks
    rows = [*planted(), (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, *[1.0] * 15])]
    out = vectors.density_clusters(spark.createDataFrame(rows, SCHEMA), 0.8, 5, cells=cells).collect()
    got = sorted((r["id"], r["topic_id"], r["is_core"], r["n_near"], round(r["confidence"], 6)) for r in out)
    want = brute_dbscan(rows, 0.8, 5)
    assert got == want
    topics = {t for _, t, *_ in want}
    assert len(topics) >= 6 and any(not core and t >= 0 for _, t, core, *_ in want) and sum(t == -1 for _, t, *_ in want) > 20


def test_density_visits_are_few(spark):
    """Well separated cells share only what is near their borders, so no cell meets all vectors."""
    rows = spark.createDataFrame(planted(20, 60, 0, 32, 0.05), SCHEMA)
    nodes = vectors.unit_vectors(rows, "vec_id", "embedding").select(F.col("id").alias("node"), F.lit(1).cast("long").alias("weight"), F.lit(False).alias("core"), "v")
    fitted = vectors.fit_cells(nodes.select(F.col("node").alias("id"), "v"), 20)
    from vocspark.sources.scratch import Scratch

    dealt = vectors._dealt(nodes, fitted, math.sqrt(2 - 2 * 0.9), Scratch(spark, "t"))
    assert dealt.where("side = 1").count() < 3 * nodes.count() < dealt.where("side = 0").count() * 20


def test_dense_groups_emit_few_links(spark):
    near = np.ones((500, 700), dtype=bool)
    a, b = vectors.forest(near, np.arange(500), np.arange(700))
    assert len(a) == len(b) == 699
    near = np.eye(6, dtype=bool)[[0, 1, 2, 3]]
    assert len(vectors.forest(near, np.arange(4), np.arange(6))[0]) == 0


def test_density_of_nothing(spark):
    assert vectors.density_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in vectors.density_clusters(spark.createDataFrame([(1, None)], SCHEMA)).collect()] == [(1, -1, False, None, 0.0)]


def test_index_recall_and_exact_path(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 200)
    monkeypatch.setattr(vectors, "QUERY_PIECE", 16)
    rows = spark.createDataFrame(planted(30, 60, 400, 24, 0.4), SCHEMA)
    asked = rows.where("vec_id % 10 = 0")
    exact = retrieval.vector_topk(rows, asked, 10).cache()
    index = vectors.build_index(rows, cells=30, k=10)
    assert index.probes < 20  # far from all cells
    assert vectors.recall(vectors.search_index(index, asked, 10), exact).first()["recall"] >= 0.9
    order = lambda df: [tuple(r) for r in df.select("query_id", "id", "similarity", "rank").orderBy("query_id", "rank").collect()]
    assert order(vectors.search_index(index, asked, 10, probes=30)) == order(exact)


def test_index_of_given_vectors(spark):
    """These have no structure: the index must probe many cells, and says so, but keeps its recall."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = v.where("vec_id % 50 = 0")
    index = vectors.build_index(v, cells=12)
    assert vectors.recall(vectors.search_index(index, asked), retrieval.vector_topk(v, asked)).first()["recall"] >= 0.9
    empty = vectors.build_index(v.limit(0))
    assert vectors.search_index(empty, asked).count() == 0 and vectors.search_index(index, asked.limit(0)).count() == 0


# --- near groups of texts
def brute_groups(docs, distance=0.35):
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} for i, t in docs for w in [(t or "").split()]}
    near = lambda a, b: len(sets[a] & sets[b]) >= (1 - distance) * len(sets[a] | sets[b]) - 1e-9
    forms = {}
    for i, t in docs:
        forms.setdefault(t, []).append(i)
    heads = [min(v) for v in forms.values()]
    links = {a: [b for b in heads if b != a and near(a, b)] for a in heads}
    group = {}
    for a in sorted(heads):
        stack = [a]
        while stack:
            x = stack.pop()
            if x not in group:
                group[x] = a
                stack += links[x]
    return sorted((i, group[min(forms[t])], len(links[min(forms[t])])) for i, t in docs)


def test_near_groups_equal_brute_force(spark, monkeypatch):
    """Chains of edits, copies, groups that share half their words, buckets of several blocks."""
    from vocspark.operators import neargroups

    monkeypatch.setattr(neargroups, "BLOCK", 8)
    rng = np.random.default_rng(8)
    docs = []
    for g in range(8):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            words = list(words) if rng.random() < 0.3 else [f"g{g}w{i}" for i in range(60)]
            for at in rng.integers(0, 60, rng.integers(0, 7)):
                words[at] = f"n{rng.integers(0, 1 << 30)}"
            docs.append(" ".join(words))
    shared = [f"s{i}" for i in range(40)]
    docs += [" ".join(shared + [f"x{k}y{i}" for i in range(12)]) for k in range(40)]  # near the limit: 38 of 66 shingles in common
    docs += [docs[3]] * 4 + ["one", "one two", "", ""]
    rows = list(enumerate(docs))
    out = neargroups.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in out) == brute_groups(rows)


def test_near_groups_with_a_shingle_in_all(spark):
    """50,000 different texts that share one passage make no bucket of all, and no more rows than bands."""
    from vocspark.operators import neargroups

    words = F.concat_ws(" ", F.lit("read more here"), *(F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000_000)).cast("string")) for k in range(20)))
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    keys = docs.select(neargroups.shingles(F.split("text", " ")).alias("sh")).select(F.explode(neargroups._band_keys(F.col("sh"))).alias("key"))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < 100
    out = neargroups.near_groups(docs)
    assert out.where("group_id <> id or n_links > 0").count() == 0 and out.count() == 50_000


def test_density_rows_stay_few_where_cells_part_nothing(spark, monkeypatch):
    """Vectors in all directions are near the border of every cell: they are not written once for each, and the result is that of all pairs."""
    from vocspark.sources.scratch import Scratch

    monkeypatch.setattr(vectors, "PER_CELL", 10)  # 60 cells are wanted
    monkeypatch.setattr(vectors, "SCORES", 5_000, raising=False)
    monkeypatch.setattr(vectors, "PAIRS", 3, raising=False)
    written = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append((df.columns, kept := keep(self, df))) or kept)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(600, 16)))]
    rows += [(600 + i, rows[i][1]) for i in range(40)]
    out = vectors.density_clusters(spark.createDataFrame(rows, SCHEMA), 0.6, 4).collect()
    visits = [kept for names, kept in written if "home" in names]
    assert len(visits) == 2 and max(kept.count() for kept in visits) <= 8 * 600
    assert sorted((r["id"], r["topic_id"], r["is_core"], r["n_near"], round(r["confidence"], 6)) for r in out) == brute_dbscan(rows, 0.6, 4)


def test_near_rows_are_those_of_double_precision():
    """Cosines at the limit, a rounding step off, and beside it, in blocks of other sizes."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 40))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.concatenate([c * a + math.sqrt(1 - c * c) * (o - (o * a).sum(axis=1, keepdims=True) * a) / np.linalg.norm(o - (o * a).sum(axis=1, keepdims=True) * a, axis=1, keepdims=True) for c in (0.36, 0.3599996, 0.3599994, 0.360001) for o in [rng.normal(size=a.shape)]])
    near = np.concatenate([near for _, near, _, _ in vectors.near_rows(a, b, 0.36)])
    assert (near == (np.round(a @ b.T, 6) >= 0.36)).all() and near.sum() > 150
    assert [near.shape for _, near, _, _ in vectors.near_rows(a, b[:0], 0.36)] == [(50, 0)]
