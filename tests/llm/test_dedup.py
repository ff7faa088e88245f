"""Line dedup, near-duplicates, components, fingerprints."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import connection, same
from tests.conftest import SF
from tests.llm import helpers as H
from vocspark.llm import buckets, components, edits, fingerprints, linededup, neardup, queries
from vocspark.llm.scratch import Scratch


def test_near_duplicates_equal_sql(spark):
    same(queries.op5_minhash_neardup(spark, SF), connection(SF), neardup.ORACLE_SQL)


def test_near_duplicates_of_edge_rows(spark):
    out = neardup.near_duplicates(H.edge_docs(spark)).collect()
    assert len(out) == 13
    of = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert of[1]["n_shingles"] == of[2]["n_shingles"] == of[3]["n_shingles"] == 0 and all(of[i]["kept"] for i in (1, 2, 3))
    assert of[5]["component_id"] == of[6]["component_id"] == of[7]["component_id"] == 5 and not of[7]["kept"]
    assert of[8]["n_shingles"] == 1 and of[8]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    assert neardup.near_duplicates(H.empty_docs(spark)).count() == 0


def test_near_copies_in_one_large_bucket(spark, monkeypatch):
    """More members than a block, near the threshold: brute force over all pairs gives the same components."""
    import random

    monkeypatch.setattr(buckets, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2))):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(20)]
    sets = {i: H.shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = H.components(sets, links)
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want


def test_pruning_bound():
    assert neardup.least_matches(120) < 90 and neardup.least_matches(24) >= 8
    a = neardup._signatures(*neardup._sets(*neardup.text_buffer(pa.array([H.PROSE, H.PROSE + " x", "q w e r t y u i o p"]))))
    assert list(neardup.survivors(a[[0, 0]], a[[1, 2]])) == [0]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(159, 200), (7, 7)]
    out = components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    want = H.components({x for p in links for x in p}, links)
    got = {r["node"]: r["label"] for r in out.collect()}
    assert got == {i: want[i] for i in got} and len(got) == 41 + 61


def brute_lines(docs, classes):
    """Texts with only the first line of each class, by id and place."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        kept, k = [], 0
        for line in text.split("\n"):
            if linededup.normal_form(line):
                c = classes[i][k]
                k += 1
                if c in seen:
                    continue
                seen.add(c)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines_follow_their_classes(spark):
    out = {r["doc_id"]: r for r in queries.op1_line_dedup(spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    form = {}
    for i, text in docs:  # equal normal forms are one class
        for line, c in zip([x for x in text.split("\n") if linededup.normal_form(x)], out[i]["class_ids"], strict=True):
            assert form.setdefault(linededup.normal_form(line), c) == c
    assert brute_lines(docs, {i: out[i]["class_ids"] for i in out}) == {i: out[i]["text"] for i in out}


def test_fuzzy_lines(spark):
    words = [f"word{i}number" for i in range(300)]
    near = list(words)
    near[150] = "changed"
    docs = spark.createDataFrame([(1, "Head line one\n" + " ".join(words)), (2, " ".join(near) + "\nhead LINE, one!"), (3, "something else")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert out[2] == "" and out[3] == "something else" and out[1].startswith("Head line one\n")


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_recall_of_short_long_and_non_latin_lines(spark):
    """Pairs of one changed word or character, of similarity 0.9 at least: nine in ten are found in each kind of line."""
    import random

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    docs, kinds = [], {}
    for i in range(240):
        kind = ("short", "middle", "long", "cjk")[i % 4]
        if kind == "cjk":
            n = rng.choice((14, 30, 60))
            line, at = cjk(n), rng.randrange(n)
            other = line[:at] + cjk(1) + line[at + 1 :]
        else:
            words = [word(rng.randint(3, 8)) for _ in range({"short": 4, "middle": 12, "long": 60}[kind])]
            line, at = " ".join(words), rng.randrange(len(words))
            words[at] = words[at][:1] + word(1) + words[at][2:] if kind == "short" else word(len(words[at]))
            other = " ".join(words)
        if line == other or edit_similarity(line, other) < linededup.SIMILARITY:
            continue
        docs += [(2 * i, line), (2 * i + 1, other)]
        kinds.setdefault(kind, []).append(2 * i)
    classes = {r["doc_id"]: r["class_ids"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind, ids in kinds.items():
        found = sum(classes[i] == classes[i + 1] for i in ids)
        assert len(ids) >= 40 and found >= 0.9 * len(ids), (kind, found, len(ids))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_against_plain_distance():
    import random

    import numpy as np

    rng = random.Random(2)
    x, y = [], []
    for _ in range(400):
        a = "".join(rng.choice("abc é漢") for _ in range(rng.choice((0, 1, 2, 9, 30, 70))))
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(("", "a", "xy", "漢"))
        x.append(a)
        y.append("".join(b) if rng.random() < 0.9 else "".join(rng.choice("abc") for _ in range(len(a))))
    most = np.array([rng.choice((0, 1, 2, 7, 9, 20, 100)) for _ in x])
    assert edits.within(x, y, most).tolist() == [plain_distance(a, b) <= m for a, b, m in zip(x, y, most)]
    assert edits.within(["a" * 70_000 + "b" * 50], ["a" * 70_000 + "c" * 50], np.array([7000])).tolist() == [True]
    assert edits.within([], [], np.zeros(0, int)).tolist() == []


def test_lines_against_all_pairs(spark):
    """Nine in ten of all pairs of lines with the similarity are in one class, and each class is held together by such pairs."""
    import numpy as np

    rows = linededup.line_classes(queries.table(spark, SF, "documents")).collect()
    texts = {r["doc_id"]: (r["text"] or "").split("\n") for r in queries.table(spark, SF, "documents").collect()}
    of = {linededup.normal_form(texts[r["doc_id"]][r["line"]]): r["class_id"] for r in rows}
    forms = sorted(of, key=len)
    size = np.array([len(f) for f in forms])
    i = np.repeat(np.arange(len(forms)), np.searchsorted(size, size / 0.9 + 1e-9, side="right") - np.arange(len(forms)))
    j = np.arange(len(i)) - np.searchsorted(i, i) + i
    i, j = i[i < j], j[i < j]
    alike = np.concatenate([edits.within([forms[p] for p in i[a : a + 4096]], [forms[p] for p in j[a : a + 4096]], ((size[j[a : a + 4096]]) * 0.1 + 1e-9).astype(int)) for a in range(0, len(i), 4096)])
    links = [(forms[p], forms[q]) for p, q in zip(i[alike], j[alike])]
    assert len(links) == 40 and sum(of[a] == of[b] for a, b in links) >= 0.9 * len(links)
    joined = H.components(forms, [(a, b) for a, b in links if of[a] == of[b]])
    assert all((joined[a] == joined[b]) == (of[a] == of[b]) for a in forms for b in forms[:200])


def test_many_equal_lines_in_one_text(spark):
    """Lines go by runs, in one pass: a text of very many equal lines keeps the first."""
    docs = spark.createDataFrame([(1, "\n".join(["same line again"] * 60_000) + "\n\nend"), (2, "same line again\nother")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert out == {1: "same line again\n\nend", 2: "other"}


def test_line_edge_rows(spark):
    docs = H.edge_docs(spark)
    out = linededup.dedup_lines(docs)
    rows = out.collect()
    assert len(rows) == 13 and set(docs.columns) <= set(out.columns)
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert of[1]["text"] is None and of[2]["text"] == "" and of[3]["text"] == " \n\t "
    assert of[10]["text"] == "a\n\nb\r\n" and of[8]["text"] == "one two"
    assert of[5]["text"] == "" and of[6]["text"] == ""  # a row without id comes first
    assert linededup.dedup_lines(H.empty_docs(spark)).count() == 0


def test_fingerprints_against_plain_python(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect())
    out = {r["doc_id"]: r for r in queries.op6_fingerprints(spark, SF).collect()}
    near = {i: [] for i in out}
    for n, (i, text) in enumerate(docs):
        edited = fingerprints.edited_text(text, docs[(n + 1) % len(docs)][1])
        assert len(edited) <= len(text) and out[i]["n_chars"] == len(text)
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if n < 20:
            a, b, c = (fingerprints.simhash(pa.array([t])) for t in (text, edited, docs[(n + 1) % len(docs)][1]))
            assert out[i]["fingerprint"] == a.tobytes().hex() and out[i]["edited_fingerprint"] == b.tobytes().hex()
            assert out[i]["near_edited"] == fingerprints._likeness(a, b)[0] and out[i]["near_next"] == fingerprints._likeness(a, c)[0]
    bits = {i: int(out[i]["fingerprint"], 16) for i in out}
    for i in out:  # the tables find all within the radius
        if i % 50 == 0:
            near[i] = [j for j in bits if (bits[i] ^ bits[j]).bit_count() <= 7]
            assert (out[i]["n_near"], out[i]["near_min_id"]) == (len(near[i]), min(near[i]))
        else:
            assert out[i]["n_near"] is None


def test_near_classes_hold_every_partner(spark, monkeypatch):
    """Against brute force over all pairs, with hot blocks and a group of edits of one text."""
    import random

    monkeypatch.setattr(buckets, "BLOCK", 8)
    rng = random.Random(6)
    prose = " ".join(f"w{rng.randrange(5000)}" for _ in range(400)).split(" ")
    docs = [(i, " ".join(prose[:k] + [f"new{i}"] + prose[k + 1 :])) for i, k in enumerate(rng.sample(range(400), 40))]
    docs += [(100 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(100))) for i in range(20)] + [(7, docs[7][1])]
    out = fingerprints.fingerprint_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    bits = {r["fingerprint"]: int(r["fingerprint"], 16) for r in out}
    links = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= fingerprints.CLASS_RADIUS]
    root = H.components(bits, links)
    ids = {}
    for r in out:
        ids.setdefault(root[r["fingerprint"]], []).append(r["doc_id"])
    assert all((r["near_class"], r["class_rows"]) == (min(ids[root[r["fingerprint"]]]), len(ids[root[r["fingerprint"]]])) for r in out)
    assert max(map(len, ids.values())) >= 36


def test_fingerprint_edge_rows(spark):
    rows = fingerprints.fingerprint_report(H.edge_docs(spark)).collect()
    assert len(rows) == 13
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"0" * 64}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert fingerprints.fingerprint_report(H.empty_docs(spark)).count() == 0
    alone = fingerprints.fingerprint_with_next(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0


def test_fingerprints_with_thousands_of_ranges(spark):
    """As many ranges as a large session has, ids that repeat or lack, and the same rows from one range."""
    texts = [(None if i % 3 == 0 else i // 2, f"text {i} " + "word " * (i % 7)) for i in range(240)] + [(None, None)] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = [sorted(tuple(r) for r in fingerprints.fingerprint_with_next(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), n).collect()) for n in (1, 3000)]
    ids = lambda rows: sorted(r[0] for r in rows)
    assert len(out[0]) == len(out[1]) == len(texts) and ids(out[0]) == ids(out[1])
    assert {r[3] for r in out[0]} == {r[3] for r in out[1]}
    single = spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    a, b = (sorted(tuple(r) for r in fingerprints.fingerprint_with_next(single, n).collect()) for n in (1, 300))
    assert a == b
    assert fingerprints.fingerprint_with_next(docs, 8).count() == len(texts)


def test_hot_place_takes_several_ranges():
    import numpy as np

    cuts = np.array([5, 9, 9, 9, 12])
    place, tie = np.array([4, 5, 9, 9, 9, 10, 12]), np.array([0, 0, -(1 << 63), 0, (1 << 63) - 1, 0, 0])
    got = fingerprints._range_numbers(cuts, place, tie).tolist()
    assert got == sorted(got) and got[0] == 0 and got[2] == 1 and got[4] == 4 and got[5] == 4 and got[6] == 5


@pytest.mark.parametrize("radius", (-1, 8))
def test_radius_is_checked(spark, radius):
    with pytest.raises(ValueError):
        fingerprints.near_counts(spark.createDataFrame([], "fingerprint string, doc_id long"), pytest, radius)


def test_hot_buckets_are_dealt_in_proportion(spark):
    """Rows of one bucket grow as its members, with sizes and without, and every pair of sizes that can be near meets once."""
    n, scratch = 20_000, Scratch(spark, "test")
    rows = spark.range(n).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), (F.col("id") % 400 + 20).cast("int").alias("size"))
    none = spark.createDataFrame([], "node long, label long")
    several = buckets.crowded(rows, scratch)
    assert buckets.blocks_across(rows.drop("size"), several, none, scratch).count() <= buckets.MOST_BLOCKS * n
    assert buckets.blocks_across(rows, several, none, scratch, 0.9).count() <= 2 * buckets.MOST_BLOCKS * n


def test_pairs_of_cells_are_those_of_the_bucket(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 16)
    scratch, size = Scratch(spark, "test"), [9 + (i * i) % 83 for i in range(300)]
    rows = spark.createDataFrame([(5, i, s) for i, s in enumerate(size)], "key long, node long, size int")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60)], "node long, label long")
    dealt = buckets.blocks_across(rows, buckets.crowded(rows, scratch), labels, scratch, 0.9)
    every = lambda payload, label: lambda x, y, bucket: __import__("numpy").arange(len(x))
    met = [tuple(r) for r in buckets.pairs_across(dealt, rows.select("node", F.lit(b"").alias("payload")), every, 0.9).collect()]
    label = [1 if 0 < i < 60 else i for i in range(300)]
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if label[i] != label[j] and min(size[i], size[j]) >= 0.9 * max(size[i], size[j]) - 1e-9}
    assert len(met) == len(set(met)) and near <= set(met)


def test_unlike_fingerprints_share_few_class_keys(spark):
    """All pairs within the radius share a key; of unlike ones, few do (before: 16 bits a key, so 48,000 pairs here)."""
    import random

    rng = random.Random(8)
    prints = [rng.getrandbits(256) for _ in range(20_000)]
    near = [p ^ sum(1 << b for b in rng.sample(range(256), fingerprints.CLASS_RADIUS)) for p in prints[:300]]
    rows = spark.createDataFrame([(i, f"{p:064x}") for i, p in enumerate(prints + near)], "node long, fingerprint string")
    held = rows.select(F.explode(F.array(*fingerprints._class_keys("fingerprint"))).alias("key"), "node")
    pairs = {tuple(r) for r in buckets.leader_pairs(held, buckets.crowded(held, Scratch(spark, "test"))).collect()}
    assert all((i, 20_000 + i) in pairs for i in range(300)) and len(pairs) < 2_000


def test_profiles_settle_unlike_lines_only():
    """Of pairs within their edits none goes; unlike lines of common words go at once, before pair by pair work."""
    import random

    import numpy as np

    rng = random.Random(5)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    x = [" ".join(rng.choice(words) for _ in range(rng.randrange(12, 60))) for _ in range(400)] + ["", "ab", "漢字é😀" * 9]
    most = np.array([len(t) // 10 for t in x])
    y = [list(t) for t in x]
    for t, n in zip(y, most):
        for _ in range(n):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(("", "a", "漢"))
    assert not edits._profiles_apart(x, ["".join(t) for t in y], most).any()
    assert edits._profiles_apart(x[:400], x[1:401], most[:400]).mean() > 0.95
