"""Decontamination, personal data, classifiers, chat formatting, packing, and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connection, same
from tests.conftest import SF
from tests.llm import helpers as H
from vocspark.llm import chat, decontamination, langid, packing, pii, quality, queries, toxicity, training


@pytest.fixture(scope="module")
def con():
    return connection(SF)


# --- decontamination
def test_contamination_equals_sql(spark, con):
    same(queries.op2_decontamination(spark, SF), con, decontamination.ORACLE_SQL)


@pytest.mark.parametrize("limit", (200_000, 0))  # broadcast, and joined by shuffle
def test_contamination_cases(spark, limit):
    items = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "x1"), ("c", "Solo Run"), (None, "one"), ("d", ""), ("e", None), ("f", "one two three four five six seven eight nine ten eleven")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [(1, "ZERO one, two three four five six seven eight nine ten eleven twelve"), (2, "one two three"), (3, "solo run x1 solo"), (4, None), (4, None), (5, "two three four five six seven eight nine ten eleven")]
    out = {r["doc_id"]: r for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, max_broadcast=limit).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in out.items()}
    assert got == {1: (13, 11, 2, sha("a,f"), True), 2: (3, 0, 0, sha(""), False), 3: (4, 3, 2, sha("b,c"), True), 4: (0, 0, 0, sha(""), False), 5: (10, 10, 2, sha("a,f"), True)}


def test_contamination_edge_rows(spark):
    bench = spark.createDataFrame([("a", H.PROSE), ("b", "漢字")], "item_id string, text string")
    rows = decontamination.contamination(H.edge_docs(spark), bench).collect()
    assert len(rows) == 13 and sum(r["contaminated"] for r in rows) == 5
    assert decontamination.contamination(H.edge_docs(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(H.empty_docs(spark), bench).count() == 0
    assert decontamination.clean(H.edge_docs(spark), bench).count() == 7


def test_clean_rows_stay_beside_contaminated_ones(spark, monkeypatch):
    """Rows without an id, or of one id: only those that hold a window themselves go, and repeated rows alike."""
    import corpus_pipeline

    bench = spark.createDataFrame([("a", H.PROSE)], "item_id string, text string")
    rows = [(None, H.PROSE), (None, "clean one"), (None, None), (7, "x " + H.PROSE), (7, "clean two"), (8, H.PROSE), (8, H.PROSE), (9, "clean three")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = sorted([(None, "clean one"), (None, None), (7, "clean two"), (9, "clean three")], key=str)
    assert left(decontamination.clean(docs, bench, whole_ids=False)) == want
    monkeypatch.setattr(queries, "table", lambda *_: bench)
    assert left(corpus_pipeline.decontaminate(spark, docs, SF)) == want


# --- personal data
def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, d: 13 <= len(d) <= 19 and _luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, r, ok in kinds for m in re.finditer(r, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii_against_brute_force(spark):
    odd = ["a@b.c_d@e.f ..x@y.z.", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1", "4539 1488 0343 6467-", "+1 (212) 555-1234 call", "é@x.y 😀 a@b.co 4539148803436467", "1" * 30_000, "1 2 " * 20_000, "a." * 20_000 + "@b.c", "a@" + "b." * 20_000 + "c", "+" * 5000 + "+1.2.3.4.5.6.7.8.9"]
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    out = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for r in docs.collect():
        want = brute_pii(r["text"])
        got = out[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k + ":") for x in want) for k in ("email", "ip", "card", "phone")]
        assert [x for x in got["spans"].split(",") if x.split(":")[0] in ("email", "ip", "card", "phone")] == want


def test_card_with_a_hyphen_between_all_digits(spark):
    text = "paid by " + "-".join("4539148803436467") + " today"
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_card"] == 1 and row["spans"] == ",".join(brute_pii(text)) == "card:8:39"


def test_pii_further_kinds_and_edges(spark):
    docs = spark.createDataFrame([(1, "pay to GB82 WEST 1234 5698 7654 32 now"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "tel: 030 123 4567"), (4, "sum 030 123 4567")], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_iban"], r["n_local"]) for r in pii.report(docs).collect()}
    assert out == {1: (1, 0), 2: (0, 0), 3: (0, 1), 4: (0, 0)}
    assert pii.report(H.edge_docs(spark)).count() == 13 and pii.report(H.empty_docs(spark)).count() == 0
    assert "pii" in pii.find(H.edge_docs(spark)).columns


# --- classifiers
def held_out_accuracy(spark, sf, out, label, column, truth_table):
    truth = {r["doc_id"]: r[label] for r in queries.table(spark, sf, truth_table).collect()}
    rows = [r for r in out.collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return np.mean([r[column] == truth[r["doc_id"]] for r in rows])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    assert held_out_accuracy(spark, sf, queries.op7_quality_classifier(spark, sf), "quality", "predicted", "labels") > 0.93
    assert held_out_accuracy(spark, sf, queries.op4_language_id(spark, sf), "lang", "lang_pred", "documents") > 0.97
    assert held_out_accuracy(spark, sf, queries.op10_toxicity(spark, sf), "toxic", "predicted", "labels") > 0.85


def test_classifier_edge_rows(spark):
    docs, labels = H.edge_docs(spark), spark.createDataFrame([(5, 1, 1), (6, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for run in (lambda d, k: quality.classify(d, k), lambda d, k: toxicity.assess(d, k)):
        for known in (labels, none):
            rows = run(docs, known).collect()
            assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert run(H.empty_docs(spark), labels).count() == 0
    rows = langid.identify(docs).collect()
    assert len(rows) == 13 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    texts = {r["text"] for r in training.labelled_sample(docs, labels, "quality", 4, 2, 500).collect()}
    assert texts == {f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert training.labelled_sample(docs, labels, "quality", 4, 2, 10).count() == 10


def test_toxicity_matching():
    m = toxicity.Matcher(toxicity.ToxicityModel({"idiot": 3.0, "trash": 2.0}, ["trash can"]))
    hit = lambda t: m.level(t) > 0
    assert hit("You IDIOT!") and hit("an 1d10t") and hit("аn іdiоt") and hit("ïdíöt") and hit("trash")
    assert not hit("idiotic") and not hit("the trash can") and not hit("") and not hit(None)
    assert m.level("idiot " + "word " * 1000) < m.level("idiot word")


def test_toxicity_folding():
    m = toxicity.Matcher(toxicity.ToxicityModel({"idiot": 3.0, "trash": 2.0}, ["trash can"]))
    hit = lambda t: m.level(t) > 0
    assert not hit("trash  can") and not hit("trash\ncan") and not hit("trash \t can") and hit("trash canister")
    assert hit("id\u200biot") and hit("i\u00addi\ufeffot") and hit("idiot5") and hit("5idiot") and hit("1d10t5!")
    assert not hit("idiot5a") and not hit("a5idiot")


def test_toxicity_against_plain_search():
    """Each place of each term looked at by itself, without an automaton."""
    import random

    rng = random.Random(8)
    model = toxicity.ToxicityModel({"bad": 1.5, "badly": 2.0, "vile rat": 3.0, "rat": 1.0}, ["not bad", "rat race"])
    matcher = toxicity.Matcher(model)
    parts = ["bad", "badly", "b4d", "not", "vile", "rat", "race", "rats", "b\u0430d", " ", " ", "\n", ".", "5", "x", "ok"]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randrange(14)))
        plain = " ".join(text.lower().translate(toxicity._FOLD).split())
        folded = plain.translate(toxicity._DIGITS)

        def places(term):
            for at in range(len(folded) - len(term) + 1):
                before, after = plain[:at].rstrip("0123456789"), plain[at + len(term) :].lstrip("0123456789")
                if folded[at : at + len(term)] == term and not before[-1:].isalpha() and not after[:1].isalpha():
                    yield at, at + len(term) - 1

        hidden = {p for e in model.exceptions for a, b in places(e) for p in range(a, b + 1)}
        total = sum(w for t, w in model.weights.items() for a, b in places(t) if not (a in hidden and b in hidden))
        assert matcher.level(text) == pytest.approx(total / np.log2(2 + folded.count(" ")) if total else 0.0), text


def test_lexicon_is_not_cut(spark):
    """All terms and exceptions that qualify are kept, however many and whatever they begin with."""
    name = lambda i: "".join(chr(97 + int(d)) for d in str(10_000 + i))
    rows = [(f"{before} q{name(i)}", 1) for i in range(1100) for before in ("ka", "ke", "ki", "ko", "ku", "ky", "la", "le", "li", "lo", "lu", "ly", "ma", "me")]
    rows += [(f"z{name(i)[:3]} q{name(i)}", 0) for i in range(1100) for _ in range(3)] + [(f"plain {name(i)}", 0) for i in range(30_000)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert {f"q{name(i)}" for i in range(1100)} <= set(model.weights)
    assert {f"z{name(i)[:3]} q{name(i)}" for i in range(1100)} <= set(model.exceptions)


def test_language_against_a_plain_kernel(spark):
    """Sets of n-grams, their kernel with the landmarks, and the regressions, one text at a time."""
    import pyarrow as pa

    texts = [r["text"] for r in queries.table(spark, SF, "documents").where("length(text) < 3000").limit(25).collect()] + ["a", "漢字 かな", "Ab"]
    model = langid.train(training.sample_by_value(queries.table(spark, SF, "documents"), "lang", 3, 1, 20))
    width = model.landmarks.shape[1]

    def grams(text):
        raw, places = H.lower_az(text).encode(), set()
        for n in langid.GRAMS:
            for at in range(len(raw) - n + 1):
                places.add(((int.from_bytes(raw[at : at + n], "big") * 2654435761 + (n * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF) >> (32 - width.bit_length() + 1))
        return places

    out = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    marks = [set(np.flatnonzero(m)) for m in model.landmarks]
    for r in out:
        own = grams(texts[r["doc_id"]])
        kernel = np.array([len(own & m) / np.sqrt(max(len(own), 1) * len(m)) for m in marks])
        margins = kernel @ model.weights * 4
        shares = np.exp(margins - margins.max())
        assert r["lang_pred"] == model.languages[int(margins.argmax())] and r["score"] == pytest.approx(float((shares / shares.sum()).max()), abs=2e-4)
    clash = spark.createDataFrame([(1, "x", "own", "a")], "doc_id long, text string, __language string, found string")
    assert langid.predict(clash, model).first().asDict().items() >= {"__language": "own", "found": "a"}.items()
    assert langid.identify(H.empty_docs(spark)).count() == 0


def test_language_sample_of_hot_ids_and_values(spark):
    rows = [(7, f"text {i}", "xx") for i in range(300)] + [(100 + i, f"other {i}", f"l{i % 3}") for i in range(300)] + [(None, "none", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = training.sample_by_value(docs, "lang", 3, 5, 20).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in drawn} == {"xx": 1, "l0": 20, "l1": 20, "l2": 20}
    few = training.sample_by_value(docs, "lang", 3, 5, 20, max_bytes=160)
    assert 0 < few.agg(F.sum(F.octet_length("text"))).first()[0] <= 160


def test_quality_against_a_plain_average(spark):
    """Each feature's number taken by itself and averaged, then the softmax of two outputs."""
    import pyarrow as pa

    from vocspark.llm import textarrays

    rng = np.random.default_rng(3)
    model = quality.QualityModel(rng.normal(size=1 << 10).astype(np.float32), -0.3, 10)
    texts = ["Word word another  word", "", "a", "ünï cödé 漢字\tx", "one two two two", " \n", "q" * 50]
    mask = (1 << 64) - 1

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ x >> shift) * factor) & mask
        return x ^ x >> 31

    def polynomial(raw):
        return sum(int(textarrays._VALUES[b]) * pow(textarrays._BASE, i, 1 << 64) for i, b in enumerate(raw)) & mask

    def features(text):
        raw = text.encode()
        hashes = [mixed(polynomial(w)) for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
        yield from (h >> 54 for h in hashes)
        yield from (mixed((a * 0x9E3779B97F4A7C15 + b) & mask) >> 54 for a, b in zip(hashes, hashes[1:]))
        for n in quality.GRAMS:
            for at in range(len(raw) - n + 1):
                yield ((int.from_bytes(bytes([n]) + raw[at : at + n], "big") * 0x9E3779B97F4A7C15) & mask) >> 54

    scores = quality.score_texts(pa.array(texts), model)
    for text, score in zip(texts, scores):
        own = [float(model.logit[f]) for f in features(text)]
        out = np.exp([0.0, (sum(own) / len(own) if own else 0.0) + model.bias])
        assert score == pytest.approx(out[1] / out.sum(), abs=2e-6)


# --- chat
def test_chat_equals_sql(spark, con):
    same(queries.op8_chat_formatting(spark, SF), con, chat.ORACLE_SQL)


def test_chat_spans_and_rewrites(spark):
    turns = [("user", chat.HOSTILE), ("assistant", "a\\b <| c\n"), ("us\ner", ""), ("assistant", "x")]
    text, spans, rewrites = chat.turn_spans(chat.chat_template, turns)
    assert not rewrites and chat.read_turns(text) == turns
    assert [chat.unescape(text[s[2] : s[3]]) for s in spans] == [t for _, t in turns]
    assert chat.turn_spans(chat.chat_template, turns * 60, whole=8)[1] == chat.turn_spans(chat.chat_template, turns * 60, whole=999)[1]
    only_last = lambda t: "".join(f"<{r}>{x if i == len(t) - 1 else '...'}" for i, (r, x) in enumerate(t))
    assert chat.turn_spans(only_last, turns)[1:] == ([], True)
    late = lambda t: chat.chat_template(t) if len(t) < 100 else "short"
    assert chat.turn_spans(late, turns * 60, whole=8)[2]
    rows = [(1, 2, "assistant", None), (1, 1, "user", "q"), (None, 1, None, None), (1, 2, "assistant", None)]
    out = chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in out} == {(1, 3, 0), (None, 1, 0)}


def test_chat_turns_are_located_in_their_own_place():
    """Headers with the turn's number, and a rewrite at one length only."""
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(130)]
    numbered = lambda t: "".join(f"<{i}:{r}>{x}</>" for i, (r, x) in enumerate(t))
    text, spans, rewrites = chat.turn_spans(numbered, turns)
    assert not rewrites and [text[s[2] : s[3]] for s in spans] == [t for _, t in turns]
    assert all(text[s[0] : s[1]] == f"<{i}:{turns[i][0]}>{turns[i][1]}</>" for i, s in enumerate(spans))
    once = lambda t: ("!" if len(t) == 97 else "") + numbered(t)
    assert chat.turn_spans(once, turns)[1:] == ([], True)


def test_chat_template_that_depends_on_the_text():
    sized = lambda t: "".join(f"{len(x)}:{x}{'*' * len(x)};" for _, x in t)
    spans = chat.turn_spans(sized, [("user", "a"), ("assistant", "long text"), ("assistant", "b")])[1]
    assert [s[4] for s in spans] == [False, False, True] and spans[1][2:4] == (None, None)


def test_chat_edge_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q", "x", "y"), (-1, 5, "user", "own", "x", "y"), (2, None, None, "", "x", "y")], "conv_id long, turn long, role string, text string, turns string, formatted string")
    out = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.format_conversations(chat.with_hostile(rows))).collect()}
    assert out == {1: 1, 2: 1, -1: 3}
    assert chat.format_conversations(rows.limit(0)).count() == 0
    assert [r["conv_id"] for r in chat.digests(chat.format_conversations(chat.with_hostile(rows.limit(0)))).collect()] == [-1]


# --- packing
def check_packing(rows, docs, tokenizer):
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(p, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    used = check_packing(rows, docs, tokenizer)
    assert used <= sum(r["length"] for r in rows) / 4096 * 1.02 + 2
    table = queries.table(spark, SF, "documents")
    assert check_packing(packing.pack_documents(table, queries.tokenizer_path(), per_shard=16).collect(), docs, tokenizer) <= used * 1.1
    odd = ["<|endoftext|>a .,b 'S don't İK ẞ ß  x́", "a b c\x1cd", "\x00 x. y,", None, "", "wörd. Straße, é."]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    check_packing(packing.pack_documents(frame, queries.tokenizer_path()).collect(), list(enumerate(odd)), tokenizer)
    assert packing.pack_documents(H.edge_docs(spark), queries.tokenizer_path()).count() >= 13
    assert packing.pack_documents(H.empty_docs(spark), queries.tokenizer_path()).count() == 0


def test_packing_of_pieces_that_never_fit_together(spark):
    """Documents of 2,100 tokens: no level gathers them in one group."""
    pieces = spark.range(20_000).selectExpr("cast(if(id % 3 = 0, null, 5) as long) as doc_id", "0 as piece", "0L as start", "2100L as length", "1L as ids_crc32")
    rows = packing.pack(pieces, per_shard=1000).collect()
    assert len({r["sequence_id"] for r in rows}) == 20_000 and all(r["offset"] == 0 for r in rows)
    groups = np.unique([r["sequence_id"] >> 32 for r in rows], return_counts=True)[1]
    assert groups.max() <= 1200
    whole = spark.range(300).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 2 = 0, 4096L, 1L) as length", "1L as ids_crc32")
    assert len({r["sequence_id"] for r in packing.pack(whole, per_shard=50).collect()}) == 151


def test_packing_levels_cost_no_sequence(spark):
    """What the share of open sequences that is packed again leaves out changes nothing here."""
    rng = np.random.default_rng(5)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 1) for i, n in enumerate(np.minimum(rng.lognormal(6, 1, 6000), 4096).clip(1))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    used = [packing.pack(pieces, per_shard=400, repack=share).select("sequence_id").distinct().count() for share in (15 / 16, 1.0)]
    assert used[0] <= used[1] + 1 and used[0] <= pieces.agg(F.sum("length")).first()[0] / 4096 * 1.01 + 2


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400)
    bins, places, used = packing.sum_of_squares(lengths, 100)
    fill = np.zeros(used, dtype=int)
    for i in np.argsort(-lengths, kind="stable"):  # each placement makes the sum smallest
        gaps = lambda f: np.bincount(100 - f[(f > 0) & (f < 100)], minlength=101)
        cost = {}
        for b in [*{100 - g: g for g in np.flatnonzero(gaps(fill)) if g >= lengths[i]}, 0]:
            after = fill.copy()
            spot = int(np.flatnonzero(fill == b)[0]) if b else int(np.argmax(fill == 0)) if (fill == 0).any() else None
            if spot is None:
                continue
            after[spot] += lengths[i]
            cost[b] = (gaps(after) ** 2).sum()
        assert places[i] == fill[bins[i]] and cost[int(fill[bins[i]])] == min(cost.values())
        fill[bins[i]] += lengths[i]
    assert used <= lengths.sum() / 100 * 1.1 + 1


# --- pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = queries.table(spark, SF, "documents")
    before = docs
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in before.collect()}
        if name == "line_dedup":  # none without text is left that had some
            had = {r["doc_id"] for r in before.where("trim(text) <> ''").collect()}
            assert not had & {r["doc_id"] for r in out.where("coalesce(trim(text), '') = ''").collect()}
        if name == "benchmark_decontamination":
            assert decontamination.contamination(out, queries.table(spark, SF, "benchmark")).where("contaminated").count() == 0
        if name == "minhash_near_dedup":
            assert neardup_clean(out)
        before = out
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert P.run(spark, SF).count() == before.count()


def test_pipeline_edge_rows(spark, monkeypatch):
    """Null, empty and repeated rows, clashing columns, and empty tables, in every stage; near copies by lines and as a whole."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id string, text string")
    monkeypatch.setattr(queries, "table", lambda _, __, name: labels if name == "labels" else bench)
    docs = H.edge_docs(spark)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == list(P.COLUMNS)
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        if name == "line_dedup":  # the texts of 5 and 6 are another row's, and nothing is left of them
            assert not {5, 6} & set(ids) and {1, 2, 3, 4, 8} <= set(ids)
        elif name == "minhash_near_dedup":
            assert {1, 2, 3, 4, 5, 8, 10} <= set(ids) and not {6, 7, 9} & set(ids)  # 9 is 5 with a few words before
        elif name == "benchmark_decontamination":
            assert len(rows) == 13
        elif name == "best_fit_packing":
            assert len({(r["doc_id"], r["piece"]) for r in rows}) >= 11


def test_line_dedup_stage_and_remnants(spark):
    import corpus_pipeline as P

    name = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    lines = [f"line {name(i)[:9]} has {name(i)[9:17]} words of its own like w{name(i)[17:25]} and v{name(i)[25:]}" for i in range(12)]  # no two are near
    texts = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "\n".join([*lines[:10], "a new one here"])), (4, "\n".join([*lines[:4], *[x.replace("own", "strange") + " differing" for x in lines[4:]]])), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in P.line_dedup(spark, docs, SF).collect()}
    assert set(out) == {1, 4, 5, 6} and out[1]["text"] == texts[0][1] and out[4]["n_chars"] == len(out[4]["text"])


def neardup_clean(docs):
    from vocspark.llm import neardup

    return neardup.near_duplicates(docs).where("not kept").count() == 0
