"""Rows that operators must bear, and brute-force versions of what they compute."""

import re

LONG = "lorem ipsum dolor sit amet consectetur " * 5000
PROSE = "the quick brown fox jumps over the lazy dog while nine small birds watch from a tall old oak near the quiet river bank"
CLASH = "node, row, hash, id, w, pos, key, score, kept, label, sig, place, bucket, lent, lines, shard, fingerprint, held_out, lang_pred, _lines, pii, line, print".split(", ")


def edge_docs(spark):
    """Null, empty, blank, long, repeated and id-less documents, with columns whose names operators use themselves."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PROSE), (6, PROSE), (7, PROSE + " today"), (8, "one two"), (8, "one two"), (None, PROSE), (None, None), (9, "Ünïcode Straße 漢字 😀 " + PROSE), (10, "a\n\na\nb\r\nA!\n")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASH)) for i, t in texts], schema)


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
