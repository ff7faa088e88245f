"""Benchmark passages in documents, by a prefix-filtered join of word shingles; SQL functions only.

A window is a run of ``size`` consecutive words of a benchmark item, or all words of a shorter
one. A document that holds a window holds each of its shingles, so one shingle is enough to
find it. Shingles are ordered by their number in the documents; a window with a shingle that
no document has cannot occur and goes, and each other window is joined on its rarest shingle
alone. Neighbouring windows share their rarest shingle, so a passage gives few join rows. Each
is held against the bounds of the document, then word by word against the windows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what stands between words, after A-Z have become a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows up to this number are broadcast (some 200 bytes each); more are joined by shuffle.
MAX_BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, null for none. Only A-Z are lower-cased."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(plain, BETWEEN), "")


def _shingle(at: Column, of: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(of, at + i) for i in range(n)))


def _keys(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("off"), _shingle(i, F.col("words"), n).alias("key")))


def _holds(near: Column, shift: Column):
    """Whether a window stands in ``near`` so that its anchor is at ``shift``."""

    def holds(x: Column) -> Column:
        first = shift - x["off"]
        length = F.size(x["words"])
        return F.when((first >= 0) & (first + length <= F.size(near)), F.slice(near, F.greatest(first, F.lit(0)) + 1, length) == x["words"]).otherwise(F.lit(False))

    return holds


def windows(benchmark: DataFrame, size: int, shingle: int) -> DataFrame:
    """(window, words, items, n, shingles): distinct windows with the ids of the items that have them.

    window is a number (a hash of the words), shingles has (off, key) for each place in the window.
    Items without an id or words have none.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("item is not null and size(w) > 0")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, size))
    found = items.select("item", F.explode(runs).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))
    found = found.withColumn("window", F.xxhash64("words")).withColumn("n", F.least(F.size("words"), F.lit(shingle)))
    keys = F.lit(None)
    for n in range(1, shingle + 1):
        keys = F.when(F.col("n") == n, _keys(n)).otherwise(keys)
    return found.withColumn("shingles", keys)


def _places(docs: DataFrame, n: int, size: int) -> DataFrame:
    """A row for each shingle of n words: its place, key, and the words that a window around it can cover.

    Only these words go on, and Spark cuts them out after a key has met its anchor: a long
    document with many matches is not copied with each of them.
    """
    at = docs.select("id", "hash", "w", F.posexplode("w").alias("pos", "word"))
    rest = [F.get("w", F.col("pos") + i) for i in range(1, n)]
    shift = F.least(F.col("pos"), F.lit(size - 1))
    near = F.slice("w", F.col("pos") - shift + 1, 2 * size - 1)
    return at.where(F.col("pos") <= F.size("w") - n).select("id", "hash", "pos", F.xxhash64("word", *rest).alias("key"), shift.alias("shift"), near.alias("near"))


def _row_hash() -> Column:
    """Tells rows of one doc_id, or of none, apart by their text."""
    return F.xxhash64("doc_id", "text")


def _hits(docs: DataFrame, benchmark: DataFrame, size: int, shingle: int, max_broadcast: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The rows as (doc_id, w, hash, id), the windows that occur as (id, hash, hits), if the benchmark has any, and its (window, item).

    A hit has the number of its window only, so that a window which many items share is one hit.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"), _row_hash().alias("hash"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    held = windows(benchmark, size, shingle)
    sizes = {r["n"]: r["pairs"] for r in held.groupBy("n").agg(F.sum(F.size("items")).alias("pairs")).collect()}  # at most ``shingle`` rows
    small = sum(sizes.values()) <= max_broadcast
    side = F.broadcast if small else lambda df: df
    matches = None
    for n in sorted(sizes):
        own = held.where(F.col("n") == n)
        known = own.select(F.explode("shingles.key").alias("key")).distinct()
        places = _places(base, n, size)
        counts = places.select("key").join(side(known), "key", "left_semi").groupBy("key").count()
        # Rarest shingle of each window whose shingles all occur.
        each = own.select("words", "window", F.size("shingles").alias("all"), F.explode("shingles").alias("s")).join(side(counts), F.col("s.key") == counts["key"])
        anchors = each.groupBy("words", "window", "all").agg(F.count("*").alias("seen"), F.min(F.struct("count", "key", F.col("s.off").alias("off"))).alias("rarest")).where("seen = all")
        anchors = anchors.groupBy(F.col("rarest.key").alias("key")).agg(F.collect_list(F.struct("words", "window", F.col("rarest.off").alias("off"))).alias("windows"))
        joined = places.join(side(anchors), "key")
        found = joined.select("id", "hash", "pos", F.filter("windows", _holds(F.col("near"), F.col("shift"))).alias("windows")).where("size(windows) > 0")
        found = found.select("id", "hash", F.transform("windows", lambda x: F.struct((F.col("pos") - x["off"]).alias("first"), (F.col("pos") - x["off"] + F.size(x["words"])).alias("end"), x["window"].alias("window"))).alias("hits"))
        matches = found if matches is None else matches.unionByName(found)
    return base, matches, side(held.select("window", F.explode("items").alias("item")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 3, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    n_hit counts the words inside any occurrence of a window, n_items the items with an occurring
    window. Null texts have no words. Repeated rows each have their result; an empty benchmark
    hits nothing. Other columns of either table are not read.
    """
    base, matches, items = _hits(docs, benchmark, size, shingle, max_broadcast)
    empty_sha = F.sha2(F.lit(""), 256)
    if matches is None:
        return base.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty_sha.alias("items_sha256"), F.lit(False).alias("contaminated"))
    per_doc = matches.groupBy("id", "hash").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["first"], h["end"]))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["first"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")),
        lambda s: s["n"],
    )
    per_doc = per_doc.select("id", "hash", covered.cast("long").alias("n_hit"), F.array_distinct("hits.window").alias("windows"))
    found = per_doc.select("id", "hash", "n_hit", F.explode("windows").alias("window")).join(items, "window")
    per_doc = found.groupBy("id", "hash", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return base.select("doc_id", "id", "hash", F.size("w").cast("long").alias("n_words")).join(per_doc, ["id", "hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("items", ","), 256), empty_sha).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 3, whole_ids: bool = True) -> DataFrame:
    """``docs`` without the documents that hold a window of ``benchmark``; all columns kept.

    With ``whole_ids``, rows that share a doc_id are one document and go together, as do rows
    without an id. Without it, each row is judged by its own id and text: clean rows stay,
    whatever other rows have the same id or none.
    """
    _, matches, _ = _hits(docs, benchmark, size, shingle, MAX_BROADCAST_WINDOWS)
    if matches is None:
        return docs
    hit = matches.select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    if whole_ids:
        hit = hit.select("_id").distinct()
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    same = own == hit["_id"]
    return docs.join(hit, same if whole_ids else same & (F.xxhash64(docs["doc_id"], docs["text"]) == hit["_hash"]), "left_anti")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
starts as (select item, w, least(len(w), 10) as l, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0),
win as (select distinct item, l, array_to_string(w[i:i + l - 1], ' ') as s from starts),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
runs as (select doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') as s from pos cross join (select distinct l from win) where p + l - 1 <= len(w)),
hit as (select doc_id, p, runs.l as l, item from runs join win on runs.l = win.l and runs.s = win.s),
covered as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + l)) as q from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered on d.doc_id = covered.doc_id left join items on d.doc_id = items.doc_id
"""
