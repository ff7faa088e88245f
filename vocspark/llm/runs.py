r"""Periodic runs of words: stretches that repeat a word sequence at least four times over.

A run is a stretch with smallest period q, of at least max(6, 4 q) words, that no neighbouring word
extends with period q. Runs are enumerated as maximal pairs: two places i < j that are followed by
the same l words, with different words (or an end) before and behind. At distance p = j - i they
bound a stretch of p + l words with period p that can't be extended, so every maximal pair with
p + l >= max(6, 4 p) is a run, and nothing is extended afterwards.

Pairs come from the LCP-interval tree of the text's suffixes, walked bottom-up. An interval of
value l has the places that are followed by the same l words, in text order, each in the class of
the word to its left. Where the places of a child join those of its siblings, the words behind
differ; where classes differ, so do the words before. Of the joined list only neighbours are held
against each other: was another place between those of a pair within a third of l, the stretch would
have a shorter period, and be found with it. The smaller list is looked up in the larger one, so a
text of n words takes n log n look-ups, however often it repeats.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.llm.textarrays import SPACES, Words, mix, row_slices, shingle_hashes, text_buffer

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Fewest words that the places of a pair have in common: l >= 3 p and l >= 6 - p.
LEAST_COMMON = 5
#: Bytes of a text whose words are found at once.
BLOCK = 1 << 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte and hash of each word, and the words' range for each text; a long text is cut between words."""
    if len(data) <= 4 * BLOCK:
        words = Words(data, offsets, lower=False)
        return words.start, words.end, words.hash, words.bounds
    cuts, parts = [0], []
    while cuts[-1] < len(data):
        gap = np.flatnonzero(SPACES[data[cuts[-1] + BLOCK :][:BLOCK]])
        cuts.append(cuts[-1] + BLOCK + int(gap[0]) if len(gap) else len(data))
    for a, b in zip(cuts, cuts[1:]):
        inner = offsets[(offsets > a) & (offsets < b)]
        part = Words(data[a:b], np.concatenate([[0], inner - a, [b - a]]), lower=False)
        parts.append((part.start + a, part.end + a, part.hash))
    start, end, hashes = (np.concatenate(x) for x in zip(*parts))
    return start, end, hashes, np.searchsorted(start, offsets)


def _told_apart(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that differ between texts, and which places begin a sequence of ``LEAST_COMMON`` words that their text has twice."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    with np.errstate(over="ignore"):
        own = mix(words + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.zeros(len(own), dtype=bool)
    grams = shingle_hashes(own, LEAST_COMMON)
    order = np.argsort(grams)
    twice = grams[order[1:]] == grams[order[:-1]]
    again[order[1:][twice]] = again[order[:-1][twice]] = True
    return own, again


def _suffixes(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places in the order of what follows them up to their text's end, by doubling; words are ordered by number, an end is before any."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(fresh), n))
    active, h = order[np.repeat(size > 1, size)], 1
    while len(active):
        behind = np.where(active + h < end[active], rank[np.minimum(active + h, n - 1)] + 1, 0)
        key = rank[active] * np.int64(n + 1) + behind
        sort = np.argsort(key)
        active, key = active[sort], key[sort]
        group = rank[active]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(active))
        rank[active] = group + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new, at, 0))
        size = np.diff(np.append(np.flatnonzero(fresh), len(active)))
        active = active[np.repeat(size > 1, size)]
        h *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


def _common(words: list[int], order: list[int], last: int) -> dict[int, int]:
    """For each of the places in order, how many words what follows has in common with the place before; texts have no word in common."""
    before = dict(zip(order[1:], order))
    found, length, expected = {order[0]: 0}, 0, -1
    for i in sorted(before):
        j = before[i]
        length = length - 1 if i == expected and length > LEAST_COMMON else 0  # what followed the place before, less one word
        most = last - (i if i > j else j)
        while length < most and words[i + length] == words[j + length]:
            length += 1
        found[i], expected = length, i + 1
    return found


def _joined(larger: list[int], smaller: list[int], common: int, left: list[int], found: dict[tuple[int, int], int]) -> list[int]:
    """Both lists of places as one; ``found`` gets the runs between neighbours of different lists and classes."""
    if len(smaller) > len(larger):
        larger, smaller = smaller, larger
    farthest = common // (LEAST_PERIODS - 1)
    for i in smaller:
        at = bisect_left(larger, i)
        for j in larger[max(at - 1, 0) : at + 1]:
            period = abs(i - j)
            if period <= farthest and period + common >= LEAST_WORDS and left[i] != left[j]:
                run = (min(i, j), period + common)
                found[run] = min(period, found.get(run, period))
    if len(smaller) * 16 < len(larger):
        for i in smaller:
            insort(larger, i)
        return larger
    return sorted(larger + smaller)


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of some texts, by start, then period; places count from the first text's first word.

    ``words`` are numbers, and bounds[k] to bounds[k + 1] those of text k.
    """
    own, again = _told_apart(words, bounds)
    if not again.any():
        return []
    counts = np.diff(bounds)
    wanted = np.repeat(np.add.reduceat(np.append(again, False), bounds[:-1]) * (counts > 0) > 0, counts)  # words of texts with a repetition
    place = np.flatnonzero(wanted)
    number = np.unique(own[place], return_inverse=True)[1]
    end = np.searchsorted(place, np.repeat(bounds[1:], counts)[place])
    order = _suffixes(number, end)
    order = order[again[place[order]]].tolist()
    words_, last = number.tolist(), len(number)
    common = _common(words_, order, last)
    first = np.searchsorted(place, bounds[:-1])
    left = [-1, *words_]  # the class of a place: the word before it, or none
    for k in first[counts > 0].tolist():
        left[k] = -1
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, list[int]]] = []  # intervals that are not complete: value, places

    def close() -> None:
        value, places = open_.pop()
        below, others = open_.pop()
        open_.append((below, _joined(others, places, value, left, found)))

    for at in order:
        shared = common[at]
        while len(open_) > 1 and open_[-1][0] >= shared:
            close()
        if shared < LEAST_COMMON:  # an interval of a smaller value bounds no run
            open_ = [(0, [at])]
        else:
            open_.append((shared, [at]))
    while len(open_) > 1:
        close()
    return sorted((int(place[start]), length, period) for (start, length), period in found.items())


def _kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run has after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _joined_text(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of words with one space behind each."""
    size = end - start + 1
    out, at = np.full(int(size.sum()), 32, dtype=np.uint8), 0
    for a in range(0, len(start), 1 << 16):
        some = size[a : a + (1 << 16)]
        begin = np.cumsum(some) - some
        inner = np.arange(some.sum()) - np.repeat(begin, some)
        from_ = np.repeat(start[a : a + (1 << 16)], some) + inner
        letters = inner + 1 < np.repeat(some, some)
        out[at : at + len(inner)][letters] = data[from_[letters]]
        at += len(inner)
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(texts: pa.Array) -> Iterator[tuple[list[list[tuple[int, int, int]]], list[bytes]]]:
    """Runs and collapsed text of some texts after the other."""
    data, offsets = text_buffer(texts)
    for a, b in row_slices(offsets):
        part = data[offsets[a] : offsets[b]]
        start, end, words, bounds = _words(part, offsets[a : b + 1] - offsets[a])
        found = runs_of(words, bounds)
        kept = _kept_words(len(words), found)
        own = [[] for _ in range(b - a)]
        for (at, length, period), k in zip(found, np.searchsorted(bounds, [r[0] for r in found], side="right") - 1):
            own[k].append((at - int(bounds[k]), length, period))
        text = _joined_text(part, start[kept], end[kept])
        ends = np.concatenate([[0], np.cumsum((end - start + 1) * kept)])[bounds].tolist()
        yield own, [text[x : max(x, y - 1)].tobytes() for x, y in zip(ends, ends[1:])]


def collapse_runs(docs: DataFrame, text_col: str = "text", runs_out: str = "runs", collapsed_out: str = "collapsed") -> DataFrame:
    r"""``docs`` with the periodic runs of each text's words and the text without their repetitions.

    Words are ``[^\x20\x09-\x0D]+``, numbered from 0. Runs are structs of start, length and period in
    words, by start, then period. The collapsed text has, joined by one space, the words that no run
    contains after its first period. Runs may overlap; each is found by itself. A null text, or one
    without words, has no runs and an empty collapsed text. Whole texts are read, one by one, so
    repeated rows have equal results, and an empty table stays empty. Other columns pass through;
    columns of the new names are replaced. Words are told apart by 64-bit hashes. A text is worked on
    in one task, in some 250 bytes a word if it has repetitions.
    """

    @F.arrow_udf("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    def of_text(texts: pa.Array) -> pa.Array:
        runs, collapsed = [], []
        for some, left in _collapsed(texts):
            runs += [[dict(zip(("start", "length", "period"), r)) for r in own] for own in some]
            collapsed += left
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).view(pa.string())], names=["runs", "collapsed"])

    found = docs.select(F.struct("*").alias("doc"), of_text(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("found"))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in (runs_out, collapsed_out)]
    return found.select(*kept, F.col("found.runs").alias(runs_out), F.col("found.collapsed").alias(collapsed_out))


def _tail(text: str | None, g: int) -> str | None:
    if text is None:
        return None
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return text
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return b" ".join(words[:a] + (words[a : a + p] * times)[: n - a]).decode("utf-8", "surrogatepass")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts, a tenth of them (by crc32 of doc_id) with their last words replaced by repetitions of a few.

    With h the crc32 of the id in decimal and g = floor(h / 10), rows of h % 10 = 0 have as word i >= a
    the original word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null
    id alters nothing.
    """

    @F.arrow_udf("string")
    def repeated_tail(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        return pa.array([_tail(t.as_py(), g.as_py()) for t, g in zip(texts, seeds)], pa.string())

    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    altered = F.coalesce(h % 10 == 0, F.lit(False))
    text = F.col("text").cast("string")
    tail = repeated_tail(F.when(altered, text), F.coalesce(F.floor(h / 10), F.lit(0)).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(altered, tail).otherwise(text).alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(collapsed: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``collapse_runs``.

    start to exponent_milli are of the longest run (ties: smallest start, then period), null without runs.
    """
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = collapsed.withColumn("longest", longest).select("doc_id", "runs", "collapsed", lines.alias("lines"), F.col("longest.length").alias("length"), (-F.col("longest.start")).alias("start"), (-F.col("longest.period")).alias("period"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        _sha(F.array_join("lines", "")).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
