"""Best-fit packing of tokenised documents into training sequences (sum of squares).

Documents become token ids ended by one end id, longer ones are cut, and each piece is put
where the sum over gaps of (number of open sequences with that gap) squared becomes smallest.
Keeping those counts low and even leaves a fitting gap for whatever length comes next.

The rule looks at all open sequences, so it is sequential. It runs here in shards of a fixed
number of pieces, dealt by hash, so that no task grows with the corpus. Sequences that a shard
leaves with room go, as items of their filled length, to shards of a next level, until one shard
holds them all or a level merges fewer than one pair a shard. All rows are packed; nothing is
dropped or padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.scratch import Scratch
from vocspark.llm.textarrays import Words, row_slices, text_buffer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokens:
    """Token ids of white-space separated chunks, each chunk encoded once per worker.

    The tokenizer drops white space and never joins what it separates, so the ids of a text
    are those of its chunks in order. A full stop or comma that ends a chunk after a letter a-z
    is a pre-token of its own, and so a chunk of its own. Chunks are known by their 64-bit hash
    after lower-casing A-Z, which the tokenizer does too. At most ``limit`` are remembered. A
    tokenizer that does not encode ``SAMPLES`` so is refused.
    """

    SAMPLES = ("Ab, cd. Ef", "x.y ,z .. a,b, don't 'S", "one\ttwo\nthree\r\n four  five ", "ÄÖ é, straße. 漢字 12.5 A1. B-2, <s>", "")

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends, self.limit = ends, limit
        self.kind = np.uint16 if len(ends) <= 1 << 16 else np.uint32
        self.clear()
        for text in self.SAMPLES:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            if self.encode(raw, np.array([0, len(raw)]))[0].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"the tokenizer {path} does not work on white-space separated, lower-cased chunks")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.late_keys = np.zeros(0, dtype=np.uint64)
        self.late_at = np.zeros(0, dtype=np.int64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.kind)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        for known, at in ((self.keys, self.at), (self.late_keys, self.late_at)):
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                found[hit] = at[place[hit]]
        return found

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, flat, and the start and number of each chunk's own."""
        plain = np.array([c.isalpha() for c in chunks], dtype=bool)
        sizes = np.zeros(len(chunks), dtype=np.int64)
        flat = np.zeros(0, dtype=self.kind)
        if plain.any():
            # Letters make one pre-token, so many chunks of letters are encoded as one text
            # and cut after each token that ends a word.
            text = " ".join(c for c, p in zip(chunks, plain) if p)
            flat = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[flat]) + 1
            if len(cuts) == plain.sum():
                sizes[plain] = np.diff(cuts, prepend=0)
            else:
                plain[:], flat = False, flat[:0]
        order, parts = np.flatnonzero(plain), [flat]
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)]
            sizes[rest] = [len(x) for x in ids]
            parts.append(np.asarray([i for x in ids for i in x], dtype=self.kind))
            order = np.concatenate([order, rest])
        starts = np.zeros(len(chunks), dtype=np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts), starts, sizes

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        flat, starts, sizes = self._encode([c.decode("utf-8", "replace") for c in chunks])
        base, first = len(self.ids), len(self.sizes)
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, base + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        late = np.concatenate([self.late_keys, keys])
        at = np.concatenate([self.late_at, np.arange(first, first + len(keys))])
        whole = len(late) > 20_000 + len(self.keys) // 4
        if whole:
            late, at = np.concatenate([self.keys, late]), np.concatenate([self.at, at])
        order = np.argsort(late)
        late, at = late[order], at[order]
        if whole:
            self.keys, self.at = late, at
            late, at = late[:0], at[:0]
        self.late_keys, self.late_at = late, at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the bounds of each text."""
        words = Words(data, offsets, tails=True)
        if len(self.sizes) > self.limit:
            self.clear()
        keys, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
        at = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = words.data.tobytes()
            self._learn(keys[new], [raw[words.start[i] : words.end[i]] for i in first[new]])
            at[new] = self._find(keys[new])
        at = at[number]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends])[words.bounds]


_known: dict[str, WordTokens] = {}


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids, cut at ``capacity``.

    A null or empty text is the end id alone. The checksum is CRC-32 of the piece's ids as
    little-endian unsigned 32-bit integers. Other columns of ``docs`` are not read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _known:
            _known[tokenizer_path] = WordTokens(tokenizer_path)
        tokens = _known[tokenizer_path]
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            data, offsets = text_buffer(batch.column(1))
            for a, b in row_slices(offsets):
                flat, bounds = tokens.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out: list[tuple] = []
                for i in range(b - a):
                    own = np.append(flat[bounds[i] : bounds[i + 1]].astype("<u4"), np.uint32(end_id))
                    out += [(i, p, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(own), capacity))]
                row, *rest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.asarray(row) + a)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pieces, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each item, taken in order of falling length.

    ``n[g]`` counts the open sequences with gap g. Moving one from gap g to g - size changes the
    sum of squares by 2 * (n[g - size] - n[g] + 1), by 1 - 2 * n[g] where the gap closes, and a
    new sequence changes it by 2 * n[capacity - size] + 1. On ties the smallest gap wins, and an
    open sequence wins over a new one.
    """
    never = np.iinfo(np.int64).max
    n = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size == capacity:
            bins[i], places[i], used = used, 0, used + 1
            continue
        before = n[size:]
        change = 2 * (n[: capacity + 1 - size] - before) + 2
        change[0] = 1 - 2 * n[size]
        change[before == 0] = never
        best = int(np.argmin(change))
        fresh = 2 * int(n[capacity - size]) + 1 if size < capacity else 0
        if change[best] > fresh:
            number, gap = used, capacity
            used += 1
        else:
            gap = best + size
            number = open_[gap].pop()
            n[gap] -= 1
        bins[i], places[i] = number, capacity - gap
        if gap > size:
            open_[gap - size].append(number)
            n[gap - size] += 1
    return bins, places, used


def _in_shards(items: DataFrame, key: list[str], size: str, keep: str, shards: int, level: int, capacity: int) -> DataFrame:
    """``items`` with (sequence, offset, filled): each shard packs its own items.

    items must be a written table: the salt of the deal, which parts repeated rows too, is the place there.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        lengths = pdf[size].to_numpy()
        bins, places, used = sum_of_squares(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        return pdf.assign(sequence=bins + (level << 56 | int(pdf["shard"].iloc[0]) << 32), offset=places, filled=filled[bins]).drop(columns="shard")

    salted = items.withColumn("shard", F.monotonically_increasing_id())
    dealt = salted.withColumn("shard", F.expr(f"pmod(xxhash64({', '.join(key)}, shard), {shards})"))
    return dealt.groupBy("shard").applyInPandas(one, f"{keep}, sequence long, offset long, filled long")


def pack(pieces: DataFrame, capacity: int = 4096, per_shard: int = 8192, repack: float = 15 / 16) -> DataFrame:
    """``pieces`` with sequence_id and offset, in as few sequences of ``capacity`` as the rule finds.

    pieces has the columns of ``tokenised_pieces``; lengths are 1 to ``capacity``. Sequences
    are filled without holes from 0. Repeated rows are packed each; no rows give no rows. A shard
    has about ``per_shard`` items at every level. Sequences filled to ``repack`` of the capacity at
    most go to the next level; at 1.0 all with room do.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    pieces = scratch.keep(pieces)
    shards, level, moves = max(1, -(-pieces.count() // per_shard)), 0, []

    def left_open(packed: DataFrame) -> DataFrame:
        return scratch.keep(packed.where(f"offset = 0 and filled <= {int(repack * capacity)} and filled < {capacity}").select(F.col("sequence").alias("item"), F.col("filled").alias("size")))

    placed = scratch.keep(_in_shards(pieces, ["doc_id", "piece", "start"], "length", PIECES, shards, level, capacity))
    while shards > 1:
        items = left_open(placed if level == 0 else moves[-1])
        n = items.count()
        shards, level = max(1, -(-n // per_shard)), level + 1
        moves.append(scratch.keep(_in_shards(items, ["item"], "size", "item long, size long", shards, level, capacity)))
        if n - moves[-1].where("offset = 0").count() < shards:
            break
    for moved in moves:
        step = moved.select("item", F.col("sequence").alias("to"), F.col("offset").alias("by"))
        placed = placed.join(step, placed["sequence"] == step["item"], "left").select(*(placed[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), F.coalesce("to", "sequence").alias("sequence"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, per_shard: int = 8192, id_col: str = "doc_id", text_col: str = "text", repack: float = 15 / 16) -> DataFrame:
    """Tokenise and pack: one row per piece with its place. See ``tokenised_pieces`` and ``pack``."""
    return pack(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity, per_shard, repack)
