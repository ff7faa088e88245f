"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A block is article or not. Its features are the tags and names of the elements around it and what its
text is like; a link between neighbours depends on whether they share an element. The field is trained
here by stochastic gradient ascent of the likelihood on labelled pages (``layouts``), and the best
labels of a page are found by Viterbi.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.htmlblocks import Block, Element, leaf_blocks
from vocspark.llm.layouts import labelled_pages

WIDTH = 1 << 15
#: How neighbours stand: in one element, in neighbouring ones, or apart.
KINDS = 3
_TERMS = re.compile(r"[.!?:;\"'”»)\]…]$")
_WORDS = re.compile(r"\w+")
#: Words of blocks of at most so many are features.
FEW_WORDS = 12


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


@lru_cache(maxsize=1 << 15)
def _path_slots(path: tuple[Element, ...]) -> tuple[int, ...]:
    """Features of the elements around a block."""
    names, inner = set(), None
    for tag, words in path:
        names.add(f"in {tag}")
        for w in words:
            names |= {f"name {w}", f"part {w[:4]}"}
        if words:
            inner = words
    for w in inner or ():
        names |= {f"inner {w}", f"inner part {w[:4]}"}
    tags = [tag for tag, _ in path if tag not in ("html", "body")]
    names |= {f"tag {tags[-1]}" if tags else "bare", "tags " + ">".join(tags[-2:]), "unnamed" if inner is None else "named"}
    landmark = next((tag for tag in reversed(tags) if tag in ("article", "main", "nav", "aside", "footer", "header", "form", "section")), "none")
    names.add(f"landmark {landmark}")
    return tuple(sorted({_slot(x) for x in names}))


def _looks(block: Block) -> tuple[str, str, str]:
    """Length, share of links and tag of a block, in few values."""
    n = len(block.text)
    share = block.link_chars / n
    return f"{min(n.bit_length(), 10)}", "0" if not block.link_chars else "1" if share < 0.3 else "2" if share < 0.8 else "3", block.path[-1][0] if block.path else ""


def _text_slots(blocks: list[Block]) -> list[list[int]]:
    """Features of the blocks' texts and of their neighbours'."""
    looks = [_looks(b) for b in blocks]
    out, n, headed = [], len(blocks), False
    for i, (block, (size, links, tag)) in enumerate(zip(blocks, looks)):
        text = block.text
        names = [f"size {size}", f"links {links}", f"size links {size} {links}", f"tag size {tag} {size}", f"tag links {tag} {links}", f"place {8 * i // n}", "headed" if headed else "before heading"]
        words = _WORDS.findall(text[:200].lower()) if len(text) <= 200 else ()
        if words and len(words) <= FEW_WORDS:
            names += [f"word {w}" for w in set(words)]
        names.append("ends" if _TERMS.search(text) else "open end")
        if "," in text:
            names.append("comma")
        if "©" in text:
            names.append("copyright")
        if "|" in text or "·" in text:
            names.append("bars")
        before, after = looks[i - 1] if i else ("", "", ""), looks[i + 1] if i + 1 < n else ("", "", "")
        names += [f"before {before[0]} {before[1]}", f"after {after[0]} {after[1]}", f"before tag {before[2]} {tag}", f"after tag {after[2]} {tag}"]
        headed = headed or tag in ("h1", "h2")
        out.append([_slot(x) for x in names])
    return out


def _kinds(blocks: list[Block]) -> list[int]:
    """How each block stands to the one before; 0 for the first."""
    return [0] + [0 if a.parent == b.parent else 1 if a.grandparent == b.grandparent or a.parent == b.grandparent or a.grandparent == b.parent else 2 for a, b in zip(blocks, blocks[1:])]


@dataclass
class Field:
    """Weights of features for article, of pairs of labels by ``KINDS``, and of the first label."""

    weights: np.ndarray
    pairs: np.ndarray
    start: np.ndarray


def _messages(scores: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Chances of article for each block of some pages (padded), and the expected pairs of labels by kind."""
    pages, most = scores.shape
    gain = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead, behind = np.zeros((pages, most, 2)), np.zeros((pages, most, 2))
    ahead[:, 0] = field.start + gain[:, 0]
    for t in range(1, most):
        step = ahead[:, t - 1, :, None] + field.pairs[kinds[:, t]]
        ahead[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + gain[:, t]
    for t in range(most - 2, -1, -1):
        step = field.pairs[kinds[:, t + 1]] + (gain[:, t + 1] + behind[:, t + 1])[:, None, :]
        behind[:, t] = np.where((t + 1 < lengths)[:, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
    last = ahead[np.arange(pages), lengths - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    chance = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
    expected = np.zeros((KINDS, 2, 2))
    for t in range(1, most):
        on = t < lengths
        both = ahead[on, t - 1, :, None] + field.pairs[kinds[on, t]] + (gain[on, t] + behind[on, t])[:, None, :] - total[on, None, None]
        np.add.at(expected, kinds[on, t], np.exp(both))
    return chance, expected


def train_field(pages: list[tuple[list[Block], list[bool]]], epochs: int = 8, batch: int = 24, rate: float = 0.25, decay: float = 2e-4, seed: int = 1) -> Field:
    """A field fitted to blocks and their labels by AdaGrad steps; the pages must be few enough for one machine."""
    slots = [[(*_path_slots(b.path), *s) for b, s in zip(blocks, _text_slots(blocks))] for blocks, _ in pages]
    kinds = [_kinds(blocks) for blocks, _ in pages]
    labels = [np.array(y, dtype=np.int64) for _, y in pages]
    field = Field(np.zeros(WIDTH), np.zeros((KINDS, 2, 2)), np.zeros(2))
    past = [np.full_like(x, 1e-3) for x in (field.weights, field.pairs, field.start)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            lengths = np.array([len(labels[p]) for p in some])
            inside = np.arange(lengths.max()) < lengths[:, None]
            flat = np.concatenate([s for p in some for s in slots[p]]).astype(np.int64)
            sizes = np.array([len(s) for p in some for s in slots[p]])
            scores, kind, label = np.zeros(inside.shape), np.zeros(inside.shape, dtype=np.int64), np.zeros(inside.shape, dtype=np.int64)
            scores[inside] = np.add.reduceat(field.weights[flat], np.cumsum(sizes) - sizes)
            kind[inside] = np.concatenate([kinds[p] for p in some])
            label[inside] = np.concatenate([labels[p] for p in some])
            chance, expected = _messages(scores, kind, lengths, field)
            off = (label - chance)[inside]
            pairs, start = -expected, np.zeros(2)
            follows = inside.copy()
            follows[:, 0] = False
            where = np.nonzero(follows)
            np.add.at(pairs, (kind[where], label[where[0], where[1] - 1], label[where]), 1)
            start[1] = (label[:, 0] - chance[:, 0]).sum()
            steps = (np.bincount(flat, np.repeat(off, sizes), WIDTH), pairs, start)
            for x, step, square in zip((field.weights, field.pairs, field.start), steps, past):
                step = step - decay * len(some) * x
                square += step * step
                x += rate * step / np.sqrt(square)
    return field


def best_labels(scores: list[float], kinds: list[int], field: Field) -> list[bool]:
    """The likeliest labels of a page's blocks (Viterbi); ties go to not article."""
    pairs = field.pairs.tolist()
    no, yes = field.start.tolist()
    yes += scores[0]
    came = []
    for score, kind in zip(scores[1:], kinds[1:]):
        (nn, ny), (yn, yy) = pairs[kind]
        came.append((yes + yn > no + nn, yes + yy > no + ny))
        no, yes = max(no + nn, yes + yn), max(no + ny, yes + yy) + score
    label = yes > no
    out = [label]
    for from_no, from_yes in reversed(came):
        label = from_yes if label else from_no
        out.append(label)
    return out[::-1]


class Extractor:
    """A field ready for use: main text of one page after the other."""

    def __init__(self, field: Field):
        self.field, self.weights = field, field.weights.tolist()
        self.of_path: dict[tuple[Element, ...], float] = {}

    def _path_score(self, path: tuple[Element, ...]) -> float:
        score = self.of_path.get(path)
        if score is None:
            if len(self.of_path) > 1 << 15:
                self.of_path.clear()
            score = self.of_path[path] = sum(self.weights[s] for s in _path_slots(path))
        return score

    def labels(self, blocks: list[Block]) -> list[bool]:
        weights = self.weights
        scores = [self._path_score(b.path) + sum([weights[s] for s in slots]) for b, slots in zip(blocks, _text_slots(blocks))]
        return best_labels(scores, _kinds(blocks), self.field)

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page) if page else []
        return " ".join(b.text for b, main in zip(blocks, self.labels(blocks)) if main) if blocks else ""


#: Pages sampled for texts, the largest that are, and the pages made of them.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 300, 1 << 16, 1300


def _own_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels of a real page with one article element beside menus and footers, from its tags alone; else none."""
    inside = [any(tag == "article" for tag, _ in b.path) for b in blocks]
    outside = [any(tag in ("nav", "aside", "footer", "form", "header") for tag, _ in b.path) for b in blocks]
    if not any(inside) or all(inside) or any(i and o for i, o in zip(inside, outside)):
        return None
    numbers = [b.parent for b, i in zip(blocks, inside) if i]
    named = [any(len(words) for _, words in b.path) for b, i in zip(blocks, inside) if i]
    return None if any(named) or not numbers else inside


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES, made: int = MADE_PAGES, seed: int = 13) -> Field:
    """A field trained on pages made of the texts of ``sample`` pages (by hash of the id), and on those of them whose tags tell.

    Of the pages drawn those of at most ``SAMPLE_CHARS`` characters are read; of several with one id the least. Without
    any, a few fixed words are the texts. Ids are drawn from the narrow column first, so no task sends pages that are not used.
    """
    found = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    ids = found.select("id").where("id is not null").groupBy("id").count().orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
    drawn = found.join(F.broadcast(ids), "id").where(F.length("html") <= SAMPLE_CHARS).groupBy("id").agg(F.min("html").alias("html"))
    rows = drawn.orderBy(F.xxhash64("id"), "id")
    real = [leaf_blocks(r["html"]) for r in rows.collect()]  # a bounded sample
    texts = list(dict.fromkeys(b.text for blocks in real for b in blocks))
    shorts = [html.escape(t) for t in texts if len(t) <= 30]
    paragraphs = [html.escape(t[:600]) for t in texts if len(t) > 30]  # long ones make pages large, and look alike
    examples = []
    for page in labelled_pages(paragraphs, shorts, made, seed):
        blocks = leaf_blocks(page)
        examples.append((blocks, [b.gold for b in blocks]))
    examples += [(blocks, own) for blocks in real if blocks and (own := _own_labels(blocks))]
    return train_field([e for e in examples if e[0]])


def extract(pages: DataFrame, field: Field, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each; "" where there is none.

    A null or empty page has no text. Whole pages are read, each by itself, so repeated rows have equal
    results and an empty table stays empty. Other columns pass through; a column of the new name is
    replaced. Of the elements around a block the innermost ``htmlblocks.DEPTH`` count.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)  # as large as its table of weights, whatever the corpus

    @F.arrow_udf("string")
    def of_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        extractor = Extractor(shared.value)
        for batch in batches:
            yield pa.array([extractor.text(page.as_py()) for page in batch], pa.string())

    found = of_page(F.col(html_col).cast("string"))
    return pages.select(F.struct("*").alias("page"), found.alias("found")).select(*(F.col("page").getField(c).alias(c) for c in pages.columns if c != out), F.col("found").alias(out))


def report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page and its code points, by a field trained on these pages."""
    found = extract(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
