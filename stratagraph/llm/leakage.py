"""Evaluation passages in training text: SimHash windows, multi-index Hamming search, exact verification.

A fingerprint of a whole item cannot show a leak of two fifths of it, so items and documents are both cut into
windows of ``WINDOW`` words at every place. One changed word moves 12 of the 64 bits of such a window on average
(3/16 of them), and 44 % of the windows with one changed word stay within ``RADIUS``, so a passage in which every
fifth or even fourth word is changed still shows itself by some of its windows. Fingerprints within RADIUS bits
differ in at most ``FLIPS`` bits in one of the ``BLOCKS`` blocks; every item window is listed under all values that
near to its own, so that one look-up a block finds all of them. A document and an item with ``HITS`` hits at one
distance from each other (a passage of eight unchanged words has four) are then verified exactly by aligned
shingles, each weighing the words it newly covers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.words import Hasher, plain_words
from stratagraph.session import Scratch, spread

WINDOW, RADIUS, BLOCKS, FLIPS = 5, 11, 4, 2
BLOCK_BITS = 64 // BLOCKS
assert RADIUS < BLOCKS * (FLIPS + 1)
SHINGLE, PASSAGE, GAP, HITS = 3, 8, 2, 3
#: Words of items indexed at once, at some 2 KB a word: the bound of what is sent to the executors; more items go in further passes.
INDEX_WORDS = 50_000
#: Words fingerprinted at once, and pairs of equal shingles aligned at once.
STRETCH, ALIGNED = 3_000, 2_000_000
FOUND = "doc_id bigint, item_id bigint, share double"


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every ``window`` consecutive words; a text shorter than that has none."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, STRETCH):
        part = np.ascontiguousarray(hashes[a : min(n, a + STRETCH) + window - 1])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        ones = sums[window:] - sums[:-window]
        out[a : a + STRETCH] = np.packbits(2 * ones > window, axis=1).view(np.uint64).ravel()
    return out


def _near_values() -> np.ndarray:
    """The patterns of at most FLIPS set bits of a block."""
    return np.array([sum(1 << i for i in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)], np.int64)


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


@dataclass
class ItemIndex:
    """The items of one pass: word hashes, window fingerprints with their item and place, and a table per block.

    ``short`` holds the items of fewer than WINDOW words by their size and their one, item-sized fingerprint.
    """

    ids: list[int]
    words: list[np.ndarray]
    prints: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    starts: list[np.ndarray]
    members: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    @classmethod
    def build(cls, ids: list[int], words: list[np.ndarray]) -> ItemIndex:
        per = [fingerprints(w) for w in words]
        prints = np.concatenate([*per, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(p) for p in per])
        place = np.concatenate([*[np.arange(len(p), dtype=np.int64) for p in per], np.empty(0, np.int64)])
        flips, starts, members = _near_values(), [], []
        for b in range(BLOCKS):
            value = (_block(prints, b)[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(value, kind="stable")
            starts.append(np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))
            members.append((order // len(flips)).astype(np.int32))
        short = {}
        for size in sorted({len(w) for w in words if 0 < len(w) < WINDOW}):
            who = np.array([i for i, w in enumerate(words) if len(w) == size])
            code = np.array([_joined(words[i], size)[0] for i in who], np.uint64)
            order = np.argsort(code, kind="stable")
            short[size] = (code[order], who[order])
        return cls(ids, words, prints, owner, place, starts, members, short)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, item window) for every fingerprint pair within the radius, each once."""
        pair = [np.empty(0, np.int64)]
        for b in range(BLOCKS):
            value = _block(prints, b)
            where, other = _expand(self.starts[b][value], self.starts[b][value + 1], self.members[b])
            near = np.bitwise_count(prints[where] ^ self.prints[other]) <= RADIUS
            pair.append(where[near].astype(np.int64) << 32 | other[near])
        once = np.unique(np.concatenate(pair))
        return once >> 32, once & 0xFFFFFFFF

    def exact(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``words``, item) of the items of fewer than WINDOW words that stand there as a whole."""
        at, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, (codes, who) in self.short.items():
            code = _joined(words, size)
            where, other = _expand(np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right"), np.arange(len(who)))
            at.append(where)
            item.append(who[other])
        return np.concatenate(at), np.concatenate(item)


def _expand(first: np.ndarray, stop: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) for every member of the span [first, stop) of every row."""
    many = stop - first
    hit = np.flatnonzero(many)
    reps = many[hit]
    ends = np.cumsum(reps)
    # half-size integers, as these arrays are long and short-lived
    base = (first[hit] - (ends - reps)).astype(np.int32)
    return np.repeat(hit.astype(np.int32), reps), members[np.repeat(base, reps) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


def _joined(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` consecutive words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Shingles:
    """The shingles of an item by sorted hashes."""

    def __init__(self, item: np.ndarray) -> None:
        self.n, self.size = len(item), min(SHINGLE, len(item))
        codes = _joined(item, self.size)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def covered(self, theirs: np.ndarray, least: float = 0.0) -> float:
        """Share of the item's words in passages that follow its wording, of a document with the shingles ``theirs``.

        Equal shingles are chained along a diagonal over gaps of at most GAP changed words; a chain that spans
        PASSAGE words or more is a passage. An item of fewer words has to stand there as a whole. Shingles are
        aligned in stretches that overlap by more than a passage. Shares that the number of equal shingles shows
        to be under ``least`` come out as 0.
        """
        first, stop = np.searchsorted(self.codes, theirs, "left"), np.searchsorted(self.codes, theirs, "right")
        ends, n = np.cumsum(stop - first), self.n
        if not len(ends) or ends[-1] * (self.size + GAP) < least * n:
            return 0.0
        edge, a = np.zeros(n + 1, np.int64), 0
        while a < len(theirs):
            z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ALIGNED, "right"))
            z = min(len(theirs), max(z, a + 8 * PASSAGE))
            q, p = _expand(first[a:z], stop[a:z], self.order)
            if len(p):
                by = np.lexsort((p, q - p))
                p, q = p[by], q[by]
                new = np.ones(len(p), bool)
                np.logical_or(np.diff(q - p) != 0, np.diff(p) > self.size + GAP, out=new[1:])
                new = np.flatnonzero(new)
                last = np.append(new[1:], len(p)) - 1
                begin, end = p[new], p[last] + self.size
                long = end - begin >= min(PASSAGE, n)
                if n < PASSAGE:  # a chain over gaps would not be the whole
                    long &= last - new == n - self.size
                np.add.at(edge, begin[long], 1)
                np.add.at(edge, end[long], -1)
            if z == len(theirs):
                break
            a = z - 4 * PASSAGE
        return float((np.cumsum(edge)[:n] > 0).mean())


def covered_share(item: np.ndarray, doc: np.ndarray) -> float:
    """``Shingles.covered`` of the word hashes of an item and a document; 0 for empty ones."""
    return Shingles(item).covered(_joined(doc, min(SHINGLE, len(item)))) if len(item) else 0.0


def _search(index: ItemIndex, least: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items, sizes = Hasher(), {}, index.sizes
        for batch in batches:
            found, a = [], 0
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            while a < len(ids):  # texts are fingerprinted together, up to STRETCH words
                docs, first, size = [], a, 0
                while a < len(ids) and size < STRETCH:
                    docs.append(hasher(plain_words(texts[a].as_py())))
                    size += len(docs[-1])
                    a += 1
                whole = np.concatenate(docs)
                ends = np.cumsum([len(w) for w in docs])
                begin = ends - [len(w) for w in docs]
                lines, pairs = [], [np.empty(0, np.int64)]
                for part in range(0, len(whole), STRETCH):
                    words = whole[part : part + STRETCH + WINDOW - 1]
                    at, window = index.candidates(fingerprints(words))
                    doc = np.searchsorted(ends, part + at, "right")
                    inside = part + at + WINDOW <= ends[doc]
                    # (document, item, distance of the places); a distance that wraps around only adds hits
                    lines.append((doc << 43 | index.owner[window].astype(np.int64) << 26 | (part + at - begin[doc] - index.place[window]) & (1 << 26) - 1)[inside])
                    at, item = index.exact(words)
                    doc = np.searchsorted(ends, part + at, "right")
                    inside = part + at + sizes[item] <= ends[doc]
                    pairs.append((doc << 17 | item)[inside])
                line, hits = np.unique(np.concatenate([*lines, np.empty(0, np.int64)]), return_counts=True)
                item = (line >> 26) & (1 << 17) - 1
                pairs.append(line[hits >= np.minimum(HITS, sizes[item] - WINDOW + 1)] >> 26)
                here, theirs = -1, None
                for pair in np.unique(np.concatenate(pairs)).tolist():
                    d, i = pair >> 17, pair & (1 << 17) - 1
                    if d != here:
                        here, theirs = d, _joined(docs[d], SHINGLE)
                    item = items.get(i)
                    if item is None:
                        item = items[i] = Shingles(index.words[i])
                    share = item.covered(theirs if item.size == SHINGLE else _joined(docs[d], item.size), least)
                    if share >= least:
                        found.append((ids[first + d], index.ids[i], share))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], schema.field(k).type) for k in range(3)], schema=schema)

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``least`` of an item's words in passages.

    Null and blank texts on either side give nothing; an item of fewer than PASSAGE words is reported where it
    stands as a whole, word by word. Repeated rows are reported once per (doc_id, item_id). The items are read in
    passes of INDEX_WORDS words, of which the driver holds one at a time; documents are scanned once per pass and
    not shuffled (but for a table of fewer splits than cores), whatever repository or source holds most of them.
    """
    texts = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND trim(text) != ''").select("doc_id", "text"))
    scratch, hasher, out, ids, words, size = Scratch(docs.sparkSession, "leakage"), Hasher(), None, [], [], 0
    add = lambda part: part if out is None else out.unionByName(part)
    scan = lambda: texts.mapInArrow(_search(ItemIndex.build(ids, words), least), FOUND)
    for row in items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        w = hasher(plain_words(row["text"]))
        if size and size + len(w) > INDEX_WORDS:
            out = add(scratch.write(scan(), "pass"))
            ids, words, size = [], [], 0
        if len(w):
            ids.append(row["item_id"])
            words.append(w)
            size += len(w)
    if ids:
        out = add(scan())
    if out is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
