"""Benchmark decontamination by SimHash over item-sized windows.

A document's windows of as many words as a benchmark item are fingerprinted over their
five-word shingles. Items of that size are indexed by the eight bytes of their fingerprint:
within ``RADIUS`` differing bits at least one byte differs in ``RADIUS // 8`` bits or fewer, so
looking up every byte's neighbours finds all items within the radius. The radius leaves out
a pair of the least similarity about once in 100,000. What is found is verified by the
exact weighted Jaccard similarity of the two bags of shingles.

A window of that similarity shares at least ``2 s / (1 + s)`` of its shingles with the item.
Windows with fewer shingles of any item are not fingerprinted; they could not pass.
The items are a stated set. They are numbered and written once, and held against every document
in blocks of at most ``ITEMS_A_BLOCK`` items and ``ITEM_CHARS`` characters (and one item more). Only
one block at a time is in the driver and the tasks. Of a text, a task holds the words' hashes and
works through the windows in stretches.
"""

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from sessionloom.llm.common import mix64, packed, ship
from sessionloom.operators.keys import global_position
from sessionloom.sources.scratch import save_scratch

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
ITEMS_A_BLOCK = 4_096
ITEM_CHARS = 64 << 20  # of a block's texts
STRETCH = 4_096  # windows fingerprinted at once, or as many as a window has shingles
CHUNK = 1 << 20  # characters whose words are hashed at once
_WORDS = re.compile(r"\w+")
_GAP = re.compile(r"\W")
_SIEVE = 22  # bits of the first look-up


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word in lower case, equal within one process only; the words themselves are not kept."""
    text, out, at = text.lower(), [], 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        words = _WORDS.findall(text, at, end)
        out.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every shingle from those of the words. Fewer words are one shingle, no words none."""
    if not len(w):
        return w
    size = min(size, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += w[k : len(w) - size + 1 + k]
    return mix64(out)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)


def _prints(ones: np.ndarray, size: int) -> np.ndarray:
    """Bytes of the fingerprints from the numbers of ones among ``size`` hashes."""
    return np.packbits(2 * ones > size, axis=1)


def _near_bytes(most: int) -> np.ndarray:
    values = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(values[:, None] ^ values[None, :]) <= most


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Items:
    """Index over a block of benchmark items, built in the process that uses it."""

    def __init__(self, items: list[tuple[object, str]], least: float, radius: int):
        self.least, self.radius, self.share = least, radius, 2 * least / (1 + least)
        by_size: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            words = word_hashes(text)
            if len(words):
                by_size.setdefault((len(words), min(SHINGLE, len(words))), []).append((item_id, shingles(words)))
        near = _near_bytes(radius // 8)
        self.sizes = []  # (words of a shingle, shingles of a window, ids, bags, fingerprints, items by byte and value)
        known: dict[int, list] = {}
        for (length, size), own in sorted(by_size.items()):
            prints = np.concatenate([_prints(_bits(h).sum(0, dtype=np.int64)[None], len(h)) for _, h in own])
            table = near[:, prints.T].transpose(1, 0, 2)  # byte, value, item
            self.sizes.append((size, length - size + 1, [i for i, _ in own], [Counter(h.tolist()) for _, h in own], prints, table))
            known.setdefault(size, []).extend(h for _, h in own)
        self.known = {}
        for size, hashes in known.items():
            all_of = np.unique(np.concatenate(hashes))
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[all_of >> np.uint64(64 - _SIEVE)] = True
            self.known[size] = all_of, sieve

    def _shared(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Which shingles some item has."""
        known, sieve = self.known[size]
        shared = sieve[hashes >> np.uint64(64 - _SIEVE)]
        some = np.flatnonzero(shared)
        place = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        shared[some] = known[place] == hashes[some]
        return shared

    def hits(self, text: str) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first word, words) of the most similar window of every item that has one."""
        words = word_hashes(text)
        found: dict[object, tuple[float, int, int]] = {}
        of_size = {}
        for size, width, ids, bags, prints, table in self.sizes:
            if len(words) < size:
                continue
            if size not in of_size:
                hashes = shingles(words, size)
                shared = self._shared(hashes, size)
                of_size[size] = hashes, np.concatenate(([0], np.cumsum(shared, dtype=np.int32)), dtype=np.int32) if shared.any() else None
            hashes, count = of_size[size]
            if count is None:
                continue
            width = min(width, len(hashes))
            enough = count[width:] - count[:-width] >= ceil(self.share * width - 1e-9)
            starts = np.flatnonzero(enough)
            step = max(STRETCH, width)
            for here in np.split(starts, np.flatnonzero(np.diff(starts // step)) + 1):
                if len(here):
                    self._verify(found, here, hashes, width, size, ids, bags, prints, table)
        return [(item, *hit) for item, hit in found.items()]


    def _verify(self, found, starts, hashes, width, size, ids, bags, prints, table) -> None:
        """Enter the windows at ``starts``, which are near each other, that are similar to an item."""
        low, high = starts[0], starts[-1] + width
        ones = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(_bits(hashes[low:high]), axis=0, dtype=np.int32, out=ones[1:])
        windows = _prints(ones[starts - low + width] - ones[starts - low], width)
        candidate = reduce(np.logical_or, (table[b][windows[:, b]] for b in range(8)))
        w, i = np.nonzero(candidate)
        apart = np.bitwise_count(windows[w] ^ prints[i]).sum(1, dtype=np.int64)
        for k, item in zip(w[apart <= self.radius].tolist(), i[apart <= self.radius].tolist(), strict=True):
            start = int(starts[k])
            alike = similarity(Counter(hashes[start : start + width].tolist()), bags[item])
            if alike >= self.least and alike > found.get(ids[item], (0.0,))[0]:
                found[ids[item]] = alike, start, width + size - 1


def _spans(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Where the words of these numbers stand; those beyond the last word, where that stands."""
    out, last = {}, (0, 0)
    for number, word in enumerate(_WORDS.finditer(text)):
        last = word.span()
        if number in wanted:
            out[number] = last
    return {number: out.get(number, last) for number in wanted}


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct items with a text in blocks bounded in number and characters; the driver sees the blocks' numbers."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    placed = global_position(items, ["item_id", "text"], "_at").withColumn("_some", F.floor((F.col("_at") - 1) / ITEMS_A_BLOCK))
    before = F.sum(F.length("text")).over(Window.partitionBy("_some").orderBy("_at"))
    saved = save_scratch(placed.withColumn("_part", F.floor(before / ITEM_CHARS)), "items")
    numbers = saved.select("_some", "_part").distinct().orderBy("_some", "_part").collect() or [(0, 0)]
    return [saved.where((F.col("_some") == some) & (F.col("_part") == part)).orderBy("_at").select("item_id", "text") for some, part in numbers]


def _with_hits(
    docs: DataFrame, block: DataFrame, kept: str, least: float, radius: int
) -> tuple[DataFrame, Broadcast]:
    """``kept`` and ``hits``, an array of (item_id, similarity, start, end), of every row of ``docs (kept, text)``; the block to let go of."""
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])
    item_kind = block.schema["item_id"].dataType.simpleString()
    kind = docs.schema[kept].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, least, radius)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                hits = items.hits(text)
                if hits:
                    # lower case may split words otherwise in rare scripts; the last word then ends the span
                    at = _spans(text, {n for _, _, a, size in hits for n in (a, a + size - 1)})
                    hits = [{"item_id": i, "similarity": s, "start": at[a][0], "end": at[a + n - 1][1]} for i, s, a, n in hits]
                rows.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(kept), pa.array(rows, hit_type)], [kept, "hits"])

    hit = f"struct<item_id: {item_kind}, similarity: double, start: int, end: int>"
    item_type = pa.string() if item_kind == "string" else pa.int32() if item_kind == "int" else pa.int64()
    hit_type = pa.list_(pa.struct([("item_id", item_type), ("similarity", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    return docs.select(kept, "text").mapInArrow(find, f"`{kept}` {kind}, hits array<{hit}>"), shared


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, similarity, start, end`` of every document and benchmark item it contains.

    docs: ``doc_id, text``; benchmark: ``item_id, text``. Words are runs of letters, digits and
    underscores in lower case. start and end are code points of the most similar window, the
    first of equals. A document shorter than an item is one window. Items of fewer words than a
    shingle match the same words only; items without words, and null texts on either side,
    match nothing; so does an empty table. Texts of any length are read whole. Repeated documents give repeated rows,
    repeated items one. Other columns are not read. With several blocks what a block finds is
    written before the next is read.
    """
    ship(docs.sparkSession)
    blocks, found = _blocks(benchmark), []
    for block in blocks:
        hits, shared = _with_hits(docs.select("doc_id", "text"), block, "doc_id", least, radius)
        hits = hits.select("doc_id", F.inline("hits"))
        if len(blocks) > 1:
            hits = save_scratch(hits, "leaks")
            shared.destroy()
        found.append(hits)
    return reduce(DataFrame.union, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs``, all columns kept, that contain no benchmark item; cases as in ``leaks``."""
    ship(docs.sparkSession)
    blocks, rows = _blocks(benchmark), docs
    for block in blocks:
        found, shared = _with_hits(packed(rows, ["text"]), block, "row", least, radius)
        rows = found.where(F.size("hits") == 0).select("row.*")
        if len(blocks) > 1:
            rows = save_scratch(rows, "clean")
            shared.destroy()
    return rows
