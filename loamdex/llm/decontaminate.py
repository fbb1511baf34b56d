"""Benchmark decontamination by SimHash over item-sized windows.

An item of L words is compared with every window of L words of a document (with the whole document, if that is
shorter).  Both have a 64-bit SimHash of their weighted shingles (``words`` words each; the weight is how often a
shingle stands there).  Fingerprints within RADIUS bits are found by a multi-index: cut into BLOCKS blocks, two such
fingerprints agree up to RADIUS // BLOCKS bits in one block at least, so probing all block values that near finds them
all.  Candidates are verified by exact weighted Jaccard similarity, sum of minima over sum of maxima of the weights.

Before fingerprints are made, windows are skipped that can't reach the threshold: the similarity is at most the share
of a window's shingles that stand in some item of its length.  That bound loses nothing, and nearly all windows of
clean text fall under it.

At a similarity of 0.8 two fingerprints differ in 9.7 bits on average, with a standard error of 2.9; RADIUS is 3.2 of
these above that.

Equal items are one item; the result names each.  The documents are read once: a bit table of all items' shingles (at
most 2**FILTER_BITS bits, whatever the size of the benchmark) tells which documents hold, in a window as long as the
longest item, as many of them as the shortest item needs, and only these are written and compared.  Items are then dealt in blocks of at most ITEM_BYTES of
text (a longer item is a block of its own); each block is broadcast, compared with the written documents and freed
before the next.

Nulls and odd cases: a null or word-free text or item matches nothing.  An item with fewer words than a shingle is one
shingle of all its words.  A row or item without id takes part; its id in the result is null.  Repeated items and rows
give a row each.  Empty tables give an empty result.  Texts that are leaks all through take about 40 bytes a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.words import mix, shingle_numbers, slices, tidy, word_numbers
from loamdex.llm.work import removed, shared_dir, written

RADIUS, BLOCKS = 19, 4
ITEM_BYTES = 8 << 20
#: Bits of the table of shingles: SPARSE for each shingle of the items, but no more than 2**FILTER_BITS.
FILTER_BITS, SPARSE = 27, 4096
SCHEMA = "doc long, item string, similarity double, start_word long, n_words int, start_byte long, passage string, text_md5 string"

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BITS = 64 // BLOCKS
_MASK = np.uint64(2**_BITS - 1)
_NEAR = np.array([sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(_BITS), n)], np.uint64)
_COUNT = np.array([bin(x).count("1") for x in range(2**16)], np.uint8)
_PRESENT = 22  # bits of the address in the table of block values that occur


def _window_fingerprints(shingles: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Fingerprints of the windows of w shingles at some places, bit by bit."""
    out = np.zeros(len(starts), np.uint64)
    sums = np.zeros(len(shingles) + 1, np.int32)
    for bit in range(64):
        np.cumsum((shingles >> np.uint64(bit) & np.uint64(1)).astype(np.int32), out=sums[1:])
        out |= (2 * (sums[starts + w] - sums[starts]) > w).astype(np.uint64) << np.uint64(bit)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which two arrays of fingerprints differ."""
    return _COUNT[np.ascontiguousarray(a ^ b).view(np.uint16).reshape(-1, 4)].sum(1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(both)), np.bincount(at[len(a) :], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Items:
    """A block of benchmark items, indexed."""

    def __init__(self, ids: list, texts: list, k: int) -> None:
        numbers, begins, _, _ = word_numbers(pa.array(texts, pa.string()))
        length = np.diff(begins)
        self.k, self.ids, self.shingles = k, [], []
        sizes, prints = [], []
        for r in np.flatnonzero(length):
            own = numbers[begins[r] : begins[r + 1]]
            own, _ = shingle_numbers(own, np.array([0, len(own)]), min(k, len(own)))
            self.ids.append(ids[r])
            self.shingles.append(own)
            sizes.append(length[r])
            prints.append(_window_fingerprints(own, np.zeros(1, np.int64), len(own))[0])
        self.sizes, self.prints = np.array(sizes, np.int64), np.array(prints, np.uint64)
        self.ks = sorted({min(k, int(n)) for n in self.sizes})
        # which shingles occur in items of which length
        keys = [np.unique(np.concatenate([self.shingles[i] for i in np.flatnonzero(self.sizes == n)])) for n in np.unique(self.sizes)]
        every, lens = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.repeat(np.unique(self.sizes), np.array([len(x) for x in keys], np.int64))
        order = np.argsort(every, kind="stable")
        self.known, first = np.unique(every[order], return_index=True)
        self.known_at, self.known_lens = np.append(first, len(every)), lens[order]
        self.filter = np.zeros(2**20, bool)
        self.filter[self.known & np.uint64(2**20 - 1)] = True
        # block values -> items
        keys = [self._keys(self.sizes, b, self.prints >> np.uint64(b * _BITS) & _MASK) for b in range(BLOCKS)]
        self.slots = [np.argsort(x, kind="stable") for x in keys]
        self.keys = [x[o] for x, o in zip(keys, self.slots, strict=True)]
        self.present = np.zeros(2**_PRESENT, bool)
        for x in keys:
            self.present[x >> np.uint64(64 - _PRESENT)] = True

    @staticmethod
    def _keys(size: np.ndarray, block: int, value: np.ndarray) -> np.ndarray:
        return mix((np.asarray(size, np.uint64) * np.uint64(BLOCKS) + np.uint64(block) << np.uint64(16)) + value)

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in prints, item) for all items of the size within RADIUS."""
        found = set()
        for b in range(BLOCKS):
            values, of = np.unique(prints >> np.uint64(b * _BITS) & _MASK, return_inverse=True)
            for v, value in enumerate(values):
                keys = self._keys(size, b, value ^ _NEAR)
                keys = keys[self.present[keys >> np.uint64(64 - _PRESENT)]]
                lo, hi = np.searchsorted(self.keys[b], keys, "left"), np.searchsorted(self.keys[b], keys, "right")
                items = [self.slots[b][x] for l, h in zip(lo, hi, strict=True) for x in range(l, h)]
                items = [i for i in items if self.sizes[i] == size]
                found |= {(p, i) for p in np.flatnonzero(of == v) for i in items}
        if found:
            at, items = map(np.array, zip(*sorted(found), strict=True))
            near = distance(prints[at], self.prints[items]) <= RADIUS
            yield from zip(at[near].tolist(), items[near].tolist(), strict=True)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that occur in items."""
        at = np.flatnonzero(self.filter[shingles & np.uint64(2**20 - 1)])
        if not len(at) or not len(self.known):
            return at[:0]
        return at[self.known[np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)] == shingles[at]]

    def leaks(self, own: np.ndarray, hits: np.ndarray, k: int, least: float) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of the best window of a document. own: its k-word shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        at = np.searchsorted(self.known, own[hits])
        lens = [self.known_lens[self.known_at[x] : self.known_at[x + 1]] for x in at]
        places, lens = np.repeat(hits, [len(x) for x in lens]), np.concatenate(lens)
        for size in np.unique(lens).tolist():
            if min(self.k, size) != k:
                continue
            w = min(size - k + 1, len(own))
            marks = np.zeros(len(own) + 1, np.int32)
            marks[places[lens == size] + 1] = 1
            marks = np.cumsum(marks)
            start = np.flatnonzero(marks[w:] - marks[:-w] >= least * (size - k + 1) - 1e-9)
            for run in np.split(start, np.flatnonzero(np.diff(start) > w) + 1) if len(start) else []:
                prints = _window_fingerprints(own[run[0] : run[-1] + w], run - run[0], w)
                for p, item in self.near(size, prints):
                    s = similarity(own[run[p] : run[p] + w], self.shingles[item])
                    if s >= least - 1e-12 and (item not in best or s > best[item][0]):
                        best[item] = (s, int(run[p]), min(size, w + k - 1))
        return best


def _search(items, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Items = items.value
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                numbers, begins, starts, offsets = word_numbers(batch.column(1))
                ids, md5 = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out = []
                for k in index.ks:
                    shingles, at = shingle_numbers(numbers, begins, k)
                    hits = index.hits(shingles)
                    row = np.searchsorted(at, hits, "right") - 1
                    for r in np.unique(row).tolist():
                        if begins[r + 1] - begins[r] < k:
                            continue
                        own = shingles[at[r] : at[r + 1]]
                        for item, (s, first, n) in sorted(index.leaks(own, hits[row == r] - at[r], k, least).items()):
                            w = begins[r] + first
                            data = batch.column(1)[r].as_py().encode()
                            lo, last = int(starts[w] - offsets[r]), int(starts[w + n - 1] - offsets[r])
                            out.append((ids[r], index.ids[item], s, first, n, lo, data[lo : _WORD.match(data, last).end()].decode(), md5[r]))
                if out:
                    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _marked(k: int, bits: int):
    """Items' texts -> (part, bits): a task's shingles in the parts of the bit table."""
    part = min(bits, 1 << 20) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for whole in batches:
            for batch in slices(whole, 0):
                for own in _item_shingles(batch.column(0), k):
                    at = own & np.uint64(bits - 1)
                    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for p in range(len(table) // part):
            own = table[p * part : (p + 1) * part]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])

    return run


def _joined(rows: pa.Table) -> pa.Table:
    """One part of the bit table from all tasks."""
    total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("bits")])
    return pa.table({"part": rows.column("part")[:1], "bits": pa.array([total.tobytes()], pa.binary())})


def _item_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's shingles; a text with fewer words is one."""
    numbers, begins, _, _ = word_numbers(column)
    for r in range(len(column)):
        own = numbers[begins[r] : begins[r + 1]]
        if len(own):
            yield shingle_numbers(own, np.array([0, len(own)]), min(k, len(own)))[0]


def _measured(k: int):
    """Items' texts -> a task's sizes of shingles that occur, with the fewest and most shingles of an item, and those of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int, int]] = {}
        for whole in batches:
            for batch in slices(whole, 0):
                _, begins, _, _ = word_numbers(batch.column(0))
                for n in np.diff(begins).tolist():
                    if n:
                        size, many = min(k, n), n - min(k, n) + 1
                        least, most, total = found.get(size, (many, many, 0))
                        found[size] = (min(least, many), max(most, many), total + many)
        if found:
            yield pa.RecordBatch.from_pydict({"size": pa.array(list(found), pa.int32()), **{name: pa.array([x[i] for x in found.values()], pa.int64()) for i, name in enumerate(("least", "most", "total"))}})

    return run


def _suspects(table, bits: int, needed: dict[int, tuple[int, int]]):
    """(doc, text, text_md5) -> the rows in which some window holds as many marked shingles as some item needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: np.ndarray = table.value
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                numbers, begins, _, _ = word_numbers(batch.column(1))
                keep = np.zeros(batch.num_rows, bool)
                for k, (least, most) in needed.items():
                    shingles, at = shingle_numbers(numbers, begins, k)
                    place = shingles & np.uint64(bits - 1)
                    hit = marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)
                    until = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                    ends = np.minimum(np.arange(len(hit)) + most, np.repeat(at[1:], np.diff(at)))
                    rows = np.repeat(np.arange(batch.num_rows), np.diff(at))[until[ends] - until[:-1] >= least]
                    keep[rows] |= (np.diff(begins) >= k)[rows]
                if keep.any():
                    yield batch.filter(pa.array(keep))

    return run


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item whose best window reaches the similarity: ids, similarity, the window's first word, words and first byte
    in the text, the passage itself, and the text's md5."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    named = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    named = named.select("id", "text", F.md5("text").alias("name"))
    once = written(named.groupBy("name").agg(F.first("text").alias("text")), "items", place)
    sizes = once.select("text").mapInArrow(_measured(words), "size int, least long, most long, total long").groupBy("size").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total")).collect()
    # so many of an item's shingles stand in any window, or shorter document, that reaches the similarity
    needed = {r["size"]: (max(1, math.ceil(percent * r["least"] / 100 - 1e-9)), r["most"]) for r in sizes}
    bits = 1 << min(FILTER_BITS, max(16, (SPARSE * sum(r["total"] for r in sizes)).bit_length()))
    table = np.zeros(bits // 8, np.uint8)
    width = min(bits, 1 << 20) // 8
    for r in once.select("text").mapInArrow(_marked(words, bits), "part int, bits binary").groupBy("part").applyInArrow(_joined, "part int, bits binary").collect():
        table[r.part * width : (r.part + 1) * width] = np.frombuffer(r.bits, np.uint8)
    sent = spark.sparkContext.broadcast(table)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.md5(text).alias("text_md5"))
    rows = written(rows.mapInArrow(tidy(_suspects(sent, bits, needed)), rows.schema), "suspects", place)
    sent.destroy()
    # blocks of items, by running sums of their bytes inside ranges of their names
    size = F.octet_length("text")
    total = once.agg(F.sum(size)).first()[0] or 0
    parts = max(1, math.ceil(total / ITEM_BYTES))
    found = None
    for b in range(parts):
        own = once.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == b)
        for lot in _lots(own):
            index = spark.sparkContext.broadcast(Items([r.name for r in lot], [r.text for r in lot], words))
            part = written(rows.mapInArrow(tidy(_search(index, percent / 100)), SCHEMA), "found", place)
            index.destroy()
            found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], SCHEMA)
    out = found.join(named.select(F.col("name").alias("item"), F.col("id").alias("item_id")), "item")
    out = out.select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), "similarity", "start_word", "n_words", "start_byte", "passage", "text_md5")
    result = written(out, "leaks")
    removed(spark, place)
    return result


def _lots(items: DataFrame) -> Iterator[list]:
    """Items in lists of at most ITEM_BYTES of text, or one longer item; the driver holds one list at a time."""
    lot, have = [], 0
    for r in items.sort("name").toLocalIterator():
        n = len(r.text.encode())
        if lot and have + n > ITEM_BYTES:
            yield lot
            lot, have = [], 0
        lot.append(r)
        have += n
    if lot:
        yield lot
