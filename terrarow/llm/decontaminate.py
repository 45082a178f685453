"""Benchmark decontamination by SimHash windows.

Words are runs of ASCII letters and digits (lower-cased) and of non-ASCII characters; shingles are five words. For
each size of item, the item-sized windows of a document get 64-bit SimHashes of their weighted shingles. Five blocks
of 13 or 12 bits index the items by every value within floor(RADIUS / 5) bits of theirs, so by the pigeonhole
principle every item within RADIUS bits of a window is found. Candidates are verified by the exact weighted Jaccard
similarity of their shingle multisets; shingles that many items share weigh less. Items are counted over the whole
benchmark, so the weights don't depend on the blocks. A window without any shingle of
the benchmark has similarity 0 to all items, so its fingerprint isn't computed.

Whole texts are scanned and no document is shuffled; the benchmark goes to the tasks in blocks of BLOCK
items, one at a time, each with the counts of all shingles that several items share (12 bytes a shingle). Where there
are several blocks, one pass over all texts first finds the documents that hold any shingle of the benchmark, by a bitmap of
at most 2**MAX_BITS bits, and only those, stored, are scanned block by block; what the bitmap passes wrongly costs time, not
results. Edge cases: null and empty texts and items have no words and never match; an item of
fewer than five words is one shingle of them all and must occur as it is; items are told apart by id and text, so equal
texts of different ids and different texts of one id each match, and equal rows count once; items without an id count
too and are reported as null; a document shorter than an item is one window; an empty benchmark or table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import map_rows, stored, table
from .textual import as_bytes, shingle_hashes, word_hashes

RADIUS, SIMILARITY, SHINGLE = 19, 0.8, 5
#: Items that one pass holds in every task, and bits of the bitmap of all shingles as a power of two, at most.
BLOCK, MAX_BITS = 5000, 30
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def normal_words(text: str | None) -> np.ndarray:
    """Hashes of a text's words, free of case and punctuation."""
    return word_hashes(_LOWER[as_bytes(text)], _NOT_WORD)[0]


def simhash(shingles: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of size shingles: per bit the sign of the sum of +weight and -weight."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    signed = np.where(bits, weights[:, None], -weights[:, None]).astype(np.int32)
    sums = np.zeros((len(signed) + 1, 64), np.int32)
    np.cumsum(signed, axis=0, out=sums[1:])
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class _Size:
    """The items of one number of words."""

    n_words: int
    shingle: int
    ids: list[int]  # running numbers of the items
    prints: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # by block: offsets by value, item numbers


def _block_table(values: np.ndarray, bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    masks = np.array([sum(1 << b for b in bs) for k in range(reach + 1) for bs in itertools.combinations(range(bits), k)], np.int64)
    near = (values.astype(np.int64)[:, None] ^ masks[None]).ravel()
    item = np.repeat(np.arange(len(values)), len(masks))
    order = np.argsort(near, kind="stable")
    return np.searchsorted(near[order], np.arange((1 << bits) + 1)), item[order].astype(np.int32)


@dataclass
class Shared:
    """The number of items that have words, and the sorted shingles that several of them hold with their counts."""

    n_items: int
    shingles: np.ndarray
    counts: np.ndarray


class BenchmarkIndex:
    """Item shingles with their weights, and a multi-index over the items' fingerprints for each item size."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = RADIUS, similarity: float = SIMILARITY, shared: Shared | None = None):
        self.radius, self.similarity = radius, similarity
        words = [(i, normal_words(t)) for i, t in items]
        words = sorted(((i, w) for i, w in ((i, w.tolist()) for i, w in words) if w), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.item_ids = [i for i, _ in words]
        found = [(k, len(w), min(SHINGLE, len(w)), shingle_hashes(np.array(w, np.uint64), SHINGLE)) for k, (_, w) in enumerate(words)]
        if shared is None:  # the items are the whole benchmark
            df = Counter(h for *_, s in found for h in set(s.tolist()))
            several = sorted(h for h, n in df.items() if n > 1)
            shared = Shared(len(found), np.array(several, np.uint64), np.array([df[h] for h in several], np.int32))
        # a shingle of one item weighs as much as one of none
        self.default = max(1, round(4 * math.log(2 + shared.n_items)))
        self.shared = shared.shingles
        self.shared_weight = np.maximum(1, np.rint(4 * np.log(1 + (1 + shared.n_items) / shared.counts))).astype(np.int32)
        self.sorted = np.unique(np.concatenate([s for *_, s in found])) if found else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.sorted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.counts = {i: Counter(s.tolist()) for i, _, _, s in found}
        self.totals = {i: int(self.weights(s).sum()) for i, _, _, s in found}
        self.sizes = []
        for n_words in sorted({n for _, n, _, _ in found}):
            own = [(i, k, s) for i, n, k, s in found if n == n_words]
            prints = np.array([simhash(s, self.weights(s), len(s))[0] for _, _, s in own], np.uint64)
            block = lambda b: (prints >> np.uint64(b[0])) & np.uint64((1 << b[1]) - 1)  # noqa: B023, E731
            self.sizes.append(_Size(n_words, own[0][1], [i for i, _, _ in own], prints, [_block_table(block(b), b[1], radius // len(_BLOCKS)) for b in _BLOCKS]))
        self.shingle_sizes = sorted({s.shingle for s in self.sizes})

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of benchmark shingles."""
        at = np.flatnonzero(self.seen[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.sorted, shingles[at]), len(self.sorted) - 1)
        return at[self.sorted[place] == shingles[at]]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(shingles), self.default, np.int32)
        at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.where(self.shared[at] == shingles, self.shared_weight[at], self.default).astype(np.int32)

    def exact(self, item: int, window: list[int]) -> float:
        """Weighted Jaccard similarity of an item's and a window's shingle multisets."""
        a, b = self.counts[item], Counter(window)
        weight = self.weights(np.fromiter(b, np.uint64, len(b))).tolist()
        both = sum(min(n, a[h]) * w for (h, n), w in zip(b.items(), weight) if h in a)
        all_ = self.totals[item] + sum(n * w for n, w in zip(b.values(), weight)) - both
        return both / all_ if all_ else 0.0

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, float]]:
        """(item's id, first word, words, similarity) of the best window of each item that a text holds."""
        words = normal_words(text)
        best: dict[int, tuple[float, int, int]] = {}
        for k in self.shingle_sizes:
            if len(words) < k:
                continue
            shingles = shingle_hashes(words, k)
            hits = self.hits(shingles)
            if not len(hits):
                continue
            for s in self.sizes:
                if s.shingle == k:
                    self._match_size(s, shingles, hits, best)
        return [(self.item_ids[i], at, n, sim) for i, (sim, at, n) in sorted(best.items())]

    def _match_size(self, s: _Size, shingles: np.ndarray, hits: np.ndarray, best: dict) -> None:
        size = min(s.n_words - s.shingle + 1, len(shingles))
        last = len(shingles) - size
        # windows that hold a hit, in runs
        lo, hi = np.maximum(hits - size + 1, 0), np.minimum(hits, last) + 1
        run = np.flatnonzero(np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]])
        for a, b in zip(lo[run].tolist(), np.maximum.reduceat(hi, run).tolist()):
            if a >= b:
                continue
            part = shingles[a : b + size - 1]
            prints = simhash(part, self.weights(part), size)
            for at, item in self._near(s, prints):
                window = part[at : at + size].tolist()
                sim = self.exact(s.ids[item], window)
                if sim >= self.similarity and (sim, -(a + at)) > (best.get(s.ids[item], (0.0, 0, 0))[0], -best.get(s.ids[item], (0.0, 0, 0))[1]):
                    best[s.ids[item]] = (sim, a + at, size + s.shingle - 1)

    def _near(self, s: _Size, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) within the radius, from the block tables."""
        found = []
        for (shift, bits), (offsets, items) in zip(_BLOCKS, s.tables):
            v = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            n = offsets[v + 1] - offsets[v]
            at = np.repeat(np.arange(len(prints)), n)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            found.append(at * len(s.ids) + items[np.repeat(offsets[v], n) + inner])
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        w, i = pairs // len(s.ids), pairs % len(s.ids)
        near = np.bitwise_count(prints[w] ^ s.prints[i]) <= self.radius
        return list(zip(w[near].tolist(), i[near].tolist()))


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each item that a document holds."""
    rows = benchmark.select("item_id", "text").distinct()
    parts = _n_blocks(rows)
    if parts == 1:
        return _scan(docs, next(_indexes(rows, radius, similarity)))
    held = stored(_marked(docs.select("doc_id", "text"), rows).where("_hit"), "with-shingles")
    # stored one by one, so the driver holds one index at a time
    return reduce(DataFrame.unionByName, (stored(_scan(held, i), "leaks") for i in _indexes(rows, radius, similarity, parts)))


def _n_blocks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BLOCK))


def _indexes(rows: DataFrame, radius: int, similarity: float, parts: int = 1) -> Iterator[BenchmarkIndex]:
    """Indexes of the blocks of distinct items, made as they are asked for."""
    shared = _shared(rows)
    for p in range(parts):
        items = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()  # about BLOCK items
        yield BenchmarkIndex([(r.item_id, r.text) for r in items], radius, similarity, shared)


def _marked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents with _hit: whether a text may hold a shingle of the benchmark."""

    def hashed(batch):
        out = [(len(w), shingle_hashes(w, SHINGLE)) for w in (normal_words(t.as_py()) for t in batch.column(0))]
        yield {"k": np.concatenate([np.full(len(s), min(n, SHINGLE)) for n, s in out] or [[]]).astype(np.int32), "h": np.concatenate([s for _, s in out] or [np.zeros(0, np.uint64)]).view(np.int64)}

    shingles = map_rows(rows.select("text"), hashed, "k int, h bigint")
    n, sizes = shingles.agg(F.count("*"), F.collect_set("k")).first()
    bits = min(MAX_BITS, max(16, (16 * n).bit_length()))
    at = shingles.select((F.col("h").bitwiseAND((1 << bits) - 1) + 1).alias("p"))
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for r in at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).toLocalIterator():  # one row of 4 KiB per 32768 bits
        start = (r["b"] - 1) * len(r["m"])
        marks[start : start + len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(marks) - start]
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def mark(batch):
        names = [f.name for f in batch.schema]
        hit = []
        for t in batch.column(names.index("text")):
            words = normal_words(t.as_py())
            found = False
            for k in sizes:
                if len(words) >= k and not found:
                    p = shingle_hashes(words, k) & np.uint64((1 << bits) - 1)
                    found = bool((shared.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).any())
            hit.append(found)
        yield {c: batch.column(i) for i, c in enumerate(names)} | {"_hit": hit}

    return map_rows(docs, mark, StructType([*docs.schema, StructField("_hit", BooleanType())]))


def _shared(rows: DataFrame) -> Shared:
    """Counted over the whole benchmark; a null shingle stands for the item itself."""

    def count(batch):
        out: list[int | None] = []
        for t in batch.column(0):
            words = normal_words(t.as_py())
            if len(words):
                out += [None, *set(shingle_hashes(words, SHINGLE).view(np.int64).tolist())]
        yield {"shingle": out}

    several = map_rows(rows.select("text"), count, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1 OR shingle IS NULL").toArrow()
    known = several.filter(several.column("shingle").is_valid())
    shingles = known.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    items = several.filter(several.column("shingle").is_null()).column("n").to_pylist()
    return Shared(sum(items), shingles[order], known.column("n").to_numpy()[order].astype(np.int32))


def _scan(docs: DataFrame, index: BenchmarkIndex) -> DataFrame:
    def scan(batch):
        out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "start_word", "n_words", "similarity")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for row in index.matches(text.as_py()):
                for c, v in zip(out, (doc_id, *row)):
                    out[c].append(v)
        yield out

    return map_rows(docs.select("doc_id", "text"), scan, "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double")


def without_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with their own columns."""

    def without(held: DataFrame, index: BenchmarkIndex) -> DataFrame:
        def clean(batch):
            import pyarrow as pa

            names = [f.name for f in batch.schema]
            own = batch.filter(pa.array([not index.matches(t.as_py()) for t in batch.column(names.index("text"))], pa.bool_()))
            yield {c: own.column(i) for i, c in enumerate(names)}

        return map_rows(held, clean, docs.schema)

    rows = benchmark.select("item_id", "text").distinct()
    parts = _n_blocks(rows)
    if parts == 1:
        return without(docs, next(_indexes(rows, radius, similarity)))
    marked = stored(_marked(docs, rows), "marked")
    held = marked.where("_hit").select(*docs.columns)
    for index in _indexes(rows, radius, similarity, parts):
        held = stored(without(held, index), "without-leaks")
    return marked.where("NOT _hit").select(*docs.columns).union(held)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
