"""Benchmark decontamination by SimHash over item-sized windows and a multi-index of Hamming blocks.

Words are runs of word characters of the lower-cased text; shingles are five words (an item of fewer is one shingle). Every
window of a document that is as long as an item gets a 64-bit SimHash over its shingles with their counts. Fingerprints are cut
into BLOCKS blocks of bits. Of two within RADIUS bits, one block at least differs in RADIUS / BLOCKS bits or fewer, so a
directory by block value, looked up under every value that near, finds all of them: pairs that share no near block are never
compared. Candidates within RADIUS are verified by exact weighted (multiset) Jaccard similarity of shingles, which must be
THRESHOLD or more.

Windows without any shingle of an item of their length have similarity 0 and get no fingerprint; an exact table of the items'
shingles tells them. At similarity 0.8 the expected distance is 10 bits with a deviation of 3; RADIUS is three deviations
beyond, so a window of just 0.8 is missed with probability 0.1 %, a better one hardly ever.

Items are taken in blocks of about BLOCK_CHARS characters, one at a time: its index is the only thing of the benchmark that the
driver and the tasks hold, whatever the size of the benchmark. Documents are read whole, once for each block, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType

from notemill.llm.common import checkpoint, columns, table

SHINGLE = 5
THRESHOLD = 0.8
RADIUS, BLOCKS = 19, 4
#: Characters of the items of a block, at most (one longer item is a block).
BLOCK_CHARS = 4_000_000
#: Bits of the filter that positions pass first.
FILTER = 1 << 22
#: Words whose hashes a worker keeps.
VOCABULARY = 200_000

_words = re.compile(r"\w+").findall
_mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value


_hash = _Hashes()


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """(hash of each shingle of `size` words, number of words); a shorter text is one shingle."""
    words = _words((text or "").lower())
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), 0
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, n)
    return rolled(h, min(size, n)), n


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : k + len(out)] * _mix[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def signs(h: np.ndarray) -> np.ndarray:
    """(n, 64): 1 where a hash has the bit, else -1."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(total: np.ndarray) -> np.ndarray:
    """Fingerprints of summed signs, shape (n, 64)."""
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


#: All values of a block with RADIUS / BLOCKS bits or fewer.
_NEAR = np.flatnonzero(np.bitwise_count(np.arange(1 << 64 // BLOCKS)) <= RADIUS // BLOCKS)
#: Fingerprints whose near values are looked up together.
_TOGETHER = 64
_directory = np.zeros(1 << 64 // BLOCKS, np.int32)


def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all fingerprints of a and b within RADIUS bits, sorted.

    The larger side goes into a directory of block values (value to its fingerprints), in which each near value of the smaller
    side's blocks is looked up; only pairs that meet in a block are compared as a whole.
    """
    if len(a) > len(b):
        j, i = near(b, a)
        order = np.lexsort((j, i))
        return i[order], j[order]
    met = []
    for k in range(BLOCKS):
        shift, mask = np.uint64(k * (64 // BLOCKS)), np.uint64((1 << 64 // BLOCKS) - 1)
        order = np.argsort((b >> shift) & mask, kind="stable")
        values, starts, counts = np.unique(((b >> shift) & mask)[order], return_index=True, return_counts=True)
        values = values.astype(np.int64)
        _directory[values] = np.arange(1, len(values) + 1)
        own = ((a >> shift) & mask).astype(np.int64)
        for low in range(0, len(a), _TOGETHER):
            entry = _directory[own[low : low + _TOGETHER, None] ^ _NEAR[None, :]]
            i, at = np.nonzero(entry)
            entry = entry[i, at] - 1
            n = counts[entry]
            j = order[np.repeat(starts[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            met.append(np.repeat(low + i, n) * len(b) + j)
        _directory[values] = 0
    pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    i, j = pairs // max(len(b), 1), pairs % max(len(b), 1)
    close = np.bitwise_count(a[i] ^ b[j]) <= RADIUS
    return i[close], j[close]


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and how often each is there."""
    return np.unique(h, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard similarity of two counted() arrays."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


class Index:
    """Items of one block: shingles, counts and fingerprints by length in words."""

    def __init__(self, items: list[tuple]):
        self.ids, self.lengths, self.counts, prints = [], [], [], []
        for item, text in items:
            h, n = shingles(text)
            if not n:
                continue
            self.ids.append(item)
            self.lengths.append(n)
            self.counts.append(counted(h))
            prints.append(packed(signs(h).sum(0, keepdims=True))[0])
        self.prints = np.array(prints, dtype=np.uint64)
        self.size = np.array([min(n, SHINGLE) for n in self.lengths])
        self.by_length = {n: np.array([k for k, x in enumerate(self.lengths) if x == n]) for n in set(self.lengths)}
        every = np.concatenate([h for h, _ in self.counts]) if prints else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(prints), dtype=np.int32), [len(h) for h, _ in self.counts])
        order = np.argsort(every, kind="stable")
        self.hash, self.owner = every[order], owner[order]
        self.sizes = sorted(set(self.size.tolist()))
        self.filter = np.zeros(FILTER, bool)
        self.filter[(self.hash & np.uint64(FILTER - 1)).astype(np.int64)] = True

    def search(self, text: str | None) -> list[tuple]:
        """(item, similarity, first word, words) of the best window of each item found in a text."""
        words = _words((text or "").lower())
        if not words or not self.ids:
            return []
        h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
        best: dict[int, tuple] = {}
        for size in self.sizes:
            if len(h) < size:
                continue
            own = rolled(h, size)
            at = np.flatnonzero(self.filter[(own & np.uint64(FILTER - 1)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(self.hash, own[at], "left"), np.searchsorted(self.hash, own[at], "right")
            spots: dict[int, set] = {}
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in self.owner[a:b].tolist():
                    if self.size[k] == size:
                        spots.setdefault(self.lengths[k], set()).add(p)
            for length, places in spots.items():
                self._windows(own, length, size, sorted(places), best)
        return [(self.ids[k], *found) for k, found in sorted(best.items())]

    def _windows(self, own: np.ndarray, length: int, size: int, places: list[int], best: dict) -> None:
        """Verify all windows of `length` words that hold a shingle of an item of that length."""
        n = length - size + 1  # shingles of a window
        last = max(len(own) - n, 0)  # a document shorter than the item is one window
        runs: list[list[int]] = []
        for p in places:
            a, b = max(0, p - n + 1), min(p, last)
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            elif a <= b:
                runs.append([a, b])
        for a, b in runs:
            for low in range(a, b + 1, 4096):
                high = min(b, low + 4095)
                part = own[low : high + n]
                sums = np.zeros((len(part) + 1, 64), np.int32)
                np.cumsum(signs(np.ascontiguousarray(part)), axis=0, out=sums[1:])
                starts = np.arange(high - low + 1)
                prints = packed(sums[np.minimum(starts + n, len(part))] - sums[starts])
                items = self.by_length[length]
                windows, of = near(prints, self.prints[items])
                for w, k in zip(windows.tolist(), items[of].tolist(), strict=True):
                    similarity = weighted_jaccard(self.counts[k], counted(part[w : w + n]))
                    if similarity >= THRESHOLD and similarity > best.get(k, (0.0,))[0]:
                        best[k] = (similarity, low + w, length)


def blocks_of(items: DataFrame, item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """(item_id, item) in blocks of about block_chars characters; one (empty) if there are no items."""
    own = items.select(F.col(item_col).alias("item_id"), F.col("text").alias("item"))
    n = -(-(own.agg(F.sum(F.length("item"))).first()[0] or 0) // block_chars) or 1
    return [own.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(n)) == b) for b in range(n)]


def _each_block(items: DataFrame, item_col: str, block_chars: int, search: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """The union of search(index) over all blocks. Several are done one after the other, and each index is given up after use."""
    blocks, done = blocks_of(items, item_col, block_chars), []
    for block in blocks:
        index = items.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.item) for r in block.collect()]))
        if len(blocks) == 1:
            return search(index)
        done.append(checkpoint(search(index)))
        index.destroy()
    return reduce(DataFrame.unionByName, done)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and benchmark item found in it: doc_id, item_id, similarity, start_word, n_words.

    The window is the first one of highest similarity. Null and empty texts hold nothing and, as items, match nothing.
    Repeated documents and items are reported each; null ids are reported as null. Empty tables give an empty result, other
    columns are ignored. An item of fewer than five words is found where its words stand in a row.
    """
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}"
    schema = f"{kinds}, similarity double, start_word long, n_words long"
    item_type = to_arrow_type(items.schema[item_col].dataType)

    def found(index: Broadcast) -> DataFrame:
        def search(batches):
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.value.search(t)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [batch.schema.field(0).type, item_type, pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(search, schema)

    return _each_block(items, item_col, block_chars, found)


def without_benchmarks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; all columns. See contaminated() for nulls.

    With one block of items rows are judged in place. With several, the ids and text keys of what any block finds are gathered
    (a table, never on the driver) and taken out by a join on both.
    """

    def leaks(index: Broadcast):
        @F.pandas_udf(BooleanType())
        def found(text: pd.Series) -> pd.Series:
            return pd.Series([bool(index.value.search(t)) for t in text], dtype=bool)

        return found

    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    if len(blocks_of(items, block_chars=block_chars)) == 1:
        return _each_block(items, "item_id", block_chars, lambda index: docs.where(~leaks(index)(F.col(text_col))))
    found = _each_block(items, "item_id", block_chars, lambda index: own.where(leaks(index)("text")).select("id", "key").distinct())
    bad = found.distinct().select(F.col("id").alias("bad_id"), F.col("key").alias("bad_key"))
    return own.join(bad, (F.col("key") == F.col("bad_key")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents; see contaminated()."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
