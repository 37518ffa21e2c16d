"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items (an item with
fewer words is one pattern). Patterns of one length form a set with its own tables: a shift table
over hashed two-word blocks says how far a search position may move on, a zero shift names the
bucket of patterns that end in that block, and the words themselves are then compared.

Documents are read once and not shuffled; only the benchmark's tables go to the executors, in
blocks of bounded size (BLOCK_BYTES of item text each), applied one after the other.

Defined results: a null or empty text has no words and no hits; an item without words has no
patterns; an item whose id is null can hit words but is not listed; repeated items and repeated
documents are each judged as they stand; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textscan as ts

#: UTF-8 bytes of item texts in one block of patterns.
BLOCK_BYTES = 32 << 20
SEGMENT = 192  # window starts that one search position covers


class PatternSet:
    """Shift table, suffix buckets and test strings for the patterns of one length."""

    def __init__(self, texts: list[tuple[bytes, ...]], owners: list[list[int]], hashes: np.ndarray):
        self.texts, self.owners, self.hashes = texts, owners, hashes
        n, self.length = hashes.shape
        self.block = min(2, self.length)
        bits = min(24, max(10, math.ceil(math.log2(64 * n * self.length + 1))))
        self.down = np.uint64(64 - bits)
        last = self.length - self.block
        self.shift = np.full(1 << bits, last + 1, np.uint8 if last < 250 else np.int32)
        for at in range(last + 1):  # later blocks write smaller shifts, so the minimum stays
            self.shift[self._block(hashes, at) >> self.down] = last - at
        ends = self._block(hashes, last)
        order = np.argsort(ends, kind="stable")
        self.bucket_ends, self.bucket_first, counts = np.unique(ends[order], return_index=True, return_counts=True)
        self.bucket_size, self.bucket_of = counts, order

    def _block(self, h: np.ndarray, at: int) -> np.ndarray:
        return self.mixed(h[:, at], h[:, at + self.block - 1])

    @staticmethod
    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)

    def search(self, words: ts.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions at which patterns start, and which patterns."""
        begin, stop = words.first[:-1], words.first[1:] - self.length + 1
        pieces = np.maximum(0, -(-(stop - begin) // SEGMENT))
        doc = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = begin[doc] + nth * SEGMENT
        until = np.minimum(pos + SEGMENT, stop[doc])
        found = []
        last = self.length - self.block
        while len(pos):
            move = self.shift[self.mixed(h[pos + last], h[pos + self.length - 1]) >> self.down].astype(np.int64)
            found.append(pos[move == 0])
            pos = pos + np.maximum(move, 1)
            on = pos < until
            pos, until = pos[on], until[on]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        key = self.mixed(h[at + last], h[at + self.length - 1])
        bucket = np.searchsorted(self.bucket_ends, key)
        known = bucket < len(self.bucket_ends)
        known[known] = self.bucket_ends[bucket[known]] == key[known]
        at, bucket = at[known], bucket[known]
        size = self.bucket_size[bucket]
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.bucket_of[np.repeat(self.bucket_first[bucket], size) + nth]
        at = np.repeat(at, size)
        same = np.ones(len(at), bool)
        for j in range(self.length):  # cheap comparison first
            same[same] = h[at[same] + j] == self.hashes[pattern[same], j]
        at, pattern = at[same], pattern[same]
        sure = np.fromiter((self._equal(words, a, p) for a, p in zip(at, pattern, strict=True)), bool, len(at))
        return at[sure], pattern[sure]

    def _equal(self, words: ts.Words, at: int, pattern: int) -> bool:
        """Direct comparison of the words."""
        return all(
            words.data[words.start[at + j] : words.end[at + j]].tobytes() == w for j, w in enumerate(self.texts[pattern])
        )


def compile_patterns(items: list[tuple[int, str]], window: int) -> tuple[list[PatternSet], list]:
    """Pattern sets by length, and the item ids that owners point at."""
    words = ts.scan(pa.array([t or "" for _, t in items], pa.string()), ts.ALNUM)
    h = words.hashes()
    by_length: dict[int, dict[tuple[bytes, ...], tuple[np.ndarray, set[int]]]] = {}
    for i in range(len(items)):
        a, b = words.first[i], words.first[i + 1]
        n = min(window, b - a)
        spelled = [words.data[words.start[j] : words.end[j]].tobytes() for j in range(a, b)]
        for j in range(b - a - n + 1 if n else 0):
            entry = by_length.setdefault(n, {}).setdefault(tuple(spelled[j : j + n]), (h[a + j : a + j + n], set()))
            entry[1].add(i)
    sets = [
        PatternSet(list(found), [sorted(o) for _, o in found.values()], np.stack([x for x, _ in found.values()]))
        for _, found in sorted(by_length.items())
    ]
    return sets, [i for i, _ in items]


def _apply(blocks: list, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ts.scan(batch.column("text"), ts.ALNUM)
            h = words.hashes()
            hit = np.zeros(len(h) + 1, np.int64)
            owners: dict[int, set] = {}
            for block in blocks:
                sets, ids = block.value
                for patterns in sets:
                    at, pattern = patterns.search(words, h)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + patterns.length, -1)
                    doc = np.searchsorted(words.first, at, "right") - 1
                    for d, p in zip(doc.tolist(), pattern.tolist(), strict=True):
                        owners.setdefault(d, set()).update(ids[o] for o in patterns.owners[p])
            covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(covered[words.first[1:]] - covered[words.first[:-1]], pa.int64()),
                    pa.array([sorted(x for x in owners.get(i, ()) if x is not None) for i in range(n)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_words", "n_hit", "items"],
            )

    return run


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list:
    """The benchmark's pattern tables as broadcast blocks of at most BLOCK_BYTES of text each.

    A single item longer than that is a block of its own.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // BLOCK_BYTES))
    blocks = []
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        rows = [(r["id"], r["text"]) for r in part.toLocalIterator()]
        blocks.append(spark.sparkContext.broadcast(compile_patterns(rows, window)))
    return blocks


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence) and items (ids found, sorted)."""
    blocks = pattern_blocks(benchmark, item_col, item_text_col, window)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_apply(blocks, window), "doc_id long, n_words long, n_hit long, items array<long>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence, all columns kept; rows whose id is null are kept.

    Document ids are taken to identify rows; of rows that share an id, all go if one is hit.
    """
    hit = find_benchmark(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.col(options.get("id_col", "doc_id")) == F.col("__hit"), "left_anti")
