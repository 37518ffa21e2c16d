"""Substring dedup: words covered by a long window that an earlier document also has are removed.

A window is ``length`` consecutive words. It is a copy if its word sequence also starts in a
document with a smaller id; all words that copies cover are removed.

1. Each window has one anchor: the smallest hash among its runs of ANCHOR words (the last of equals),
   so equal windows have equal anchors, and a text has about one anchor every (length - ANCHOR) / 2
   words. Documents equal as word sequences count once here (the later ones are copies as a whole).
2. Only anchors that occur in several documents are kept; the stretch of words that an anchor's
   windows cover goes to the shard of the anchor's hash, so all that could equal a window meet
   it there, and shards can be made as small as memory asks.
3. Each shard builds a compressed FM-index over its distinct stretches: suffixes sorted to the depth of a
   window, the Burrows-Wheeler transform over word numbers in a wavelet matrix with rank
   directories, and per suffix its document. Stretches are streamed through it by backward search
   that keeps the matching statistics at window length: an interval is extended by one word and widened
   again to the group that shares all but its last word. The smallest document in a full interval
   decides which of the stretch's windows are copies, for every document that has the stretch.
4. The covered spans go back to their documents, whose kept words are joined again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textscan as ts
from ledgerloom.session import cut

#: Words in an anchor; less than a window.
ANCHOR = 12
#: Stretches in one shard, about; the number of shards grows with the corpus.
SHARD_STRETCHES = 12_000


# --- the index ------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit vector and rank directory per level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n = len(values)
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        v = values.astype(np.uint32)
        for k in range(self.bits - 1, -1, -1):
            bit = (v >> np.uint32(k)) & np.uint32(1)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self.ones(level, low), self.ones(level, at)
            low = np.where(bit, self.zeros[level] + a, low - a)
            at = np.where(bit, self.zeros[level] + b, at - b)
        return at - low


class FMIndex:
    """Backward search over stretches of words, each with the smallest document that has it."""

    def __init__(self, stretches: list[np.ndarray], docs: np.ndarray, depth: int):
        lengths = np.array([len(x) for x in stretches], np.int64)
        words = np.concatenate(stretches)
        self.alphabet, coded = np.unique(words, return_inverse=True)
        # every stretch is closed by the end mark 0, words count from 1
        n = len(words) + len(stretches)
        text = np.zeros(n, np.int64)
        owner = np.repeat(np.arange(len(stretches)), lengths + 1)
        inside = np.ones(n, bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        text[inside] = coded + 1
        self.sigma = len(self.alphabet) + 1
        room = np.repeat(np.cumsum(lengths + 1) - 1, lengths + 1) - np.arange(n)  # words before the mark
        order, rank, shorter = self._sorted(text, room, depth)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.wavelet = WaveletMatrix(text[order - 1], self.sigma)
        # an interval of windows without their last words: the group equal on depth - 1 words
        keys = shorter[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([first, [n]]))
        self.group_low, self.group_high = np.repeat(first, size), np.repeat(first + size, size)
        self._minima(docs[owner][order], rank[order])

    @staticmethod
    def _sorted(text: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix order by the first depth symbols (stretches end at their mark), by prefix doubling;
        also the ranks at that depth and at depth - 1."""
        n = len(text)

        def ranks_of(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            out = np.empty(n, np.int64)
            out[order] = step
            return out

        def shifted(r: np.ndarray, k: int) -> np.ndarray:
            # beyond a stretch's end nothing is compared
            out = np.zeros(n, np.int64)
            ok = room >= k
            out[ok] = r[np.flatnonzero(ok) + k] + 1
            return out

        by_width = {1: text}
        width = 1
        while width * 2 <= depth - 1:
            r = by_width[width]
            by_width[width * 2] = ranks_of(r * (n + 2) + shifted(r, width))
            width *= 2

        def at_depth(d: int) -> np.ndarray:
            # two overlapping runs of a known width decide d symbols
            r = by_width[width]
            return ranks_of(r * (n + 2) + shifted(r, d - width)) if d > width else r

        shorter, full = at_depth(depth - 1), at_depth(depth)
        # suffixes equal on depth symbols are ordered as depth - 1 asks, so that both kinds of groups are runs
        order = np.argsort(full, kind="stable")
        return order, full, shorter

    def _minima(self, docs: np.ndarray, rank: np.ndarray) -> None:
        """Smallest document of each group of suffixes equal over a whole window."""
        first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        self.window_min = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.concatenate([first, [len(rank)]])))

    def codes(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, words)
        return np.where((at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == words), at + 1, 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        base = self.before[symbol]
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        k = len(symbol)
        return base + both[:k], base + both[k:]

    def first_documents(self, stretches: list[np.ndarray], length: int) -> list[np.ndarray]:
        """For each window of each stretch, the smallest document of the index that has it (or -1).

        All stretches advance in step from their right ends.
        """
        sizes = np.array([len(x) for x in stretches], np.int64)
        flat = self.codes(np.concatenate(stretches))
        start = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - length + 1, 0)
        found = np.full(int(windows.sum()), -1, np.int64)
        at = np.cumsum(windows) - windows
        live = np.flatnonzero(windows > 0)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.group_low), np.int64)
        depth = 0
        pos = start[live] + sizes[live] - 1
        while len(live):
            if depth == length:  # drop the last word
                low, high, depth = self.group_low[low], self.group_high[low], length - 1
            low, high = self.extend(flat[pos], low, high)
            depth += 1
            if depth == length:
                found[at[live] + pos - start[live]] = self.window_min[low]
            pos = pos - 1
            on = (pos >= start[live]) & (low < high)
            live, low, high, pos = live[on], low[on], high[on], pos[on]
        return np.split(found, np.cumsum(windows)[:-1])


# --- stages ---------------------------------------------------------------------------------


def _anchors(words: ts.Words, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first window, last window) of every run of windows with one anchor."""
    n = len(h) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    g = ts.windows(h, ANCHOR)
    span = length - ANCHOR + 1
    # position of the smallest of each span of runs, by doubling; the last of equals
    best = np.arange(len(g))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[b] <= g[a], b, a)
        width += step
    ok = ts.inside_texts(words.first, length, n)
    best = best[:n]
    where = np.flatnonzero(ok)
    best = best[where]
    doc = np.searchsorted(words.first, where, "right") - 1
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(where) != 1)]) if len(where) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(where)]]) - 1 if len(first) else first
    return doc[first], g[best[first]], where[first], where[last]


def _sketches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ts.scan(batch.column("text"), ts.SPACED, lower=False)
            h = words.hashes()
            doc, anchor, _, _ = _anchors(words, h, length)
            per = np.bincount(doc, minlength=batch.num_rows)
            texts = batch.column("text").to_pylist()
            whole, shas = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                joined = b" ".join((texts[i] or "").encode().split())
                shas.append(hashlib.sha256(joined).hexdigest())
                whole.append(int(ts.whole(h[a:b]).view(np.int64)))
            offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(whole, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchor.view(np.int64))),
                ],
                names=["doc_id", "n_words", "sha", "whole", "anchors"],
            )

    return run


def _wholes(words: ts.Words, h: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the whole word sequence of some of a batch's n texts; tells rows with one id apart."""
    out = np.zeros(n, np.int64)
    for i in texts.tolist():
        out[i] = ts.whole(h[words.first[i] : words.first[i + 1]]).view(np.int64)
    return out


def _stretches(length: int, shards: int):
    """The words that the windows of each recurring anchor cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ts.scan(batch.column("text"), ts.SPACED, lower=False)
            h = words.hashes()
            doc, anchor, first, last = _anchors(words, h, length)
            asked = batch.column("anchors")
            per = np.diff(asked.offsets.to_numpy())
            wanted_doc = np.repeat(np.arange(batch.num_rows), per)
            wanted = asked.flatten().to_numpy().view(np.uint64)
            pair = ts.mix(doc.astype(np.uint64) + np.uint64(1)) ^ anchor
            keep = np.isin(pair, ts.mix(wanted_doc.astype(np.uint64) + np.uint64(1)) ^ wanted)
            doc, anchor, first, last = doc[keep], anchor[keep], first[keep], last[keep]
            if not len(doc):
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            whole = _wholes(words, h, np.unique(doc), batch.num_rows)
            size = last - first + length
            flat = h[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(((anchor >> np.uint64(20)) % np.uint64(shards)).astype(np.int64), pa.int64()),
                    pa.array(ids[doc].astype(np.int64), pa.int64()),
                    pa.array(whole[doc], pa.int64()),
                    pa.array(first - words.first[doc], pa.int64()),
                    ts.binaries((flat >> np.uint64(24)).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5].copy().reshape(-1), size * 5),
                ],
                names=["shard", "doc_id", "whole", "start", "words"],
            )

    return run


def _wide(packed: bytes) -> np.ndarray:
    """Word hashes travel as 5 bytes each."""
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _searched(length: int):
    """Spans of copies in one shard's stretches."""

    def run(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        which = np.array([numbers.setdefault(w, len(numbers)) for w in table.column("words").to_pylist()], np.int64)
        docs = table.column("doc_id").to_numpy()
        whole = table.column("whole").to_numpy()
        start = table.column("start").to_numpy()
        stretches = [_wide(w) for w in numbers]
        smallest = np.full(len(stretches), np.iinfo(np.int64).max)
        np.minimum.at(smallest, which, docs)
        index = FMIndex(stretches, smallest, length)
        first = index.first_documents(stretches, length)
        out_doc, out_whole, out_from, out_to = [], [], [], []
        for i, d, w, s in zip(which.tolist(), docs.tolist(), whole.tolist(), start.tolist(), strict=True):
            f = first[i]
            hit = np.flatnonzero((f >= 0) & (f < d))
            if len(hit):
                breaks = np.flatnonzero(np.diff(hit) > length)
                for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hit) - 1]]), strict=True):
                    out_doc.append(d)
                    out_whole.append(w)
                    out_from.append(s + int(hit[a]))
                    out_to.append(s + int(hit[b]) + length)
        return pa.table({"doc_id": pa.array(out_doc, pa.int64()), "whole": pa.array(out_whole, pa.int64()), "lo": pa.array(out_from, pa.int64()), "hi": pa.array(out_to, pa.int64())})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the words that none of their own spans covers; rows with the same id may have spans of other texts beside."""
    for batch in batches:
        texts, removed = [], []
        found = ts.scan(batch.column("text"), ts.SPACED, lower=False)
        wholes = _wholes(found, found.hashes(), np.arange(batch.num_rows), batch.num_rows)
        for text, spans, whole in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), wholes.tolist(), strict=True):
            words = (text or "").encode().split()
            keep = np.ones(len(words), bool)
            for span in spans or ():
                if span["whole"] == whole:
                    keep[span["lo"] : span["hi"]] = False
            removed.append(int(len(words) - keep.sum()))
            texts.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(wholes, pa.int64()), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["doc_id", "whole", "kept", "n_removed"]
        )


def find_copied_spans(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, spans): per row its size, hashes and head (first equal document); per id the copied word ranges of each of its texts."""
    sketches = cut(
        texts.mapInArrow(_sketches(length), "doc_id long, n_words long, sha string, whole long, anchors array<long>")
    )
    known = sketches.where("doc_id is not null and n_words >= {}".format(length))
    heads = known.groupBy("sha", "n_words", "whole").agg(F.min("doc_id").alias("head"))
    unique = heads.select(F.col("head").alias("doc_id"), "n_words", "whole").join(known, ["doc_id", "n_words", "whole"])
    anchors = unique.select("doc_id", F.explode(F.array_distinct("anchors")).alias("anchor"))
    recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor")
    wanted = cut(anchors.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")))
    total = wanted.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0)).alias("n")).first()["n"]
    shards = max(12, -(-total // SHARD_STRETCHES))
    spans = (
        texts.join(wanted, "doc_id")
        .mapInArrow(_stretches(length, shards), "shard long, doc_id long, whole long, start long, words binary")
        .groupBy("shard")
        .applyInArrow(_searched(length), "doc_id long, whole long, lo long, hi long")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("whole", "lo", "hi")).alias("spans"))
    )
    return sketches.join(heads, ["sha", "n_words", "whole"], "left").drop("anchors"), cut(spans)


def remove_copied_substrings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, texts_out: bool = False
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space); kept itself if texts_out.

    Defined results: a null text has no words; texts of fewer words than a window lose none; rows that
    share an id are documents of their own, none of which makes a window of another a copy; a row whose id is null
    is neither compared nor changed. Other columns are not looked at. texts_out gives (doc_id, kept, n_removed) per row.
    """
    if length <= ANCHOR:
        raise ValueError(f"a window needs more than {ANCHOR} words")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches, spans = find_copied_spans(texts, length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    changed = texts.join(spans, "doc_id").mapInArrow(_kept, "doc_id long, whole long, kept string, n_removed long")
    copies = F.col("head") < F.col("doc_id")
    if texts_out:

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = ts.scan(batch.column("text"), ts.SPACED, lower=False)
                wholes = _wholes(found, found.hashes(), np.arange(batch.num_rows), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wholes, pa.int64())], names=["doc_id", "text", "whole"])

        rows = texts.mapInArrow(keyed, "doc_id long, text string, whole long")
        marks = sketches.select("doc_id", "whole", "n_words", "head").distinct()
        rows = rows.join(marks, ["doc_id", "whole"], "left").join(changed.distinct(), ["doc_id", "whole"], "left")
        spaced = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t-\r]+"), lambda w: w != ""), " ")
        return rows.select(
            "doc_id",
            F.when(copies, F.lit("")).otherwise(F.coalesce("kept", spaced)).alias("kept"),
            F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        )
    done = changed.select("doc_id", "whole", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")).distinct()
    return sketches.join(done, ["doc_id", "whole"], "left").select(
        "doc_id",
        "n_words",
        F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copies, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
