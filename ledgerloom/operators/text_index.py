"""An inverted index over texts: postings packed in blocks, conjunctions from the rarest term on.

A text becomes terms by a segmentation, which makes it a text with white space between terms; the index keeps it and asks with the same one.
A document that has all terms of a question matches it; its score is how often it has them.

A block holds the postings of the documents that a task reads together: one row per term with the documents, how often each has the term,
and how many distinct terms it has, packed as bytes. So building takes one scan and no shuffle; texts are cut into terms in Arrow. One more
scan of the blocks takes out the postings of the questions' rarest terms. A question reads all postings of its rarest one; the
documents found are looked up in their own blocks' postings of the next rarest ones, and what has those as well is verified
on its text. Questions with the same terms are asked once.

Defined results: null and empty texts have no terms; they match nothing and ask for nothing. doc_id is the documents' key. Equal scores go by
the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerloom.session import saved

#: Documents of a packed block of postings, and bytes of their texts after which a block ends.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
PACKED = "term string, block long, n int, entries binary"
#: A document that has a term: how often, and how many distinct terms it has.
ENTRY = np.dtype([("docs", "<i8"), ("counts", "<i4"), ("sizes", "<i4")])
POSTINGS = "term string, block long, docs array<long>, counts array<int>, sizes array<int>"
#: Terms of a question, rarest first, whose postings are read; the rest is verified on the texts of what they leave.
LEADING = 3
#: Documents, or terms, up to this many are looked up by a broadcast.
BROADCAST_IDS = 200_000


# --- segmentations --------------------------------------------------------------------------


@dataclass(frozen=True)
class Segmentation:
    """spaced makes of a text one whose terms are what stands between white space; called, it gives the array of terms."""

    spaced: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return F.filter(F.split(self.spaced(text), "[ \\t\\n\\r]+"), lambda w: w != "")


#: Words between white space, lower case.
words = Segmentation(F.lower)


def compounds(phrases: Sequence[str]) -> Segmentation:
    """Words, but neighbours that make one of the phrases (lower case, words apart by one space) are one term with '_' in it.

    The leftmost phrase wins, of those the longest.
    """
    listed = "|".join(_literal(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    pattern = f"(?:{listed}) |[^ ]+ " if phrases else "[^ ]+ "

    def spaced(text: Column) -> Column:
        found = F.regexp_extract_all(F.concat(F.array_join(words(text), " "), F.lit(" ")), F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(found, lambda t: F.translate(F.trim(t), " ", "_")), " ")

    return Segmentation(spaced)


def _literal(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):X}}}" for c in phrase)


# --- the index ------------------------------------------------------------------------------


@dataclass
class TextIndex:
    """texts(doc_id, text), blocks(term, block, n, entries): packed postings of n documents each."""

    segment: Segmentation
    texts: DataFrame
    blocks: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, block, docs, counts, sizes)"""
        return unpacked(self.blocks)

    @property
    def frequencies(self) -> DataFrame:
        """(term, n): in how many documents."""
        return self.blocks.groupBy("term").agg(F.sum("n").alias("n"))


def split(spaced: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts one after the other, and each one's text."""
    spaced = spaced.cast(pa.large_string())
    starts = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]].copy()
    data[(data == 9) | (data == 10) | (data == 13)] = 32
    plain = pa.Array.from_buffers(pa.large_string(), len(spaced), [None, pa.py_buffer(starts - starts[0]), pa.py_buffer(data)])
    pieces = pc.split_pattern(plain, " ")
    of = np.repeat(np.arange(len(spaced)), pieces.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(pieces.flatten()), 0)
    return pieces.flatten().filter(some), of[some.to_numpy(zero_copy_only=False)]


def packed(block: int, docs: np.ndarray, spaced: pa.Array) -> pa.RecordBatch:
    """The postings of a block, from its documents' spaced texts."""
    terms, of = split(spaced)
    coded = terms.dictionary_encode()
    # (term, document) pairs, in this order, each once
    pair, n = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + of, return_counts=True)
    term, doc = np.divmod(pair, max(1, len(docs)))
    entries = np.empty(len(pair), ENTRY)
    entries["docs"], entries["counts"], entries["sizes"] = docs[doc], n, np.bincount(doc, minlength=len(docs))[doc]
    starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(coded.dictionary), [None, pa.py_buffer(starts * np.int32(ENTRY.itemsize)), pa.py_buffer(entries)])
    return pa.record_batch([coded.dictionary.cast(pa.string()), pa.array(np.full(len(rows), block)), pa.array(np.diff(starts)), rows], names=["term", "block", "n", "entries"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """Packed postings as rows of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                starts = pa.array(np.append(0, np.cumsum(part.column("n").to_numpy())), pa.int32())
                entries = np.frombuffer(b"".join(part.column("entries").to_pylist()), ENTRY)
                lists = [pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(entries[x]))) for x in ENTRY.names]
                yield pa.record_batch([part.column("term"), part.column("block"), *lists], names=["term", "block", *ENTRY.names])

    return blocks.mapInArrow(run, POSTINGS)


def build_text_index(docs: DataFrame, segment: Segmentation = words) -> TextIndex:
    """An index of docs(doc_id, text)."""
    texts = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in batches:
            ends = np.cumsum(pc.binary_length(part.column("spaced")).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < part.num_rows:
                upto = np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")
                rows = part.slice(at, min(max(1, int(upto) - at), BLOCK))
                yield packed(number, rows.column("doc_id").to_numpy(), rows.column("spaced"))
                number, at = number + 1, at + rows.num_rows

    spaced = texts.where("doc_id is not null and text is not null").select("doc_id", segment.spaced(F.col("text")).alias("spaced"))
    return TextIndex(segment, texts, saved(spaced.mapInArrow(run, PACKED)))


@F.arrow_udf(LongType())
def occurrences(asked: pa.Array, terms: pa.Array) -> pa.Array:
    """How often all of the asked terms, which are distinct, occur together; null if one is missing."""
    found = []
    for wanted, has in zip(asked, terms, strict=True):
        places = pc.index_in(has.values, value_set=wanted.values).drop_null()
        found.append(len(places) if len(places.unique()) == len(wanted) else None)
    return pa.array(found, pa.int64())


def few(keys: DataFrame) -> DataFrame:
    """Keys for a semi join, broadcast if they are few; keys should be materialised, as they are counted."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def conjunctive(index: TextIndex, asked: DataFrame, k: int) -> DataFrame:
    """asked(query_id, text) -> (query_id, doc_id, score, rank): the k documents that have all terms, most often first."""
    terms = F.array_sort(F.array_distinct(index.segment(F.col("text"))))
    queries = asked.select("query_id", terms.alias("terms")).where(F.size("terms") > 0).withColumn("same", F.md5(F.array_join("terms", "\n").cast("binary")))
    queries = saved(queries)
    unique = saved(queries.groupBy("same").agg(F.first("terms").alias("terms")))
    known = unique.select("same", F.size("terms").alias("need"), F.explode("terms").alias("term")).join(index.frequencies, "term")
    # a bounded list per question: its rarest terms
    place = F.row_number().over(Window.partitionBy("same").orderBy("n", "term"))
    of_all = F.count("*").over(Window.partitionBy("same"))
    leading = known.select("*", place.alias("place"), of_all.alias("known")).where(f"known = need and place <= {LEADING}")
    leading = saved(leading.groupBy("same", "need").pivot("place", list(range(1, LEADING + 1))).agg(F.first("term")))
    first, *rest = [str(i) for i in range(1, LEADING + 1)]
    wanted = saved(leading.select(F.explode(F.array(first, *rest)).alias("term")).where("term is not null").distinct())
    postings = saved(unpacked(index.blocks.join(few(wanted), "term", "left_semi")))  # those of other terms aren't moved
    found = leading.join(postings.select(F.col("term").alias(first), "block", "docs", "sizes"), first)
    hits = found.select("same", "need", *rest, "block", F.explode(F.arrays_zip("docs", "sizes")).alias("p")).where("p.sizes >= need").select("same", *rest, "block", F.col("p.docs").alias("doc_id"))
    for column in rest:
        hits = hits.join(postings.select(F.col("term").alias(column), "block", "docs"), [column, "block"], "left").where(F.col(column).isNull() | F.array_contains("docs", F.col("doc_id"))).drop("docs")
    hits = saved(hits.select("same", "doc_id"))
    ids = saved(hits.select("doc_id").distinct())
    texts = index.texts.join(few(ids), "doc_id", "left_semi").select("doc_id", index.segment(F.col("text")).alias("found"))
    scored = hits.join(unique, "same").join(texts, "doc_id").select("same", "doc_id", occurrences("terms", "found").alias("score")).where("score is not null")
    best = F.row_number().over(Window.partitionBy("same").orderBy(F.desc("score"), "doc_id"))
    ranked = scored.withColumn("rank", best.cast("long")).where(F.col("rank") <= k)
    return queries.select("query_id", "same").join(ranked, "same").select("query_id", "doc_id", "score", "rank")
