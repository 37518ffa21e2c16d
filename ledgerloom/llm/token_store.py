"""Token-id output as directly addressable codes.

Format. A store is a folder of Parquet files written by Spark; a row is one segment, a run of whole
documents in ascending id order. Columns: ``range`` and ``seq`` (its place in that order), ``own`` (ids
before it in its range), ``n_tokens``, ``docs`` (int64 ids), ``counts`` (uint32 tokens of each) and the
code's levels. Level 0 holds the low CHUNK_BITS[0] bits of every id, one byte each; where an id has higher
bits a continuation bitmap (uint64 words) is set, and level 1 holds the next chunk of just those ids,
and so on. A rank directory (uint32 per bitmap word: bits set before it) turns a position on one
level into its position on the next, so any token is read by a few array accesses; no block is
decoded. Spark does all file access, so the folder may be in any store that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import new_folder

#: Bits of an id on each level (8-bit cells); the sum covers every 32-bit id.
CHUNK_BITS = (8, 8, 8, 8)
#: Tokens after which a segment ends (it ends with a document).
SEGMENT_TOKENS = 1 << 18
#: Distinct pieces whose ids a worker remembers; beyond that it keeps the half that is used most.
CACHE_PIECES = 600_000
#: Pieces that are encoded as one text.
JOINED = 16
END_ID = 0

SEGMENT_SCHEMA = (
    "range int, seq int, own long, n_tokens long, docs binary, counts binary, levels array<binary>, more array<binary>, ranks array<binary>"
)


# --- the code -------------------------------------------------------------------------------


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of a run of ids."""
    levels, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    for bits in CHUNK_BITS:
        levels.append((rest & np.uint32((1 << bits) - 1)).astype(np.uint8).tobytes())
        high = rest >> np.uint32(bits)
        goes_on = high > 0
        if not goes_on.any():
            break
        padded = np.zeros(-(-len(rest) // 64) * 64, np.uint8)
        padded[: len(rest)] = goes_on
        words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        more.append(words.tobytes())
        ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
        rest = high[goes_on]
    return levels, more, ranks


def dac_get(levels: list[bytes], more: list[bytes], ranks: list[bytes], at: int) -> int:
    """One id by its position, through the rank directories."""
    value, shift = 0, 0
    for k, bits in enumerate(CHUNK_BITS[: len(levels)]):
        value |= levels[k][at] << shift
        if k == len(more):
            break
        word = int.from_bytes(more[k][8 * (at >> 6) : 8 * (at >> 6) + 8], "little")
        if not word >> (at & 63) & 1:
            break
        before = (word & ((1 << (at & 63)) - 1)).bit_count()
        at = int.from_bytes(ranks[k][4 * (at >> 6) : 4 * (at >> 6) + 4], "little") + before
        shift += bits
    return value


def dac_decode(levels: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    where, shift = np.arange(len(out)), 0
    for k, bitmap in enumerate(more):
        shift += CHUNK_BITS[k]
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(where), bitorder="little").astype(bool)
        where = where[bits]
        out[where] |= np.frombuffer(levels[k + 1], np.uint8).astype(np.uint32) << np.uint32(shift)
    return out


# --- tokens ---------------------------------------------------------------------------------


_SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A piece of which a space is beside other white space, at an end of the text, or near a special token.
UNSURE = rf"(?s)\A ?\z|{_SPACE}\z|\A.{_SPACE}|<\|"


class Encoder:
    """The tokenizer with a bounded memory of pieces, as Arrow strings with their ids on end.

    The byte-level vocabulary's word pattern lets a token start with a space but never run across
    one, so a text whose spaces all stand between two characters that aren't white space equals
    the sum of its pieces; all other texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes that each id stands for: a byte-level token has a character for each.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)
        self.unsure = np.zeros(0, bool)
        self.uses = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and how many of each. They may stand side by side, so they are encoded together and told apart by their bytes."""
        texts = pieces.to_numpy(zero_copy_only=False).tolist()
        ids = self._flat(self._encode(["".join(texts[at : at + JOINED]) for at in range(0, len(texts), JOINED)]))
        ends = np.concatenate([[0], np.cumsum(self.width[ids])])
        stop = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False), dtype=np.int64)
        upto = np.searchsorted(ends, stop)
        if len(stop) and (ends[-1] != stop[-1] or (ends[upto] != stop).any()):  # a token across an edge
            each = self._encode(texts)
            return self._flat(each), np.fromiter(map(len, each), np.int64, len(each))
        return ids, np.diff(upto, prepend=0)

    @staticmethod
    def _flat(lists: list[list[int]]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(lists), np.uint32)

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """The places that these pieces get in the memory."""
        unsure = pc.match_substring_regex(fresh, UNSURE).to_numpy(zero_copy_only=False)
        goes_on = pc.starts_with(fresh, " ").to_numpy(zero_copy_only=False)
        # those that start a text, those that go on, and those whose texts are encoded whole, which need no ids
        start, on, none = (np.flatnonzero(x) for x in (~unsure & ~goes_on, ~unsure & goes_on, unsure))
        alone = self._encode(fresh.take(pa.array(start)).to_pylist())
        ids, sizes = self._encode_pieces(fresh.take(pa.array(on)))
        order = np.concatenate([start, on, none])
        self.known = pa.concat_arrays([self.known, fresh.take(pa.array(order))])
        self.flat = np.concatenate([self.flat, self._flat(alone), ids])
        self.size = np.concatenate([self.size, np.fromiter(map(len, alone), np.int64, len(alone)), sizes, np.zeros(len(none), np.int64)])
        self.unsure = np.concatenate([self.unsure, unsure[order]])
        self.uses = np.concatenate([self.uses, np.zeros(len(order), np.int64)])
        codes = np.empty(len(order), np.int64)
        codes[order] = np.arange(len(self.known) - len(order), len(self.known))
        return codes

    def _forget(self) -> None:
        """Keep the more used half of what may be remembered; uses fade."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_PIECES // 2])
        at = np.repeat(np.cumsum(self.size)[kept] - np.cumsum(self.size[kept]), self.size[kept]) + np.arange(self.size[kept].sum())
        self.flat, self.known = self.flat[at], self.known.take(pa.array(kept))
        self.size, self.unsure, self.uses = self.size[kept], self.unsure[kept], self.uses[kept] // 2

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many of each."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        pieces = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
        coded = pieces.flatten().dictionary_encode()
        code_of = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        if (fresh := code_of < 0).any():
            code_of[fresh] = self._learn(coded.dictionary.filter(pa.array(fresh)))
        codes = code_of[coded.indices.to_numpy(zero_copy_only=False)]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        upto = np.cumsum(np.concatenate([[0], pieces.value_lengths().to_numpy(zero_copy_only=False)]))
        doubts = np.concatenate([[0], np.cumsum(self.unsure[codes])])
        doubted = (doubts[upto[1:]] > doubts[upto[:-1]]) | pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(doubted & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)).tolist()
        start = np.cumsum(self.size) - self.size
        lengths = self.size[codes]
        ends = np.cumsum(lengths)
        spread = np.repeat(start[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        all_ids = self.flat[spread]
        ends = np.concatenate([[0], ends])
        counts = ends[upto[1:]] - ends[upto[:-1]]
        if whole:
            ids_of = dict(zip(whole, self._encode(texts.take(pa.array(whole)).to_pylist()), strict=True))
            parts, at = [], 0
            for i, c in enumerate(counts.tolist()):
                parts.append(np.array(ids_of[i], np.uint32) if i in ids_of else all_ids[at : at + c])
                at += c
            counts = np.array([len(x) for x in parts], np.int64)
            all_ids = np.concatenate(parts)
        return all_ids, counts


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _tokenizer_path(name: str) -> str:
    """Looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text that are tokenized at once.
BATCH_BYTES = 8 << 20


def _segments(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        encoder = _encoder(_tokenizer_path(tokenizer))
        docs: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        held, seq, part, own = 0, 0, 0, 0

        def segment() -> pa.RecordBatch:
            nonlocal held, seq, own
            ids = np.concatenate(parts)
            levels, more, ranks = dac_encode(ids)
            row = pa.RecordBatch.from_pydict(
                {
                    "range": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "own": pa.array([own], pa.int64()),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "docs": pa.array([np.array(docs, "<i8").tobytes()], pa.binary()),
                    "counts": pa.array([np.array(counts, "<u4").tobytes()], pa.binary()),
                    "levels": pa.array([levels], pa.list_(pa.binary())),
                    "more": pa.array([more], pa.list_(pa.binary())),
                    "ranks": pa.array([ranks], pa.list_(pa.binary())),
                }
            )
            docs.clear(), counts.clear(), parts.clear()
            held, seq, own = 0, seq + 1, own + len(ids)
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("range")[0].as_py()
            texts = batch.column("text")
            ids = batch.column("doc_id").to_pylist()
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_BYTES, "right")))
                flat, each = encoder.run(texts.slice(at, to - at))
                stop = np.cumsum(each)
                for i, (n, e) in enumerate(zip(each.tolist(), stop.tolist(), strict=True)):
                    docs.append(ids[at + i])
                    counts.append(n + 1)
                    parts.append(flat[e - n : e])
                    parts.append(np.array([END_ID], np.uint32))
                    held += n + 1
                    if held >= SEGMENT_TOKENS:
                        yield segment()
                at = to
        if docs:
            yield segment()

    return run


def write_token_store(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json"
) -> DataFrame:
    """Write the documents' ids, each document closed by id 0, in ascending id order; returns the segments' directory.

    Defined results: a null or empty text is the closing id alone; rows that repeat an id are stored one
    after the other; rows whose id is null are left out, as they have no place in the order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null"
    )
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("range", F.spark_partition_id())
    raw = f"{path}/segments"
    dealt.mapInArrow(_segments(tokenizer), SEGMENT_SCHEMA).write.option("compression", "none").parquet(raw)
    return read_directory(docs.sparkSession, path)


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Segments with start, the ids before them.

    Only the ranges' totals, one row for each task that wrote, are summed in one task and broadcast.
    """
    seg = spark.read.parquet(f"{path}/segments")
    total = seg.groupBy("range").agg(F.sum("n_tokens").alias("all"))
    before = total.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("base"))
    return seg.join(F.broadcast(before), "range").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(range, seq, n_tokens, start) of every segment: a few numbers for each 2**18 tokens."""
    return _with_starts(spark, path).select("range", "seq", "n_tokens", "start")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = dac_decode(row["levels"], row["more"]).astype("<u4")
            counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
            stop = np.cumsum(counts)
            view = memoryview(ids.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(row["docs"], "<i8"), pa.int64()),
                    pa.array(row["start"] + stop - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(view[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), stop.tolist(), strict=True)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and ids_crc32, decoded from the files."""
    return _with_starts(spark, path).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Random access: positions(position) -> (position, token); each is one walk through the rank directories.

    Positions outside the store have no row.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [dac_get(row["levels"], row["more"], row["ranks"], p - row["start"]) for p in row["asked"]]
                yield pa.RecordBatch.from_pydict({"position": pa.array(row["asked"], pa.int64()), "token": pa.array(found, pa.int64())})

    where = read_directory(spark, path)
    step = SEGMENT_TOKENS
    cells = where.select("range", "seq", "start", "n_tokens", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("n_tokens") - 1) / step))).alias("cell"))
    asked = positions.where("position is not null").withColumn("cell", F.floor(F.col("position") / step))
    hit = asked.join(cells, "cell").where("position >= start and position < start + n_tokens")
    grouped = hit.groupBy("range", "seq").agg(F.collect_list("position").alias("asked"), F.first("start").alias("start"))
    return spark.read.parquet(f"{path}/segments").join(grouped, ["range", "seq"]).mapInArrow(pick, "position long, token long")


def new_store_path(spark: SparkSession) -> str:
    """A fresh folder in the shared place; it goes when Python ends."""
    return new_folder(spark, "token-store")
