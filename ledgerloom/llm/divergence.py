"""Source divergence audit: how far the sources of a language differ in the words they use.

Words are counted by length-bucketed packing. In each slice of texts a term of up to 8 bytes becomes one uint64, one of
up to 16 bytes two; these are radix-sorted (16 bits a step, least digit first) and run-counted in numpy. Longer terms
go into buckets by width, each sorted by bytes. What leaves a task is one row per slice, group and term; Spark adds
the rows up. A (lang, source) pair is a group.

A language keeps the terms in at least MIN_DOCS of its documents. All arithmetic is on whole numbers.

Defined results: null text, lang and source count as ''. Every row is a document, so repeated rows and ids count each time, and
null ids count as well. A group without terms still has its pairs; a language with no kept term has pairs of value 0.
Texts of any length are read whole; a term may be as long as its text. Ties go by the item's UTF-8 bytes. An empty table
gives no rows. Only text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.joins import join_per_key
from ledgerloom.llm.textscan import scan, slices, word_table
from ledgerloom.session import saved

MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Terms are runs of ASCII letters and of bytes above 0x7F.
LETTERS = word_table(bytes(b for b in range(0x80) if not chr(b).isalpha()))
#: Rows of term counts that one task compares, and terms and sources that are compared at once in it.
BLOCK_ROWS, CHUNK_TERMS, TILE = 200_000, 4096, 128
COUNTED = "lang string, source string, term string, n long, docs long"
PAIRED = "lang string, a int, b int, value long, seen long"


# --- counting terms in a slice --------------------------------------------------------------


def pack(data: np.ndarray, start: np.ndarray, size: np.ndarray, n_words: int) -> np.ndarray:
    """(terms, n_words) uint64: each term's bytes, zeros after its end. No term has a zero byte."""
    at = np.arange(8 * n_words)
    inside = at < size[:, None]
    found = np.zeros(inside.shape, np.uint8)
    found[inside] = data[(start[:, None] + at)[inside]]
    return found.view(np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by the keys, the first one least: numpy sorts 16-bit digits by radix."""
    order = np.arange(len(keys[0]))
    for key in keys:
        digits = np.ascontiguousarray(key).view(np.uint16).reshape(len(key), -1)
        for k in range(digits.shape[1]):
            digit = digits[:, k]
            if (digit != digit[:1]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(same: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted items, same[i] says that i equals i - 1: first item, length and number of documents of each run."""
    first = np.flatnonzero(~same)
    new_doc = ~same
    new_doc[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(same))), np.add.reduceat(new_doc.astype(np.int64), first)


def texts_of(rows: np.ndarray) -> pa.Array:
    """Byte rows padded with zeros, as strings."""
    used = rows != 0
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(used.sum(1), out=ends[1:])
    flat = pa.py_buffer(rows[used].tobytes())
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), flat])
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(ends), flat])


def count_terms(column: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of a slice's texts, by buckets of term length."""
    found = scan(column, LETTERS, lower=True)
    size = found.end - found.start
    doc = np.repeat(np.arange(len(found.first) - 1, dtype=np.int32), np.diff(found.first))
    of = group.astype(np.uint32)[doc]
    low = 0
    width = 8
    while low < (size.max() if len(size) else 0):
        at = np.flatnonzero((size > low) & (size <= width))
        low, width = width, 2 * width
        if not len(at):
            continue
        g, d = of[at], doc[at]
        if low <= 16:
            words = pack(found.data, found.start[at], size[at], low // 8)
            order = radix_order([*words.T, g])
            words, g, d = words[order], g[order], d[order]
            equal = (words[1:] == words[:-1]).all(1)
            rows = words.view(np.uint8).reshape(len(words), low)
        else:
            rows = pack(found.data, found.start[at], size[at], low // 8).view(np.uint8).reshape(len(at), low)
            named = rows.view(f"S{low}").ravel()
            order = np.argsort(named, kind="stable")
            order = order[radix_order([g[order]])]
            named, rows, g, d = named[order], rows[order], g[order], d[order]
            equal = named[1:] == named[:-1]
        same = np.zeros(len(g), bool)
        same[1:] = equal & (g[1:] == g[:-1])
        first, n, docs = runs(same, d)
        yield g[first], texts_of(rows[first]), n, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            pairs = pa.table({"lang": part.column("lang"), "source": part.column("source"), "at": np.arange(part.num_rows)})
            groups = pairs.group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
            members = groups.column("at_list").combine_chunks()
            group = np.empty(part.num_rows, np.int64)
            group[members.values.to_numpy()] = np.repeat(np.arange(len(groups)), members.value_lengths().to_numpy())
            for g, term, n, in_docs in count_terms(part.column("text"), group):
                names = [groups.column(c).combine_chunks().take(pa.array(g)) for c in ("lang", "source")]
                yield pa.record_batch([*names, term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    per_slice = docs.select("text", "lang", "source").mapInArrow(run, COUNTED)
    return per_slice.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- the audit ------------------------------------------------------------------------------


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)); null where nothing is kept."""
    part = F.lit(UNIT).cast("decimal(12,0)") * (count + 2).cast("decimal(20,0)")
    whole = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", part, whole))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare(rows: pa.Table, sources: pa.Table, tiles: tuple[int, int], tile: int) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, sum of gaps over the terms here, number of terms here) for each pair of sources of the two tiles."""
    place = sources.column("at").to_numpy()
    order = np.argsort(place)
    place = place[order]
    rest = np.nan_to_num(sources.column("rest").to_numpy(zero_copy_only=False)[order]).astype(np.int64)
    left = np.flatnonzero(place // tile == tiles[0])
    beyond = lambda x: x + 1 if tiles[0] == tiles[1] else len(left)  # noqa: E731  (first source to compare x with)
    total = np.zeros((len(place), len(place)), np.int64)
    term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    column = np.searchsorted(place, rows.column("at").to_numpy())
    p = rows.column("p").to_numpy()
    by_term = np.argsort(term, kind="stable")
    term, column, p = term[by_term], column[by_term], p[by_term]
    n_terms = int(term[-1]) + 1 if len(term) else 0
    for begin in range(0, n_terms, CHUNK_TERMS):
        i, j = np.searchsorted(term, [begin, begin + CHUNK_TERMS])
        # a source's shares lie side by side; where it lacks a term it has the share of a count of zero
        shares = np.repeat(rest[:, None], min(CHUNK_TERMS, n_terms - begin), 1)
        shares[column[i:j], term[i:j] - begin] = p[i:j]
        for x in left:
            y = beyond(x)
            apart = shares[y:] - shares[x]
            total[x, y:] += (apart * apart // (shares[y:] + shares[x])).sum(1)
    for x in left:
        for y in range(beyond(x), len(place)):
            yield int(place[x]), int(place[y]), int(total[x, y]), n_terms


def pair_gaps(kept: DataFrame, groups: DataFrame, tile: int, block_rows: int) -> DataFrame:
    """(lang, a, b, value, seen) per pair of sources a < b by place, summed over all blocks of terms.

    kept(lang, source, term, at, p), groups(lang, source, at, rest). Terms are dealt over blocks by hash, sources over tiles;
    a task compares two tiles in one block, so what it holds is bounded however many terms or sources a language has.
    """
    blocks = max(1, -(-kept.count() // block_rows))
    tiles = F.expr(f"int(n_sources div {tile} + int(n_sources % {tile} > 0))")
    own = F.expr(f"int(at div {tile})")

    def dealt(df: DataFrame) -> DataFrame:
        """Each row once for every tile that its own is compared with."""
        other = F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
        return df.select("*", own.alias("own"), other).withColumn("ta", F.least("own", "other")).withColumn("tb", F.greatest("own", "other"))

    rows = dealt(kept).select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "ta", "tb", "term", "at", "p")
    named = dealt(groups).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(*[F.col(c).alias(c) for c in ("lang", "block", "ta", "tb", "at", "rest")])
    keys = ["lang", "block", "ta", "tb"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, _, ta, tb = (k.as_py() for k in key)
        found = list(compare(left, right, (ta, tb), tile))
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        a, b, value, seen = (list(c) for c in columns)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64()), "seen": pa.array(seen, pa.int64())})

    out = rows.groupBy(*keys).cogroup(named.groupBy(*keys)).applyInArrow(run, PAIRED)
    return out.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by distance ('pair'), and the
    terms that a source uses most beyond its language ('term', up to top_terms).

    tile and block_rows bound what one task compares at once and change no result.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).select(
        "*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("least")
    )
    kept = saved(counted.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("leads")))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("leads").alias("led"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    lang, ordered = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("total").over(lang), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("led").over(lang), F.lit(0)).alias("n_kept"),
        (F.row_number().over(ordered) - 1).alias("at"), F.count("*").over(lang).alias("n_sources"),
    )
    groups = saved(groups.withColumn("rest", share(F.lit(0), F.col("total"), F.col("n_kept"))))

    shares = join_per_key(kept.drop("leads"), groups, ["lang", "source"], ["term"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("n_kept"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("n_kept")))
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", best).where(F.col("rank") <= top_terms)

    name = lambda x: groups.select("lang", F.col("at").alias(x), F.col("source").alias(f"{x}_source"), F.col("rest").alias(f"{x}_rest"))
    pairs = pair_gaps(shares.select("lang", "source", "term", "at", "n_sources", "p"), groups, tile, block_rows)
    pairs = pairs.join(name("a").join(groups.select("lang", F.col("at").alias("a"), "n_kept"), ["lang", "a"]), ["lang", "a"]).join(name("b"), ["lang", "b"])
    elsewhere = F.coalesce((F.col("n_kept") - F.col("seen")) * gap(F.col("a_rest"), F.col("b_rest")), F.lit(0))
    pairs = pairs.withColumn("value", F.col("value") + elsewhere)
    ways = F.explode(F.array(*[F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in ("ab", "ba")]))
    pairs = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return pairs.withColumn("rank", best).unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
