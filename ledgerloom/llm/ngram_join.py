"""N-gram Jaccard self-join by a token-group matrix, down to connected classes of documents.

A token is the hash of one shingle (``shingle`` consecutive words). Two documents link when their
token sets have a Jaccard similarity of ``percent`` / 100 or more. The join is exact:

1. Documents with the same token set form one class at once; the one with the smallest id stands
   for it.
2. Tokens travel as packed arrays to the task of their hash range, which finds those that occur
   in two documents or more; those that recur within a slice of rows are known at once and travel once. What
   recurs is put together by document, again packed. A document of which fewer than ``percent`` of the tokens recur
   cannot link, whatever the groups are: this is the matrix bound with everything else as one group.
3. The documents left are partitioned into groups of similar ones, each around the pivot of most of its
   tokens, with which it is compared at once.
4. The matrix holds, for tokens of several groups, each group's token union. A document's overlap with a
   group's union bounds the overlap with every member: groups below what a link needs are skipped. In
   the groups left, and in its own unless it is of the group's main component, a document is held
   against all members of a near size by their postings, one block of askers and one of members to a task.

A group of copies thus costs one comparison per document that its pivot settles, and no pair is a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import textscan as ts
from ledgerloom.session import cut, saved

#: Tokens that one hash range holds, about; the number of ranges grows with the corpus.
RANGE_TOKENS = 500_000
#: Ranges are cut by the tokens' upper bits; with at least this many (a byte's values) the first byte needn't travel.
LEAST_RANGES = 256
#: Rounds of dropping documents that can't link outside their group, as others have dropped out.
PRUNE_ROUNDS = 2
#: Members of a group, and documents asking for it, that one task holds against each other, about.
BLOCK_MEMBERS = 1000


def need(n, percent: int):
    """Tokens that a set of n has to share with any partner."""
    return -(-n * percent // 100)


def token_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle."""
    words = ts.scan(column, ts.SPACED)
    h = words.hashes()
    w = ts.windows(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(w[a : b - k + 1])
            fresh = np.ones(len(s), bool)
            fresh[1:] = s[1:] != s[:-1]
            out.append(s[fresh])
        elif b > a:
            out.append(np.array([ts.whole(h[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches):
            sets = token_sets(batch.column("text"), k)
            seal = [
                (int(np.bitwise_xor.reduce(ts.mix(s)).view(np.int64)), int(np.sum(ts.mix(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64).view(np.int64)))
                if len(s)
                else (0, 0)
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in seal], pa.int64()),
                    pa.array([y for _, y in seal], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "seal_a", "seal_b"],
            )

    return run


def _steps(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, then the steps between them in as few bytes as the largest needs."""
    gaps = np.diff(ids).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(gaps) or int(gaps.max()) < 1 << 8 * w)
    return ids[:1].tobytes() + gaps.astype(f"<u{width}").tobytes()


def _from_steps(data, n: int) -> np.ndarray:
    """The n ids of _steps()."""
    first = np.frombuffer(data, np.int64, 1)
    if n == 1:
        return first
    gaps = np.frombuffer(data, f"<u{(len(data) - 8) // (n - 1)}", offset=8).astype(np.uint64).view(np.int64)
    return np.concatenate([first, first + np.cumsum(gaps)])


def _rows(key: np.ndarray, ids: np.ndarray, tokens: np.ndarray, width: int) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Documents' tokens by key, packed: the documents, how many tokens of each, and the tokens' last width bytes."""
    if not len(key):
        return {}
    order = np.lexsort((ids, key))
    key, ids, tokens = key[order], ids[order], tokens[order]
    # a run is what one document has under one key, up to 255 tokens
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    cutting = np.flatnonzero((np.arange(len(key)) - begin) % 255 == 0)
    runs = np.diff(np.append(cutting, len(key))).astype(np.uint8)
    flat = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = {}
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist(), strict=True):
        x, y = np.searchsorted(cutting, (a, b))
        out[int(key[a])] = (_steps(ids[cutting[x:y]]), runs[x:y].tobytes(), flat[a:b].tobytes())
    return out


def _dealt(k: int, bits: int):
    """Tokens by hash range. Those that several documents of a slice of rows have are known to recur: the range
    hears of them once, and their documents get them at once (under the keys -1 - bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sets = token_sets(batch.column("text"), k)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            doc = np.repeat(ids, [len(s) for s in sets]).astype(np.int64)
            order = np.argsort(flat)
            flat, doc = flat[order], doc[order]
            fresh = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
            single = fresh & np.append(fresh[1:], True)[: len(flat)]
            known = flat[fresh & ~single]
            rows = _rows((flat[single] >> np.uint64(64 - bits)).astype(np.int64), doc[single], flat[single], 7)
            direct = _rows(-1 - _bucket(doc[~single], bits), doc[~single], flat[~single], 8)
            marks: dict[int, bytes] = {}
            part = (known >> np.uint64(64 - bits)).astype(np.int64)
            for one in np.unique(part).tolist():
                a, b = np.searchsorted(part, (one, one + 1))
                marks[one] = known[a:b].tobytes()
            found = sorted({*rows, *direct, *marks})
            both = rows | direct
            packed = [both.get(x, (b"", b"", b"")) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), *[pa.array([x[i] for x in packed], pa.binary()) for i in range(3)], pa.array([marks.get(x, b"") for x in found], pa.binary())],
                names=["part", "docs", "runs", "tokens", "known"],
            )

    return run


def _bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    """Where a document's recurring tokens are put together."""
    return (ts.mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _unpacked(table: pa.Table, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and tokens of packed rows; top is the tokens' first byte where it was left out."""
    each = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("runs")]
    ids = np.concatenate([_from_steps(x.as_buffer(), len(r)) if len(r) else np.zeros(0, np.int64) for x, r in zip(table.column("docs"), each, strict=True)])
    runs = np.concatenate(each)
    data = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("tokens")])
    if top is None:
        tokens = data.view("<u8")
    else:
        wide = np.full((len(data) // 7, 8), top, np.uint8)
        wide[:, :7] = data.reshape(-1, 7)
        tokens = wide.reshape(-1).view("<u8")
    return np.repeat(ids, runs), tokens


def _recurring(bits: int):
    """The tokens of one hash range that occur in several documents, packed by the documents' buckets."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            doc, tokens = _unpacked(table)
        else:
            doc, tokens = _unpacked(table, part >> (bits - 8))
            known = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("known")])
            order = np.argsort(tokens)
            doc, tokens = doc[order], tokens[order]
            again = np.zeros(len(tokens), bool)
            same = tokens[1:] == tokens[:-1]
            again[1:] |= same
            again[:-1] |= same
            if len(known):
                known = np.unique(known)
                again |= known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens
            doc, tokens = doc[again], tokens[again]
        rows = _rows(_bucket(doc, bits), doc, tokens, 8)
        return pa.table({"bucket": pa.array(list(rows), pa.int64()), **{n: pa.array([x[i] for x in rows.values()], pa.binary()) for i, n in enumerate(("docs", "runs", "tokens"))}})

    return run


def _assembled(table: pa.Table) -> pa.Table:
    """The recurring tokens of each document of a bucket, sorted."""
    doc, tokens = _unpacked(table)
    order = np.lexsort((tokens, doc))
    doc, tokens = doc[order], tokens[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])
    doc, tokens = doc[fresh], tokens[fresh]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(doc)))
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "held": pa.array(counts, pa.int64()), "tokens": ts.binaries(tokens, counts)})


def _linked(percent: int):
    """Keep the pairs whose similarity is high enough, by their whole token sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n, m in zip(
                batch.column("tokens_a"),
                batch.column("tokens_b"),
                batch.column("n_a").to_pylist(),
                batch.column("n_b").to_pylist(),
                strict=True,
            ):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (n + m - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["x", "to"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that link, as (x, to)."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").mapInArrow(_linked(percent), "x long, to long")


def roots(forest: DataFrame, rounds: int = 40) -> DataFrame:
    """forest(x, to), an edge to each x's parent -> the same with each tree's root, by doubling."""
    for _ in range(rounds):
        onward = forest.select(F.col("x").alias("to"), F.col("to").alias("next"))
        step = forest.select("x", "to").join(onward.hint("merge"), "to", "left").select("x", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
        forest = cut(step)
        if forest.where("moved").isEmpty():
            return forest.drop("moved")
    raise RuntimeError("the forest is too deep")


def merged(label: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """label(doc_id, comp) joined further along links(x, to) between components.

    In each round a component follows its smallest neighbour below it; that makes a forest, whose roots
    are found by doubling. Links that the forest left out are seen again, between larger components.
    """
    for _ in range(rounds):
        for end in ("x", "to"):
            now = label.select(F.col("doc_id").alias(end), F.col("comp").alias(f"{end}_now")).hint("merge")
            links = links.join(now, end).drop(end).withColumnRenamed(f"{end}_now", end)
        links = cut(links.where("x <> to").select(F.greatest("x", "to").alias("x"), F.least("x", "to").alias("to")).distinct())
        if links.isEmpty():
            return label
        forest = roots(links.groupBy("x").agg(F.min("to").alias("to")))
        label = cut(label.withColumnRenamed("comp", "x").join(forest.hint("merge"), "x", "left").select("doc_id", F.coalesce("to", "x").alias("comp")))
    raise RuntimeError("components did not settle")


def _stars(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(group, label): groups of similar documents, and components by links with their pivots.

    A token's pivot is the document most of whose tokens recur (an original rather than a changed copy). A
    document is compared with the pivot of most of its tokens, and belongs to its group if they are a third
    or more; pivots follow their own, always towards documents that recur more.
    """
    rows = sets.mapInArrow(_exploded, "doc_id long, n long, token long, held long").select("token", "doc_id", F.floor(255 * F.col("held") / F.col("n")).cast("short").alias("share"))
    order = F.struct(F.col("share"), -F.col("doc_id"))
    pivot = rows.groupBy("token").agg(F.max_by("doc_id", order).alias("b"), F.count("*").alias("k")).where("k > 1").drop("k")
    best = cut(
        rows.join(pivot.hint("merge"), "token")
        .where(F.col("doc_id") != F.col("b"))
        .groupBy(F.col("doc_id").alias("a"), "b")
        .agg(F.count("*").alias("shared"))
        .groupBy("a")
        .agg(F.max_by(F.struct("b", "shared"), F.struct("shared", -F.col("b"))).alias("p"))
        .join(sets.select(F.col("doc_id").alias("a"), "n").hint("merge"), "a")
        .select("a", "p.b", (F.col("p.shared") * 3 >= F.col("n")).alias("close"))
    )
    links = _verified(best.select("a", "b"), sets, percent)
    label = merged(sets.select("doc_id", F.col("doc_id").alias("comp")), links)
    tree = roots(best.where("close").select(F.col("a").alias("x"), F.col("b").alias("to")))
    group = sets.select("doc_id").join(tree.hint("merge"), F.col("doc_id") == F.col("x"), "left").select("doc_id", F.coalesce("to", "doc_id").alias("group"))
    return cut(group), label


def _asked_elsewhere(sets: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """(doc_id, group): documents and other groups whose token union may hold a partner.

    The matrix has, for tokens of several groups, each group's token union. A document too few of
    whose tokens lie in other groups is done; of the others, those are asked whose overlap with a group's
    union reaches what any link needs.
    """
    rows = sets.mapInArrow(_exploded, "doc_id long, n long, token long, held long").join(group.hint("merge"), "doc_id")
    for _ in range(PRUNE_ROUNDS):
        several = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("token")
        rows = saved(rows.drop("held").join(several.hint("merge"), "token"))
        able = rows.groupBy("doc_id", "n").agg(F.count("*").alias("held")).where(F.col("held") * 100 >= F.col("n") * percent)
        rows = rows.join(able.select("doc_id", "held").hint("merge"), "doc_id").select("token", "doc_id", "n", "group", "held")
    rows = saved(rows)
    union = rows.select("token", "group").distinct()
    spread = union.groupBy("token").agg(F.count("*").alias("wide"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("wide", "token"))
    prefix = rows.join(spread.hint("merge"), "token").withColumn("rank", rank).where(F.col("rank") <= F.col("held") - F.ceil(F.col("n") * percent / 100) + 1)
    near = prefix.select("token", F.col("group").alias("other")).distinct()
    pairs = prefix.select("token", "doc_id", "n", "group").join(near.hint("merge"), "token").where("group <> other").select("doc_id", "n", F.col("other").alias("group")).distinct()
    held = pairs.join(rows.select("doc_id", "token").hint("merge"), "doc_id").join(union.hint("merge"), ["group", "token"]).groupBy("doc_id", "n", "group").agg(F.count("*").alias("held"))
    return held.where(F.col("held") * 100 >= F.col("n") * percent).select("doc_id", "group")


def _opened(percent: int):
    """Links of asking documents with one block of a group's members, by the members' postings."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        if left.num_rows and right.num_rows:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("tokens")]
            size = right.column("n").to_numpy()
            comp = right.column("comp").to_numpy()
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            known, start = np.unique(flat, return_index=True)
            stop = np.append(start[1:], len(flat))
            for q, n, own in zip(left.column("tokens"), left.column("n").to_pylist(), left.column("comp").to_pylist(), strict=True):
                q = np.frombuffer(q.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(known, q), len(known) - 1)
                at = at[known[at] == q]
                runs = stop[at] - start[at]
                hits = owner[np.repeat(start[at] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())]
                shared = np.bincount(hits, minlength=len(sets))
                for c in np.unique(comp[(100 * shared >= percent * (n + size - shared)) & (comp != own)]).tolist():
                    found.add((own, c))
        pairs = sorted(found)
        return pa.table({"x": pa.array([a for a, _ in pairs], pa.int64()), "to": pa.array([b for _, b in pairs], pa.int64())})

    return run


def _clusters(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, comp) over sets(doc_id, n, tokens): exact components of the links among them."""
    group, label = _stars(sets, percent)
    # in its own group a document asks unless it is of the group's main component, whose members the others meet
    placed = group.join(label.hint("merge"), "doc_id")
    main = placed.groupBy("group", "comp").agg(F.count("*").alias("k")).groupBy("group").agg(F.sum("k").alias("size"), F.max_by("comp", F.struct("k", "comp")).alias("main"))
    main = cut(main)
    own = placed.join(main.hint("merge"), "group").where("comp <> main").select("doc_id", "group")
    asked = cut(own.union(_asked_elsewhere(sets, group, percent)))
    # members lie in blocks of one band of sizes; documents ask, in blocks too, those bands that may hold a partner
    full = sets.join(label.hint("merge"), "doc_id").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    wanted = asked.select("group").distinct()
    members = full.join(group.hint("merge"), "doc_id").join(wanted.hint("merge"), "group")
    blocks = cut(members.groupBy("group", "band").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")))
    members = members.join(blocks.hint("merge"), ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    askers = asked.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("askers"))
    queries = asked.join(askers.hint("merge"), "group").join(full.hint("merge"), "doc_id").withColumn("asker", F.pmod(F.xxhash64("doc_id"), F.col("askers")).cast("int"))
    queries = queries.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).join(blocks.hint("merge"), ["group", "band"])
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # each block of members goes to each block of askers of its group that asks this band
    met = queries.select("group", "band", "block", "asker").distinct()
    members = members.join(met.hint("merge"), ["group", "band", "block"])
    keys, columns = ["group", "band", "block", "asker"], ["group", "band", "block", "asker", "n", "comp", "tokens"]
    dealt = lambda df: df.select(*[F.expr(c).alias(c) for c in columns]).groupBy(*keys)
    links = dealt(queries).cogroup(dealt(members)).applyInArrow(_opened(percent), "x long, to long")
    return merged(label, cut(links))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens")]
        size = np.array([len(x) for x in sets], np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column("doc_id").to_numpy(), size), pa.int64()),
                pa.array(np.repeat(batch.column("n").to_numpy(), size), pa.int64()),
                pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64()),
                pa.array(np.repeat(size, size), pa.int64()),
            ],
            names=["doc_id", "n", "token", "held"],
        )


def near_duplicate_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    component_id is the smallest document id reachable by links, the document's own included.
    Defined results: a null or empty text, or one without words, has n_shingles 0 and links with
    nothing; a text of fewer words than a shingle is one shingle; rows that share an id each get
    a row and one component (if their texts differ, they count as a document with the shingles of all
    of them, of the size of the one whose class starts first); a row whose id is null gets its
    n_shingles, a null component and links with nothing. Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes = saved(texts.mapInArrow(_sizes(shingle), "doc_id long, n_shingles long, seal_a long, seal_b long"))
    full = sizes.where("n_shingles > 0 and doc_id is not null")
    total = full.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    seals = ["n_shingles", "seal_a", "seal_b"]
    heads = full.groupBy(*seals).agg(F.min("doc_id").alias("head"))
    one = F.min(F.struct("head", "n_shingles"))
    classes = cut(full.join(heads, seals).groupBy("doc_id").agg(one.alias("x")).select("doc_id", "x.n_shingles", "x.head"))
    bits = max(LEAST_RANGES, total // RANGE_TOKENS).bit_length() - 1
    packed = "docs binary, runs binary, tokens binary"
    shared = (
        texts.where("doc_id is not null")
        .mapInArrow(_dealt(shingle, bits), f"part long, {packed}, known binary")
        .groupBy("part")
        .applyInArrow(_recurring(bits), f"bucket long, {packed}")
        .groupBy("bucket")
        .applyInArrow(_assembled, "doc_id long, held long, tokens binary")
    )
    sets = saved(
        shared.join(classes.where("doc_id = head"), "doc_id").where(F.col("held") * 100 >= F.col("n_shingles") * percent).select("doc_id", F.col("n_shingles").alias("n"), "tokens")
    )
    comp = _clusters(sets, percent).select(F.col("doc_id").alias("head"), "comp")
    found = classes.join(comp, "head", "left").select("doc_id", F.coalesce("comp", "head").alias("component_id"))
    return sizes.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the near copies: of each class the row with the smallest id stays.

    Rows whose id is null stay.
    """
    gone = (
        near_duplicate_classes(docs, id_col=id_col, **options)
        .where("component_id <> doc_id")
        .select(F.col("doc_id").alias("__gone"))
        .distinct()
    )
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
