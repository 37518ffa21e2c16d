"""Merkle manifest of a dataset: a persistent tree with path copying.

A leaf is the hash of a row's fields. The leaves of a language, in ascending order of doc_id, and then the languages' roots are
combined two by two; a last node without a partner is hashed alone. Trees are cut into aligned blocks of 2^BLOCK_BITS nodes.
A block is one task's work; blocks' tops are the nodes of the next round, so no task sees more than a block.

A changed leaf makes a version of the tree. The version copies the leaf's ancestors only, first inside its aligned block and then
along the upper blocks, and shares every other node with the base tree: its upper ancestors need the block's upper siblings,
which come down from round to round and are joined to the lower blocks, so all versions are continued where their leaves are.

Defined results: null fields are '-', others their UTF-8 byte count, ':' and the value. Null languages stand first, null
doc_ids before all others of their language; rows with equal doc_ids are ordered by leaf, and each has its own place, so
repeated rows are told apart by place and give equal leaves. Texts of any length are hashed whole, in the JVM. A
null doc_id or a null n_chars is never tampered with. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.joins import join_per_key
from ledgerloom.session import saved

BLOCK_BITS = 12
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "key string, pos long, n long, digest binary"
CHAIN = "key string, pos long, chain array<string>, subroot string"
MANIFEST = "doc_id long, pos long, leaf string, subroot string, proof array<string>, version array<string>"


# --- a block --------------------------------------------------------------------------------


def combine(*digests: bytes) -> bytes:
    """Hash of digests as hex text."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def height(n: int, bits: int) -> int:
    """Levels above n nodes until one remains, bits at most in one round."""
    return min((n - 1).bit_length(), bits)


def block_tree(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a block, its nodes first."""
    tree = [nodes]
    for _ in range(levels):
        below = tree[-1]
        tree.append([combine(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return tree


def siblings(tree: list[list[bytes]], at: int) -> list[str]:
    """Level by level the other node of a node's run: 'l' or 'r' by where it stands, then its digest; '-' if there is none."""
    steps = []
    for level in tree[:-1]:
        other = at ^ 1
        steps.append("-" if other >= len(level) else "lr"[other > at] + level[other].decode())
        at >>= 1
    return steps


def ancestors(leaf: bytes, steps: list[str]) -> Iterator[bytes]:
    """The nodes that a version with this leaf copies, bottom up; the last one is its root."""
    for step in steps:
        other = step[1:].encode()
        leaf = combine(other, leaf) if step[0] == "l" else combine(leaf, other)
        yield leaf


# --- trees over tables ----------------------------------------------------------------------


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df(key, ...) with pos, a row's place in its key by the order, and n, the key's rows.

    Rows are range partitioned by key and order, so a large key spreads over many tasks; what is counted per task and key gives each
    task's first place.
    """
    ranged = saved(df.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    counts = ranged.groupBy("key", task.alias("__task")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy("key").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "__task", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(Window.partitionBy("key")).alias("n"))
    placed = join_per_key(ranged.withColumn("__task", task), saved(counts), ["key", "__task"], ["__at"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift")


def in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", bits))


def hexed(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def next_round(nodes: DataFrame, bits: int) -> DataFrame:
    """The blocks' tops, in a key of one node that node itself."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        n = part.column("n")[0].as_py()
        top = block_tree(hexed(part.sort_by("pos").column("digest")), height(n, bits))[-1][0]
        row = {"key": key[0].as_py(), "pos": key[1].as_py(), "n": -(-n // (1 << bits)), "digest": bytes.fromhex(top.decode())}
        return pa.Table.from_pylist([row], pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    return saved(in_blocks(nodes.select("key", "pos", "n", "digest"), bits).groupBy("key", "block").applyInArrow(run, NODE))


def rounds(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes of every round; the last one has a single node per key."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(next_round(found[-1], bits))
    return found


def chains_below(nodes: DataFrame, chains: DataFrame, bits: int) -> DataFrame:
    """chains(key, pos, chain, subroot) of a round's tops -> those of its nodes: the siblings inside the block, then the top's."""

    def run(key: tuple, part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        tree = block_tree(hexed(part.column("digest")), height(part.column("n")[0].as_py(), bits))
        upper, subroot = above.column("chain")[0].as_py(), above.column("subroot")[0].as_py()
        rows = [siblings(tree, i) + upper for i in range(len(part))]
        return pa.table({"key": part.column("key"), "pos": part.column("pos"), "chain": pa.array(rows, pa.list_(pa.string())), "subroot": pa.array([subroot] * len(part), pa.string())})

    tops = chains.withColumnRenamed("pos", "block")
    own = in_blocks(nodes.select("key", "pos", "n", "digest"), bits)
    return saved(own.groupBy("key", "block").cogroup(tops.groupBy("key", "block")).applyInArrow(run, CHAIN))


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Mapping[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(fields[c]) for c in FIELDS]).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Mapping[str, Column] | None = None, where: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of docs: its leaf, its language's and the whole root, its proof and the version of the tree with
    its leaf anew.

    tampered holds other values of fields, for the rows where `where` is true. proof has the siblings as siblings() gives them, from the
    leaf to the root; version the copied nodes from the leaf to the version's root. They end in the base root
    exactly where the leaf wasn't changed. A block has 2^bits nodes.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = F.when(where, F.unhex(leaf_digest(fields | dict(tampered)))) if tampered else F.lit(None).cast("binary")
    key = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang"))
    leaves = saved(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_digest(fields)).alias("digest"), changed.alias("changed")))
    leaves = numbered(leaves, ["doc_id", "digest"])
    trees = rounds(leaves, bits)
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "digest")
    tops = saved(numbered(subroots, ["lang_key"]))
    upper = rounds(tops, bits)
    found = upper[-1].first()
    root = found["digest"].hex() if found else ""

    chains = docs.sparkSession.createDataFrame([("", 0, [], None)], CHAIN)
    for nodes in reversed(upper[:-1]):
        chains = chains_below(nodes, chains, bits)
    named = tops.select("lang_key", "pos", F.lower(F.hex("digest")).alias("subroot"))
    # one row per language, as many as there are chains by now
    chains = chains.drop("subroot").join(named, "pos").select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("pos"), "chain", "subroot")
    for nodes in reversed(trees[1:-1]):
        chains = chains_below(nodes, chains, bits)

    def run(key: tuple, part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        leaf = hexed(part.column("digest"))
        now = [old if new is None else new.hex().encode() for old, new in zip(leaf, part.column("changed").to_pylist(), strict=True)]
        tree = block_tree(leaf, height(part.column("n")[0].as_py(), bits))
        chain, subroot = above.column("chain")[0].as_py(), above.column("subroot")[0].as_py()
        shared: dict[bytes, list[str]] = {}  # upper versions by the block's top
        proofs, versions = [], []
        for i, own in enumerate(now):
            steps = siblings(tree, i)
            copied = [own, *ancestors(own, steps)]
            if copied[-1] not in shared:
                shared[copied[-1]] = [x.decode() for x in ancestors(copied[-1], chain)]
            upper_copies = shared[copied[-1]] if copied[-1] == tree[-1][0] else shared.pop(copied[-1])
            proofs.append(steps + chain)
            versions.append([x.decode() for x in copied] + upper_copies)
        texts = pa.list_(pa.string())
        columns = [part.column("doc_id"), part.column("pos"), pa.array([x.decode() for x in leaf]), pa.array([subroot] * len(part), pa.string()), pa.array(proofs, texts), pa.array(versions, texts)]
        return pa.table(columns, names=["doc_id", "pos", "leaf", "subroot", "proof", "version"])

    tops = chains.withColumnRenamed("pos", "block")
    rows = in_blocks(leaves, bits).groupBy("key", "block").cogroup(tops.groupBy("key", "block")).applyInArrow(run, MANIFEST)
    return rows.withColumn("root", F.lit(root))


def digests(rows: DataFrame) -> DataFrame:
    """The manifest with its proof hashed and its version's root held against the base root."""
    listed = F.array_join(F.transform("proof", lambda x: F.substring(x, 2, 64)), "")
    folded = F.element_at("version", -1)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(listed.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
