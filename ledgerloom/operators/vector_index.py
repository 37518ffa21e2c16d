"""Nearest vectors by an inverted file, and exact scores in blocks.

Centroids are fitted on at most SAMPLE vectors (those whose hashed ids are smallest, whatever the input's size); every stored vector
goes into the list of its nearest centroid. A query probes the lists whose centroids are nearest to it and scores their
vectors exactly, as blocks of a matrix product. Only lists that are probed are scored.

How many lists to probe is calibrated when the centroids are fitted: on sampled questions against the sample, the fewest that hold
TARGET of the true neighbours. The sample is thinner than the table, so its neighbours are farther off and the figure is on the safe side.

The exact way needs no threshold of its own: a list's angle to its farthest member bounds how near any of its members can be to
a query, so after the first probes only lists that may still hold one of the k nearest are opened.

Vectors are compared by cosine, in double precision, rounded to DIGITS. Null vectors and zero vectors have no direction: they are in no list
and are never found; as queries they find nothing. Equal scores go by the smaller id. Vectors of another length fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import new_folder, saved, shared_dir

#: Vectors that the centroids are fitted on, and the most lists.
SAMPLE, MOST_LISTS = 20_000, 4096
FIT_ROUNDS = 8
#: Share of the CALIBRATED_K nearest that the probed lists should hold, and questions that this is measured on.
TARGET, CALIBRATED_K, CALIBRATIONS = 0.95, 20, 500
#: Stored vectors of a list that one task scores, and queries of a list that it scores them for.
PIECE, ASKERS = 20_000, 20_000
#: Entries of a score matrix that exist at once.
CELLS = 1 << 19
DIGITS = 6
NEAR = "query_id long, vec_id long, score double"
#: Queries that are sent to all tasks at once; more go in blocks.
QUERY_BLOCK = 2000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of doubles; they must be of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n and (len(flat) % n or (column.value_lengths().to_numpy() != len(flat) // n).any()):
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, stored: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores): for each query its k nearest stored vectors and what ties with the last of them by rounding."""
    if not len(stored) or not len(queries):
        return
    step = max(1, CELLS // len(stored))
    for i in range(0, len(queries), step):
        scores = np.round(queries[i : i + step] @ stored.T, DIGITS)
        if len(stored) > k:
            least = np.partition(scores, len(stored) - k, axis=1)[:, len(stored) - k]
            q, s = np.nonzero(scores >= least[:, None])
        else:
            q, s = (x.ravel() for x in np.indices(scores.shape))
        value = scores[q, s]
        order = np.lexsort((ids[s], -value, q))
        q, s, value = q[order], s[order], value[order]
        first = np.searchsorted(q, np.arange(len(scores)))
        kept = np.arange(len(q)) - first[q] < k
        yield query_ids[i : i + step][q[kept]], ids[s[kept]], value[kept]


def with_direction(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))


def ranked(near: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


# --- without an index -----------------------------------------------------------------------


def nearest(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """queries(query_id, q), stored(vec_id, v) -> (query_id, vec_id, score, rank) of the k nearest, all rows scored.

    The queries go to all tasks in blocks of QUERY_BLOCK; a task keeps k rows per query and batch, so that is all that
    is shuffled.
    """
    queries, stored = with_direction(queries.select("query_id", "q"), "q"), with_direction(stored.select("vec_id", "v"), "v")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # QUERY_BLOCK rows, more or less
        q, query_ids = unit(matrix(block.column("q"))), block.column("query_id").to_numpy()

        def run(batches: Iterator[pa.RecordBatch], q=q, query_ids=query_ids) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for found in best_of_block(q, query_ids, unit(matrix(part.column("v"))), part.column("vec_id").to_numpy(), k):
                    yield pa.record_batch(list(map(pa.array, found)), names=["query_id", "vec_id", "score"])

        near = stored.mapInArrow(run, NEAR)
        out = near if out is None else out.unionByName(near)
    return ranked(out, k)


# --- the index ------------------------------------------------------------------------------


@dataclass
class VectorIndex:
    """centroids: one unit row per list; spread: the largest angle in each list; probes: lists to open for a question;
    rows(list, piece, vec_id, v): all vectors."""

    centroids: np.ndarray
    spread: np.ndarray
    pieces: np.ndarray
    probes: int
    rows: DataFrame

    def write(self, path: str) -> None:
        """As Parquet: the rows by list, and one row per list."""
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        lists = pa.table({"list": np.arange(len(self.spread)), "centroid": list(self.centroids), "spread": self.spread, "pieces": self.pieces, "probes": [self.probes] * len(self.spread)})
        spark.createDataFrame(lists).coalesce(1).write.parquet(f"{path}/lists")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    lists = spark.read.parquet(f"{path}/lists").toPandas().sort_values("list")
    return VectorIndex(np.array(lists["centroid"].tolist()), lists["spread"].to_numpy(), lists["pieces"].to_numpy(), int(lists["probes"].iloc[0]), spark.read.parquet(f"{path}/rows"))


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means from rows spread evenly over the sample; an emptied centroid stays where it was."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = np.concatenate([np.argmax(sample[i : i + 2048] @ centroids.T, axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The fewest lists that hold TARGET of the nearest of sampled questions, over the sample itself."""
    if len(sample) <= CALIBRATED_K:
        return len(centroids)
    asked = sample[np.linspace(0, len(sample) - 1, min(CALIBRATIONS, len(sample))).astype(int)]
    of = np.argmax(sample @ centroids.T, axis=1)
    turn = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    near = np.argpartition(-(asked @ sample.T), CALIBRATED_K, axis=1)[:, :CALIBRATED_K]
    turns = np.sort(np.take_along_axis(turn, of[near], axis=1).ravel())
    return int(turns[int(np.ceil(TARGET * len(turns))) - 1]) + 1


def build_index(stored: DataFrame, lists: int | None = None) -> VectorIndex:
    """An index of stored(vec_id, v). lists: about the root of the number of rows, unless given."""
    spark = stored.sparkSession
    stored = with_direction(stored.select("vec_id", "v"), "v")
    n = stored.count()
    sample = unit(matrix(stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("v")))
    lists = max(1, min(lists or int(n**0.5), MOST_LISTS, len(sample)))
    centroids = fit_centroids(sample, lists) if len(sample) else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                near = unit(matrix(part.column("v"))) @ shared.value.T
                at = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), at], -1, 1))
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(angle), part.column("vec_id"), part.column("v")], names=["list", "angle", "vec_id", "v"])

    shared_dir(spark)
    placed = saved(stored.mapInArrow(assign, f"list int, angle double, vec_id long, v {stored.schema['v'].dataType.simpleString()}"))
    found = placed.groupBy("list").agg(F.max("angle").alias("spread"), F.count("*").alias("n")).toPandas()  # a row per list
    spread, pieces = np.zeros(lists), np.zeros(lists, np.int64)
    spread[found["list"]] = found["spread"]
    pieces[found["list"]] = -(-found["n"] // PIECE)
    sizes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(pieces)], "list int, pieces int")
    piece = F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")
    rows = placed.join(F.broadcast(sizes), "list").select("list", piece.alias("piece"), "vec_id", "v")
    path = new_folder(spark, "vectors")
    rows.repartition("list", "piece").sortWithinPartitions("list", "piece").write.parquet(path)
    return VectorIndex(centroids, spread, pieces, calibrated_probes(sample, centroids) if len(sample) else 1, spark.read.parquet(path))


def probe(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """asked(query_id, q, list) -> (query_id, vec_id, score): up to k rows per query, list and piece.

    A (list, piece) holds PIECE rows at most in expectation; the queries of a list go in blocks of about ASKERS, each of which
    meets every piece.
    """
    blocks = asked.groupBy("list").agg(F.count("*").alias("n"))
    most = (blocks.agg(F.max("n")).first()[0] or 0) // ASKERS + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(most)).cast("int")
    pieces = asked.sparkSession.createDataFrame([(i, p) for i, n in enumerate(index.pieces) for p in range(int(n))], "list int, piece int")
    asking = asked.select("list", block.alias("block"), "query_id", "q").join(F.broadcast(pieces), "list")
    stored = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    stored = stored.join(F.broadcast(asked.select("list").distinct()), "list", "left_semi")  # lists that nobody asks stay unread in tasks

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [] if not len(left) or not len(right) else [
            pa.table(list(map(pa.array, found)), names=["query_id", "vec_id", "score"])
            for found in best_of_block(unit(matrix(left.column("q"))), left.column("query_id").to_numpy(), unit(matrix(right.column("v"))), right.column("vec_id").to_numpy(), k)
        ]
        empty = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()
        return pa.concat_tables([empty, *parts])

    keys = ["list", "piece", "block"]
    return asking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(run, NEAR)


def probed_lists(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """queries(query_id, q) with a row per list to open, in (list, turn): turn is the list's place by nearness of its centroid."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                near = unit(matrix(part.column("q"))) @ shared.value.T
                turns = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(part.num_rows), turns.shape[1])
                yield pa.record_batch(
                    [part.column("query_id").take(pa.array(row)), part.column("q").take(pa.array(row)), pa.array(turns.ravel().astype(np.int32)), pa.array(np.tile(np.arange(turns.shape[1], dtype=np.int32), part.num_rows))],
                    names=["query_id", "q", "list", "turn"],
                )

    kind = queries.schema["q"].dataType.simpleString()
    return with_direction(queries.select("query_id", "q"), "q").mapInArrow(run, f"query_id long, q {kind}, list int, turn int")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k best of the probed lists: (query_id, vec_id, score, rank)."""
    return ranked(probe(index, probed_lists(index, queries, probes or index.probes), k), k)


def search_exact(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k best of all rows, by opening the lists that may hold them after the first probes."""
    probes = probes or index.probes
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.spread))
    first = saved(search(index, queries, k, probes))
    floor = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = floor.select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(-1.0).alias("least"))
    asked = queries.select("query_id", "q").join(floor, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, spread = shared.value
        for part in batches:
            if part.num_rows:
                near = unit(matrix(part.column("q"))) @ centroids.T
                angle = np.arccos(np.clip(near, -1, 1))
                bound = np.cos(np.clip(angle - spread, 0, np.pi))
                turn = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                least = part.column("least").to_numpy()[:, None] - 10.0**-DIGITS
                row, at = np.nonzero((bound >= least) & (turn >= probes))
                yield pa.record_batch([part.column("query_id").take(pa.array(row)), part.column("q").take(pa.array(row)), pa.array(at.astype(np.int32))], names=["query_id", "q", "list"])

    kind = queries.schema["q"].dataType.simpleString()
    more = saved(with_direction(asked, "q").mapInArrow(run, f"query_id long, q {kind}, list int"))
    return ranked(first.drop("rank").unionByName(probe(index, more, k)), k)
