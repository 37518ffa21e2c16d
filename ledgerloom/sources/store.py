"""Tables in versions over any file system that Spark reaches: chunk stores, mirrors, markers.

A writer puts Parquet files into a new folder and then one log entry that names it. The entry is created only if its number is still free,
so of two writers at once one wins, and readers see a version whole or not at all. What was written without an entry, by a failed
embedding or a lost race, is never read. Readers take the latest row of each key up to a version; snapshots keep that short.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import saved

ATTEMPTS = 5


class Conflict(RuntimeError):
    """Other writers were first, again and again."""


# --- files ----------------------------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    where, store = _hadoop(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    where, store = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with the text unless it exists; whole or not at all. True for the one writer that did.

    On local disks a hard link is what can't be made twice, elsewhere a rename that doesn't overwrite.
    """
    where, store = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getScheme() == "file":
            own, target = (urlparse(str(x)).path for x in (where.toUri(), path))
            try:
                os.link(own, target)
            except FileExistsError:
                return False
            return True
        jvm = spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(where, jvm.org.apache.hadoop.fs.Path(path), options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True
    finally:
        store.delete(where, False)


def marker(spark: SparkSession, path: str, value: dict) -> dict:
    """The one value that the marker holds: this one if it is the first, else what stands there."""
    return value if put_if_absent(spark, path, json.dumps(value)) else json.loads(read_text(spark, path))


def assert_marker(spark: SparkSession, path: str, value: dict) -> None:
    """A marker with another value stops the start: vectors of two models don't lie in one space."""
    text = read_text(spark, path)
    if text is not None and json.loads(text) != value:
        raise RuntimeError(f"the store was made with {text}, not with {json.dumps(value)}")


# --- the log --------------------------------------------------------------------------------


class Log:
    """Numbered entries of a folder; entry n makes version n."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        numbers = [int(n[:-5]) for n in names(self.spark, f"{self.path}/_log") if n.endswith(".json") and n[:-5].isdigit()]
        return max(numbers, default=0)

    def entry(self, version: int) -> dict:
        return json.loads(read_text(self.spark, self._at(version)))

    def entries(self, version: int | None = None) -> list[tuple[int, dict]]:
        """Entries up to the version, from the last snapshot on, oldest first."""
        found = []
        for n in range(self.version() if version is None else version, 0, -1):
            found.append((n, self.entry(n)))
            if found[-1][1].get("snapshot"):
                break
        return found[::-1]

    def commit(self, version: int, entry: dict) -> bool:
        return put_if_absent(self.spark, self._at(version), json.dumps(entry))

    def new_batch(self) -> str:
        return uuid.uuid4().hex

    def folder(self, batch: str, kind: str) -> str:
        return f"{self.path}/{batch}/{kind}"

    def read(self, kind: str, version: int | None = None) -> DataFrame | None:
        """All rows of a kind up to the version, with the version that each came with; None if there are none."""
        entries = [(n, e) for n, e in self.entries(version) if kind in e["kinds"]]
        if not entries:
            return None
        rows = self.spark.read.parquet(*[self.folder(e["batch"], kind) for _, e in entries])
        numbers = self.spark.createDataFrame([(e["batch"], n) for n, e in entries], "batch string, version long")
        return rows.join(F.broadcast(numbers), "batch")

    def write(self, batch: str, kind: str, rows: DataFrame) -> DataFrame:
        rows.withColumn("batch", F.lit(batch)).write.parquet(self.folder(batch, kind))
        return self.spark.read.parquet(self.folder(batch, kind))

    def _at(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key with the largest version, unless that says it was deleted."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("x"))
    return newest.select(key, "x.*").where("not deleted")


# --- documents and their chunks -------------------------------------------------------------

Chunker = Callable[[DataFrame], DataFrame]


class ChunkStore:
    """documents(doc_id, hash, version) and chunks(doc_id, chunk_index, ..., version), replaced document by document."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = Log(spark, path)

    def documents(self, version: int | None = None) -> DataFrame | None:
        rows = self.log.read("documents", version)
        return None if rows is None else latest(rows, "doc_id").drop("deleted")

    def chunks(self, version: int | None = None) -> DataFrame | None:
        """Chunks of the documents as they stood at a version."""
        rows, live = self.log.read("chunks", version), self.documents(version)
        return None if rows is None else rows.join(live.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")

    def replace(self, incoming: DataFrame, chunk: Chunker) -> dict[str, int]:
        """Take in incoming(doc_id, hash, ...): documents with a known hash are skipped, others get new chunks in place of their old ones.

        chunk makes (doc_id, chunk_index, ...) of the rows that are taken in; it may embed, and if it fails nothing changes. A document
        without chunks is skipped, and what it had stays. Returns how many documents were ingested and skipped, and the number of new chunks.
        """
        n = incoming.count()
        for _ in range(ATTEMPTS):
            base = self.log.version()
            known = self.documents(base)
            named, fresh = incoming.select("doc_id", "hash"), incoming
            if known is not None:
                named = saved(named.join(known.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti"))
                fresh = incoming.join(named.select("doc_id"), "doc_id", "left_semi")  # texts move only if many documents changed
            batch = self.log.new_batch()
            chunks = self.log.write(batch, "chunks", chunk(fresh))
            counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
            taken = self.log.write(batch, "documents", named.join(counts, "doc_id").withColumn("deleted", F.lit(False)))
            found = taken.agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
            if not found[0] or self.log.commit(base + 1, {"batch": batch, "kinds": ["documents", "chunks"]}):
                return {"ingested": found[0], "skipped": n - found[0], "chunks": found[1]}
        raise Conflict(f"{self.log.path}: {ATTEMPTS} attempts")

    def drop_missing(self, present: DataFrame) -> int:
        """Delete documents whose doc_id isn't in present; an empty list deletes nothing. Returns how many went."""
        if present.isEmpty():
            return 0
        for _ in range(ATTEMPTS):
            base = self.log.version()
            known = self.documents(base)
            if known is None:
                return 0
            batch = self.log.new_batch()
            gone = known.join(present.select("doc_id"), "doc_id", "left_anti").select("doc_id", "hash", "n_chunks", F.lit(True).alias("deleted"))
            n = self.log.write(batch, "documents", gone).count()
            if not n or self.log.commit(base + 1, {"batch": batch, "kinds": ["documents"]}):
                return n
        raise Conflict(f"{self.log.path}: {ATTEMPTS} attempts")

    def compact(self) -> None:
        """Write all that is live as one batch, a snapshot, from which readers start. Rows get the snapshot's version."""
        base = self.log.version()
        if not base:
            return
        batch = self.log.new_batch()
        kinds = ["documents"]
        self.log.write(batch, "documents", self.documents(base).drop("batch", "version").withColumn("deleted", F.lit(False)))
        chunks = self.chunks(base)
        if chunks is not None:
            self.log.write(batch, "chunks", chunks.drop("version"))
            kinds.append("chunks")
        if not self.log.commit(base + 1, {"batch": batch, "kinds": kinds, "snapshot": True}):
            raise Conflict(f"{self.log.path}: written to meanwhile")


# --- mirrors --------------------------------------------------------------------------------


class Mirror:
    """A keyed copy of records that live elsewhere."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.log, self.key = Log(spark, path), key

    def rows(self, version: int | None = None) -> DataFrame | None:
        found = self.log.read("rows", version)
        return None if found is None else latest(found, self.key).drop("deleted", "batch")

    def upsert(self, rows: DataFrame, run: str, part: int) -> None:
        """Insert or update by key. A part of a run that was committed before, by an attempt that then failed, isn't taken again."""
        if any(e.get("run") == run and e.get("part") == part for _, e in self.log.entries()):
            return
        self._put(rows.withColumn("deleted", F.lit(False)), {"run": run, "part": part})

    def finish(self, run: str) -> int:
        """Delete what the run didn't bring, unless it brought nothing: an empty fetch may be a failed one. Returns how many went."""
        versions = [n for n, e in self.log.entries() if e.get("run") == run]
        known = self.log.read("rows")
        if not versions or known is None:
            return 0
        brought = known.where(F.col("version").isin(versions)).select(self.key).distinct()
        if brought.isEmpty():
            return 0
        gone = latest(known, self.key).join(brought, self.key, "left_anti").withColumn("deleted", F.lit(True)).drop("batch", "version")
        return self._put(gone, {"run": run, "part": -1})

    def _put(self, rows: DataFrame, more: dict) -> int:
        batch = self.log.new_batch()
        n = self.log.write(batch, "rows", rows).count()
        for _ in range(ATTEMPTS * bool(n)):
            if self.log.commit(self.log.version() + 1, {"batch": batch, "kinds": ["rows"]} | more):
                return n
        if n:
            raise Conflict(f"{self.log.path}: {ATTEMPTS} attempts")
        return 0

    def changes(self, before: int, after: int) -> DataFrame:
        """(key, action): what was inserted, updated or deleted between two versions."""
        old, new = self.rows(before), self.rows(after)
        a = new.select(self.key, F.col("version").alias("new_version"))
        if old is None:
            return a.select(self.key, F.lit("insert").alias("action"))
        both = old.select(self.key, F.col("version").alias("old_version")).join(a, self.key, "full")
        action = F.when(F.col("old_version").isNull(), "insert").when(F.col("new_version").isNull(), "delete").otherwise("update")
        return both.where("not old_version <=> new_version").select(self.key, action.alias("action"))


def sync(stream: DataFrame, mirror: Mirror, run: str, checkpoint: str) -> dict[str, int]:
    """Bring a mirror up to date from a stream of the source's pages, read to its end, then delete what the source no longer has.

    Each micro-batch is one commit; one that is repeated after a failure is recognised by run and number. Returns fetched and deleted.
    """
    fetched = []

    def take(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates([mirror.key])
        fetched.append(rows.count())
        if fetched[-1]:
            mirror.upsert(rows, run, number)

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return {"fetched": sum(fetched), "deleted": mirror.finish(run)}


def numbered_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(page, first, last, n) as keyset paging would fetch them: rows by key, size at a time.

    Pages are told by counts per task of a range partitioning, so no task numbers all rows.
    """
    ranged = saved(rows.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    counts = ranged.groupBy(task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("task", (before - F.col("first")).alias("shift"))  # a row per task
    placed = ranged.withColumn("task", task).join(F.broadcast(shifts), "task").withColumn("page", F.floor((F.col("at") + F.col("shift")) / size))
    return placed.groupBy("page").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))
