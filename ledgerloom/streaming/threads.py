"""Streams with state per key: audit chains that go on from what is stored, confirmations that expire.

Both need the RocksDB state store, which the session is told to use for the streams started here.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.plans.ledger import AUDIT, GENESIS, audit_rows, entry_hash, verify_chain
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder
from ledgerloom.sources.store import names
from ledgerloom.streaming.ledgers import event_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONFIRM_SECONDS = 300
#: Rows may come this late.
LATE = "10 minutes"
#: Fixed value: longest text in the log, and what stands after a cut one.
LOG_TEXT, CUT_MARK = 10_000, "... [truncated]"


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# --- audit chains ---------------------------------------------------------------------------


class ChainLinks(StatefulProcessor):
    """State: the hash that a chain ends in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("id")
        prev = self.last.get()[0] if self.last.exists() else GENESIS
        before, own = [], []
        for row in part.itertuples(index=False):
            before.append(prev)
            prev = entry_hash(prev, row)
            own.append(prev)
        self.last.update((prev,))
        yield part.assign(prev_hash=before, entry_hash=own)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((initialState["hash"].iloc[0],))

    def close(self) -> None:
        pass


def clipped(c: str):
    """Texts of the log, cut with a mark."""
    return F.when(F.length(c) > LOG_TEXT, F.concat(F.substring(c, 1, LOG_TEXT), F.lit(CUT_MARK))).otherwise(F.col(c))


def linked(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """A stream of audit rows, each linked to the one before it in its chain; chains go on from their last stored entry.

    Within a micro-batch rows are linked by id; ids must grow from batch to batch, as they do in a log.
    """
    use_rocks(rows.sparkSession)
    seeds = None
    if stored is not None:
        ends = stored.where("entry_hash is not null").groupBy("chain").agg(F.max_by("entry_hash", "id").alias("hash"))
        seeds = ends.groupBy("chain")
    rows = rows.withColumn("tool_name", clipped("tool_name"))
    return rows.groupBy("chain").transformWithStateInPandas(ChainLinks(), AUDIT, "Append", "None", initialState=seeds)


def stored_chains(spark: SparkSession, path: str) -> DataFrame | None:
    """All entries that runs have committed under path; None before the first run."""
    runs = [spark.read.schema(AUDIT).parquet(f"{path}/rows/{run}") for run in names(spark, f"{path}/rows")]
    return reduce(DataFrame.unionByName, runs) if runs else None


def append_stream(rows: DataFrame, path: str) -> None:
    """Append a stream of audit rows to the chains stored under path, read to its end.

    A run has a folder and a checkpoint of its own, so that its file sink takes each micro-batch exactly once, and is seeded from what the
    runs before it have committed.
    """
    run = uuid.uuid4().hex
    out = linked(rows, stored_chains(rows.sparkSession, path))
    sink = out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows/{run}").option("checkpointLocation", f"{path}/state/{run}")
    sink.trigger(availableNow=True).start().awaitTermination()


def audit_stream(events: DataFrame) -> DataFrame:
    return audit_rows(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@register("chain_append_stored", "SELECT user_id AS chain, COUNT(*) AS n, NULL::BIGINT AS broken_at, 'OK' AS reason FROM events GROUP BY 1")
def chain_append_stored(spark: SparkSession, d: str) -> DataFrame:
    """Two runs one after the other, the second one going on from the stored chains; they verify from end to end."""
    path = new_folder(spark, "chain")
    for condition in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        append_stream(audit_stream(event_stream(spark, d).where(condition)), path)
    return verify_chain(stored_chains(spark, path))


# --- confirmations --------------------------------------------------------------------------

OUTCOMES = "caller long, event_id long, outcome string"


class Confirmations(StatefulProcessor):
    """State: the question that waits for an answer, with the time at which it expires."""

    def __init__(self, seconds: int) -> None:
        self.wait = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "event_id long, expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        waiting = self.open.get() if self.open.exists() else None
        if waiting:
            self.handle.deleteTimer(waiting[1])
        found = []
        for event_id, ts in zip(part["event_id"], part["ts"], strict=True):
            now = ts.value // 1_000_000
            if waiting:
                found.append((key[0], waiting[0], "answered" if now <= waiting[1] else "expired"))
            waiting = (int(event_id), now + self.wait)
        self.open.update(waiting)
        self.handle.registerTimer(waiting[1])
        yield pd.DataFrame(found, columns=["caller", "event_id", "outcome"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], waiting[0], "expired")], columns=["caller", "event_id", "outcome"])

    def close(self) -> None:
        pass


def confirmations(events: DataFrame, seconds: int = CONFIRM_SECONDS, late: str = LATE) -> DataFrame:
    """events(caller, event_id, ts) -> the outcome of each: answered by the caller's next event in time, else expired.

    A silent thread expires when the watermark passes its time, without a further event.
    """
    use_rocks(events.sparkSession)
    rows = events.select("caller", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("caller").transformWithStateInPandas(Confirmations(seconds), OUTCOMES, "Append", "EventTime")


@register(
    "confirm_timeout",
    f"""SELECT caller, event_id, CASE WHEN epoch_ms(next) <= epoch_ms(ts) + {CONFIRM_SECONDS * 1000} THEN 'answered' ELSE 'expired' END AS outcome FROM (
    SELECT user_id AS caller, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, max(ts) OVER () AS latest FROM events)
    WHERE next IS NOT NULL OR epoch_ms(ts) + {CONFIRM_SECONDS * 1000} <= epoch_ms(latest) - 600000""",
)
def confirm_timeout(spark: SparkSession, d: str) -> DataFrame:
    """The stream's outcomes; what is still open when it ends has none."""
    base = new_folder(spark, "confirm")
    events = event_stream(spark, d).select(F.col("user_id").alias("caller"), "event_id", "ts")
    query = confirmations(events).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTCOMES).parquet(f"{base}/out")
