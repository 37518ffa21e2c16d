"""Streaming twins of the ledgers: usage windows and rate-limit admission over a file stream.

The watermark is an addition of this library: rows later than it are left out of windows that have closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.ledger import ADMITTED_SQL
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "40 days") -> DataFrame:
    """Calls and tokens per kind and window, sliding if slide is given."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type")
    sums = counted.agg(F.count("*").alias("requests"), F.sum(F.floor(F.abs("value")).cast("long")).alias("tokens"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "requests", "tokens")


ADMITTED = "user_id long, event_id long, ts timestamp, admitted boolean"


def admitted_calls(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Each call with its verdict; the state of a caller is the admitted times still in the window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # a caller's calls of one micro-batch
        verdicts = []
        for t in rows["ts"]:
            now = t.value // 1000
            recent = [x for x in recent if x > now - seconds * 1_000_000]
            verdicts.append(len(recent) < limit)
            if verdicts[-1]:
                recent.append(now)
        state.update((recent,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "admitted": verdicts})

    calls = events.select("user_id", "event_id", "ts")
    return calls.groupBy("user_id").applyInPandasWithState(step, ADMITTED, "recent array<long>", "append", "NoTimeout")


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there and return the sink's rows, written to the shared folder."""
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register(
    "stream_hourly_usage",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS requests, SUM(floor(abs(value))::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2",
)
def stream_hourly_usage(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the events, read to its end; equals the batch aggregation."""
    out = run_available(windowed_usage(event_stream(spark, d)), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register("stream_rate_limit", f"{ADMITTED_SQL} SELECT user_id, event_id, admitted FROM r")
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Admission with state per caller; the batch query rate_limit_admit gives the same verdicts."""
    return run_available(admitted_calls(event_stream(spark, d), 2, 86_400), "append").select("user_id", "event_id", "admitted")
