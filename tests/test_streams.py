"""Streams with state: chains that go on, confirmations that expire."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.plans.ledger import GENESIS, append_chain, verify_chain
from ledgerloom.streaming import threads

AT = dt.datetime(2024, 1, 1)
AUDIT_ROWS = "chain long, id long, ts timestamp_ntz, event_type string, caller long, tool_name string"


def audit(n, chains=3):
    return [(i % chains, i, AT + dt.timedelta(seconds=i), "call", i % chains, "é" * 10_001 if i == 5 else f"tool {i}") for i in range(n)]


def stream(spark, folder, files, schema):
    folder.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_runs_end_to_end_equal_one_run(spark, tmp_path):
    rows = audit(60)
    path = str(tmp_path / "chain")
    threads.append_stream(stream(spark, tmp_path / "a", [rows[:20], rows[20:31]], AUDIT_ROWS), path)
    first = {(r.chain, r.id): r.entry_hash for r in threads.stored_chains(spark, path).collect()}
    threads.append_stream(stream(spark, tmp_path / "b", [rows[31:]], AUDIT_ROWS), path)
    got = threads.stored_chains(spark, path)
    whole = append_chain(spark.createDataFrame(rows, AUDIT_ROWS).withColumn("tool_name", threads.clipped("tool_name")))
    as_rows = lambda df: sorted(tuple(r[c] for c in ("chain", "id", "tool_name", "prev_hash", "entry_hash")) for r in df.collect())
    assert as_rows(got) == as_rows(whole) and len(first) == 31
    assert all(r.reason == "OK" for r in verify_chain(got).collect())
    assert sum(r.prev_hash == GENESIS for r in got.collect()) == 3
    cut = got.where("id = 5").first().tool_name
    assert cut == "é" * 10_000 + "... [truncated]"
    forged = got.withColumn("tool_name", F.when(F.col("id") == 33, "other").otherwise(F.col("tool_name")))
    assert {r.chain: (r.broken_at, r.reason) for r in verify_chain(forged).collect()} == {0: (33, "entry_hash"), 1: (None, "OK"), 2: (None, "OK")}


def test_hashes_of_columns_equal_those_of_rows(spark):
    odd = ['"q" \\ back', "a\nb\r\tc\b\f", "".join(map(chr, range(40))), "é漢\u2028\x7f", "", None, "\\u000B"]
    rows = [(1, i, AT + dt.timedelta(microseconds=i % 2 * 1500), t or "none", 7, t) for i, t in enumerate(odd)]
    linked = append_chain(spark.createDataFrame(rows, AUDIT_ROWS))
    assert [tuple(r) for r in verify_chain(linked).collect()] == [(1, len(odd), None, "OK")]


def test_entries_without_a_hash_are_older_than_the_chain(spark, tmp_path):
    rows = audit(8, 1)
    linked = append_chain(spark.createDataFrame(rows[3:], AUDIT_ROWS))
    old = spark.createDataFrame(rows[:3], AUDIT_ROWS).selectExpr("*", "cast(null as string) as prev_hash", "cast(null as string) as entry_hash")
    assert [tuple(r) for r in verify_chain(old.unionByName(linked)).collect()] == [(0, 5, None, "OK")]


def test_confirmations_expire_without_a_further_event(spark, tmp_path):
    at = lambda caller, i, seconds: (caller, i, AT + dt.timedelta(seconds=seconds))
    files = [
        [at(1, 1, 0), at(1, 2, 100), at(2, 3, 50), at(4, 9, 0)],
        [at(1, 4, 400), at(1, 5, 701), at(3, 6, 700)],
        [at(3, 7, 5000)],  # moves the watermark past the silent ones
        [at(3, 8, 5001)],
    ]
    events = stream(spark, tmp_path / "events", files, "caller long, event_id long, ts timestamp")
    query = threads.confirmations(events, 300, "10 seconds").writeStream.outputMode("append").format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: r.outcome for r in spark.table("outcomes").collect()}
    assert got == {1: "answered", 2: "answered", 3: "expired", 4: "expired", 5: "expired", 6: "expired", 7: "answered", 9: "expired"}
    assert spark.table("outcomes").count() == len(got)
