"""Places in an order per key, without a task that sees all of a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import saved

#: Counts per task and key up to this many are broadcast.
BROADCAST_COUNTS = 100_000


def placed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with pos, a row's place in its key from 0 on, and of, the key's rows.

    Rows are range partitioned by key and order, so that a large key spreads over many tasks; the counts per task and key say where
    each task begins. Equal rows of the order stand in any order, so the order should be unique.
    """
    ranged = saved(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    counts = ranged.groupBy(F.col(key).alias("__key"), task.alias("__task")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    counts = saved(counts.select("__key", "__task", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy("__key")).alias("of")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_COUNTS else counts
    rows = ranged.join(counts, F.col(key).eqNullSafe(F.col("__key")) & (task == F.col("__task")))
    return rows.withColumn("pos", F.col("__at") + F.col("__shift")).select(*df.columns, "pos", "of")


def value_at_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, float]) -> DataFrame:
    """(key, n, one column per rank q): the smallest value that at least q of the key's values don't exceed; null values don't count.

    Values are counted first; only the running sums of distinct values are put in order, in ranges.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c"))
    ranged = saved(counted.repartitionByRange(key, value).sortWithinPartitions(key, value).withColumn("__task", F.spark_partition_id()))
    sums = ranged.groupBy(F.col(key).alias("__key"), F.col("__task").alias("__t")).agg(F.sum("__c").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("__key").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    sums = saved(sums.select("__key", "__t", F.coalesce(earlier, F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__key")).alias("n")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_COUNTS else sums
    inside = F.sum("__c").over(Window.partitionBy("__task", key).orderBy(value))
    rows = ranged.withColumn("__inside", inside).join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__task") == F.col("__t")))
    upto = F.col("__before") + F.col("__inside")
    reached = [F.min(F.when(upto >= F.ceil(q * F.col("n")), F.col(value))).alias(name) for name, q in ranks.items()]
    return rows.groupBy(key).agg(F.max("n").alias("n"), *reached)
