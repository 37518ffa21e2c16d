"""Joins of a large table with a table of one row per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables up to this many rows are broadcast.
BROADCAST_ROWS = 10_000
#: Beyond that, a key's rows are dealt over this many tasks.
SALTS = 32


def join_per_key(df: DataFrame, per_key: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """df joined with per_key, which is counted here and so should be materialised; spread_by are columns of df to salt by.

    Rows of df without a partner go, as do rows with a null key.
    """
    if per_key.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(per_key), on)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    copies = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "__salt"]).drop("__salt")
