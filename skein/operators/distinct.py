"""Exact counts of distinct users over any window, from stored states that merge: one bitmap per hour and range of ids.

Ids are integers; nulls count nowhere. A state row holds an hour, the number of a range of 32,768 ids, the bitmap of the ids seen in it, and how many rows were seen. States of the same hour, of other rows
or of the same again, merge by OR, so a window is the union of its hours' bitmaps and no row is read again; hours that a window cuts are completed from the rows of those hours alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hourly(rows: DataFrame, at: str, user: str = "user_id") -> DataFrame:
    """hour, part, bits, n of the rows."""
    seen = rows.where(F.col(user).isNotNull() & F.col(at).isNotNull()).select(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour"), F.bitmap_bucket_number(user).alias("part"), F.bitmap_bit_position(user).alias("bit"))
    return seen.groupBy("hour", "part").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count(F.lit(1)).alias("n"))


def merged(states: DataFrame) -> DataFrame:
    """One row per hour and part; numbers of rows add up, so states of different rows are to be given."""
    return states.groupBy("hour", "part").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))


def counted(states: DataFrame, *keys: Column) -> DataFrame:
    """keys and users: distinct ids of each group of states, one row if there are no keys."""
    names = [f"_k{i}" for i in range(len(keys))]
    named = states.select(*[k.alias(n) for k, n in zip(keys, names)], "part", "bits")
    unions = named.groupBy(*names, "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    return unions.groupBy(*names).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("users"))


def between(states: DataFrame, rows: DataFrame, at: str, start: Column, end: Column, user: str = "user_id") -> DataFrame:
    """The states of a window: whole hours from the stored ones, the hours that it cuts from the rows in them."""
    floor = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    first = F.when(floor(start) == start, start).otherwise(floor(start) + F.expr("INTERVAL 1 HOUR"))
    last = floor(end)
    whole = states.where((F.col("hour") >= first) & (F.col("hour") < last))
    inside = (F.col(at) >= start) & (F.col(at) < end)
    cut = (F.col(at) < first) | (F.col(at) >= last)
    return whole.unionByName(hourly(rows.where(inside & cut), at, user))


def active(states: DataFrame, rows: DataFrame, at: str, spans: dict[str, tuple[Column, Column]], user: str = "user_id") -> DataFrame:
    """One row with the distinct users of each named window."""
    parts = [between(states, rows, at, a, b, user).withColumn("_w", F.lit(name)) for name, (a, b) in spans.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = counted(every, F.col("_w"))
    return found.agg(*[F.coalesce(F.max(F.when(F.col("_k0") == name, F.col("users"))), F.lit(0)).alias(name) for name in spans])
