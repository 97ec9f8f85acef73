"""A folder watched for changed files: each look at it lists the files, and reads those whose time of change is not the known one.

What is known lies under a root of its own, as changes per look (see streams.ChangeTable): time of change and hash of each file. A look that broke off is taken up by the next one. Files are known by their
path, or by a key worked out from it, of whose files the newest counts; files that have gone are told as gone once. Spark's scans
pass over empty files, so these are not there, and a file that becomes empty has gone.
"""

from __future__ import annotations

from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import incremental
from skein.sources import jsonl
from skein.sources.snapshots import saved
from skein.streaming.streams import ChangeTable

KNOWN = "key string, path string, etag string, modified string, hash string, gone boolean, look long"
PATHS_TOGETHER = 10_000  # files read by name in one scan


def _newest(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("_k = 1").drop("_k")


def _contents(spark: SparkSession, wanted: DataFrame, every: DataFrame | None) -> DataFrame:
    """path and hash of the wanted files: of a first look by one scan of every file listed, later by name."""
    hashed = lambda df: df.select("path", F.sha2("content", 256).alias("hash"))
    if every is not None:
        return hashed(every)
    with jsonl.listed_together(spark):
        scans = [hashed(spark.read.format("binaryFile").load([r.path for r in some])) for some in batched(wanted.select("path").toLocalIterator(), PATHS_TOGETHER)]
    out = scans[0] if scans else spark.createDataFrame([], "path string, hash string")
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out


def refreshed(spark: SparkSession, folder: str, root: str, pattern: str = "*", key: Column | None = None) -> DataFrame:
    """key, path and status of every file since the last look: new, changed, `header` (the time of change is the known one; not read), `hash` (its content is) or gone."""
    table = ChangeTable(spark, root, lambda df: _newest(df, [F.desc("look")]))
    known = table.read(spark.createDataFrame([], KNOWN))
    look = max([-1, *table.numbers("changes"), *table.numbers("folded")]) + 1
    every = jsonl.binary_files(spark, folder, pattern)
    files = every.select((F.col("path") if key is None else key).alias("key"), "path", F.col("modificationTime").cast("string").alias("modified"), "length")
    listed = saved(_newest(files.where("key is not null"), [F.desc("modified"), F.desc("path")]))
    there = known.where("not gone")
    open_ones = saved(listed.join(there.select("key", F.col("modified").alias("_was")), "key", "left").where("_was is null or _was <> modified").drop("_was"))
    # Every file is open before anything is known.
    fetched = open_ones.join(_contents(spark, open_ones, every if look == 0 else None), "path").select("key", "path", F.lit(None).cast("string").alias("etag"), "modified", "hash")
    fetched = saved(fetched.withColumn("gone", F.lit(False)))
    untouched = listed.join(open_ones.select("key"), "key", "left_anti").select("key", "path", F.lit("header").alias("status"))
    status = incremental.fetch_status(there.select("key", "etag", "modified", "hash"), fetched, "key").join(fetched.select("key", "path"), "key").select("key", "path", "status")
    lost = there.join(listed.select("key"), "key", "left_anti").withColumn("gone", F.lit(True))
    found = saved(untouched.unionByName(status).unionByName(lost.select("key", "path", F.lit("gone").alias("status"))))
    table.step(fetched.unionByName(lost.select(*fetched.columns)).withColumn("look", F.lit(look).cast("long")), look)
    return found
