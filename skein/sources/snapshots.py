"""The shared folder, and tables kept as numbered snapshots: one is written whole, then its pointer; readers never see half a write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back; the folder is deleted when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _path(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores where the input has fewer partitions than cores, as a small file has; a larger input is left where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound the Arrow batches of this session's jobs in rows and bytes, so that a Python worker's memory does not go by what a partition holds; a smaller number of rows stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class SnapshotTable:
    """A Parquet table under `root`: snapshots in folders of their own; the pointer with the highest number names the current one.

    A pointer is an empty folder `pointer-<number>-<snapshot>` made in one step, after its snapshot is whole. The last snapshots but `kept` are deleted,
    so that a reader of the one before can finish.
    """

    def __init__(self, spark: SparkSession, root: str, kept: int = 2):
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept

    def _pointers(self) -> list[tuple[int, str]]:
        fs, root = _path(self.spark, self.root)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted((int(n.split("-")[1]), n.split("-", 2)[2]) for n in names if n.startswith("pointer-"))

    def current(self) -> str | None:
        pointers = self._pointers()
        return pointers[-1][1] if pointers else None

    def read(self) -> DataFrame | None:
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.root}/{name}")

    def replace(self, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        name = f"snapshot-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.root}/{name}")
        pointers = self._pointers()
        fs, pointer = _path(self.spark, f"{self.root}/pointer-{pointers[-1][0] + 1 if pointers else 1}-{name}")
        fs.mkdirs(pointer)
        for number, old in self._pointers()[: -self.kept]:
            fs.delete(_path(self.spark, f"{self.root}/pointer-{number}-{old}")[1], True)
            fs.delete(_path(self.spark, f"{self.root}/{old}")[1], True)
