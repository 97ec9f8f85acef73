"""The knowledge index as a data source: tasks write parts, one commit makes them the rows of their documents.

Every task writes its rows to a Parquet file of its own under `parts/<commit>`; the commit is one manifest that names the files, moved into place when all are whole. Readers follow manifests only, so a
write that fails leaves what was there. A document's rows are those of the newest commit that has any of it, a row with `_deleted` among them meaning that it is gone; a commit that clears (mode overwrite)
hides all commits before it. A commit whose name is known changes nothing, so a batch that comes again does no harm. There is one writer at a time; any file system that pyarrow
opens by its URI will do, and it must be one that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "skein_index"


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


def _manifests(fs: files.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(files.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


class _IndexWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.name, self.clears = options["path"], options.get("commit") or uuid.uuid4().hex, overwrite
        if "/" in self.name or "-" in self.name:
            raise ValueError("a commit's name has no / and no -")

    def _open(self) -> tuple[files.FileSystem, str]:
        return files.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        fs, root = self._open()
        writer, name = None, f"parts/{self.name}/{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(f"{root}/parts/{self.name}", recursive=True)
                writer = pq.ParquetWriter(fs.open_output_stream(f"{root}/{name}"), batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return _Part(None)
        writer.close()
        return _Part(name)

    def commit(self, messages: list[_Part | None]) -> None:
        fs, root = self._open()
        known = _manifests(fs, root)
        if any(m.split("-")[1] == f"{self.name}.json" for m in known):
            self.abort(messages)
            return
        number = int(known[-1].split("-")[0]) + 1 if known else 1
        fs.create_dir(f"{root}/manifests", recursive=True)
        said = {"number": number, "clears": self.clears, "files": [m.name for m in messages if m and m.name]}
        with fs.open_output_stream(f"{root}/manifests/{self.name}.writing") as out:
            out.write(json.dumps(said).encode())
        fs.move(f"{root}/manifests/{self.name}.writing", f"{root}/manifests/{number:09d}-{self.name}.json")

    def abort(self, messages: list[_Part | None]) -> None:
        """Parts that no manifest names; what a lost task has left behind is named by none either."""
        fs, root = self._open()
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class IndexSource(DataSource):
    """`df.write.format("skein_index").option("path", root).option("commit", name)`; mode overwrite clears."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> _IndexWriter:
        return _IndexWriter(dict(self.options), overwrite)


def write(rows: DataFrame, root: str, commit: str | None = None, clear: bool = False) -> None:
    """Replace the documents that `rows` have; with `clear`, everything."""
    rows.sparkSession.dataSource.register(IndexSource)
    kept = rows if "_deleted" in rows.columns else rows.withColumn("_deleted", F.lit(False))
    out = kept.write.format(FORMAT).option("path", root).mode("overwrite" if clear else "append")
    (out.option("commit", commit) if commit else out).save()


def delete(keys: DataFrame, root: str, schema: T.StructType, key: str = "doc_id", commit: str | None = None) -> None:
    """Take the documents of `keys` out."""
    gone = keys.select(key).distinct().select(*[F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(True).alias("_deleted"))
    write(gone, root, commit)


def read(spark: SparkSession, root: str, schema: T.StructType, key: str = "doc_id") -> DataFrame:
    """The rows of the index."""
    empty = spark.createDataFrame([], schema)
    fs, path = files.FileSystem.from_uri(root)
    said = []
    for name in _manifests(fs, path):
        with fs.open_input_stream(f"{path}/manifests/{name}") as manifest:
            said.append(json.loads(manifest.read()))
    since = max((m["number"] for m in said if m["clears"]), default=0)
    parts = [(f.rsplit("/", 1)[1], m["number"], f"{root}/{f}") for m in said if m["number"] >= since for f in m["files"]]
    if not parts:
        return empty
    numbers = F.broadcast(spark.createDataFrame([p[:2] for p in parts], "_file string, _number long"))  # a row per file
    whole = T.StructType([*schema.fields, T.StructField("_deleted", T.BooleanType())])
    rows = spark.read.schema(whole).parquet(*[p[2] for p in parts]).withColumn("_file", F.col("_metadata.file_name")).join(numbers, "_file").drop("_file")
    same: Column = F.col(key).eqNullSafe(F.col("_key"))
    # Only documents that came more than once are looked up.
    again = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_number").alias("_newest"), F.min("_number").alias("_oldest")).where("_newest > _oldest").drop("_oldest")
    kept = rows.join(again, same, "left").where(F.col("_newest").isNull() | (F.col("_number") == F.col("_newest")))
    return kept.where(~F.col("_deleted")).select(*schema.names)
