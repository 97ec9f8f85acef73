"""JSON-lines and binary scans, and the report sink."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAQ = "question string, answer string, category string, source_doc string"
EDGE = "edgeId string, equipment string, condition string, parameter string, fault string, sopDoc string, extendedEntities array<struct<label:string,value:string>>, sourceDocument string"
IMAGE = "image_path string, description string, category string, source_url string, license string, generated_by string"
EVAL = "query string, golden_answer string, scene string"


def faq(spark: SparkSession, path: str) -> DataFrame:
    """FAQ rows with a question and an answer; the content is both, on two lines."""
    rows = spark.read.schema(FAQ).option("mode", "DROPMALFORMED").json(path)
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return rows.where(said("question") & said("answer")).withColumn("content", F.concat_ws("\n", "question", "answer"))


def hyperedges(spark: SparkSession, path: str) -> DataFrame:
    """Hyperedges; lines that are no JSON objects are dropped."""
    return spark.read.schema(EDGE).option("mode", "DROPMALFORMED").json(path)


def image_descriptions(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Image descriptions as chunks of a collection."""
    rows = spark.read.schema(IMAGE).option("mode", "DROPMALFORMED").json(path).where(F.trim("description") != "")
    return rows.select(F.lit(collection).alias("collection"), F.sha2("image_path", 256).alias("chunk_id"), F.col("description").alias("content"), F.create_map(F.lit("image_path"), "image_path", F.lit("category"), "category").alias("metadata"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their golden answers and scenes; lines that are no JSON objects are dropped."""
    return spark.read.schema(EVAL).option("mode", "DROPMALFORMED").json(path)


@contextmanager
def listed_together(spark: SparkSession) -> Iterator[None]:
    """While files are listed, a few tasks for each core do it; by default each of up to 10,000 folders or files is a task of its own, which takes longer to start than to list."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Bytes and guessed type of the files of a folder (any file system that Spark reads)."""
    kinds = {"pdf": "application/pdf", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "json": "application/json", "png": "image/png", "jpg": "image/jpeg"}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    with listed_together(spark):
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("mime", F.coalesce(F.element_at(table, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))), F.lit("application/octet-stream")))


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """An evaluation's summary and rows as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")
