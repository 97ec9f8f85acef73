"""Training-corpus pipeline: language, quality, near duplicates, personal data, packing; counted as part of skein.llm.

Each stage takes (spark, docs, sf_dir) and works on every row that the stages before it have kept; run() writes each result as
Parquet to the shared folder and reads it again. All stages but the last return the columns of `documents`.

Edge cases: null and empty texts have no letter and go with the first stage; very long texts are read whole; an empty table passes through all
stages. Repeated rows are near duplicates of each other, of which one stays; of a group of near duplicates the row with the smallest id stays
(null ids last, ties of one id by a hash of the text), and rows of one id, or of none, whose texts are unlike all stay. Extra columns stay until the last stage
whatever their names: each stage carries the input row as one struct, which no result of an operator can overwrite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard_join, language_id, packing, pii, quality
from skein.llm.common import beside, bounded_batches, perhaps, row_hash, saved

SURROGATE_KEY = "skein-surrogates"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified; the model is learned from the labelled rows of the stage's input."""
    bounded_batches(spark)
    model = language_id.fit(docs)
    return language_id.identify(beside(docs, text=F.col("text")), model).where(~F.col("rejected")).select("_row.*")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts as good."""
    bounded_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(beside(docs, text=F.col("text"), n_chars=F.col("n_chars")), model)
    return scored.where(F.col("predicted") == 1).select("_row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    bounded_batches(spark)
    rows = jaccard_join.near_rows(docs, size=5, percent=80).where("part is not null")
    kinds = saved(rows.groupBy("part", "id", "holder").agg(F.count(F.lit(1)).alias("n")))
    rank = F.struct(F.col("id").isNull(), "id", "holder")
    first = kinds.groupBy("part").agg(F.min_by("holder", rank).alias("first"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    gone = saved(kinds.join(first, "part").where("holder <> first").select("holder"))
    repeated = kinds.where("n > 1").select("holder")
    # Only rows that may be a copy are shuffled; rows without words have no part and all stay.
    held = beside(docs, _holder=row_hash("doc_id", "text"), _words=F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    marked = perhaps(held, F.col("_holder"), saved(gone.unionByName(repeated)))
    doubtful = F.col("_perhaps") & F.col("_words")
    once = marked.where(doubtful).groupBy("_holder").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    kept = once.join(gone.withColumnRenamed("holder", "_holder").hint("shuffle_merge"), "_holder", "left_anti")
    return marked.where(~doubtful).select("_row.*").unionByName(kept.select("_row.*"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for personal data; n_chars follows the new text."""
    new = pii.replace_entities(beside(docs, doc_id=F.col("doc_id"), text=F.col("text")), SURROGATE_KEY)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return new.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns])


def pack_by_length(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each row."""
    return packing.packing_query(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack_by_length),
]

# Learned models and the packing optimum have no SQL form. Tests restate the near-duplicate, personal-data and packing stages by brute force, and
# compare the rows that the two classifier stages keep, whole, with single-row predictions of the models.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
