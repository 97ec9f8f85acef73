"""Evaluation of retrieval: samples, hits, rank metrics, summaries and comparisons."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import ranking
from skein.sources.snapshots import saved


def stratified_sample(rows: DataFrame, category: str, id_col: str, per_category: int, seed: int) -> DataFrame:
    """At most `per_category` rows of each category, in the order of a seeded hash."""
    draw = F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")), 256)
    order = Window.partitionBy(category).orderBy(draw, id_col)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_category).drop("_k")


def long_words(text: Column, least: int = 7) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: F.length(w) >= least))


def rank_by_shared_words(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k documents that share most long words with each item."""
    index = saved(ranking.inverted(docs, "doc_id", long_words(F.col("text"))))
    found = ranking.search(index, items, k, "item_id", long_words(F.col("golden")), bm25=False)
    return found.select("item_id", "doc_id", F.col("score").cast("long").alias("shared"), "rank")


def rank_by_bm25(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k documents that match each item best by BM25 over all words of all scripts."""
    index = saved(ranking.inverted(docs, "doc_id", ranking.words(F.col("text"))))
    return ranking.search(index, items, k, "item_id", ranking.words(F.col("golden")))


# Marks that don't count when answers are compared, beside white space.
MARKS = "，。！？、；：（）[]{}《》.,;:!?()<>/\\|_-—\"\"''\u3000"


def plain(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\f\r" + MARKS, "")


def hits(rows: DataFrame, ratio: float | None = 0.6) -> DataFrame:
    """Whether the golden answer is contained in the text, or (with `ratio`) similar enough to it; an empty answer or text is no hit.

    The ratio is 2 M / T, M the characters in matching blocks (longest first) and T those of both; it is worked out only for pairs that are not decided
    otherwise and whose lengths allow it.
    """
    golden, text = F.coalesce(plain(F.col("golden")), F.lit("")), F.coalesce(plain(F.col("text")), F.lit(""))
    some = (golden != "") & (text != "")
    contained = some & F.contains(text, golden)
    if ratio is None:
        return rows.withColumn("hit", contained)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and SequenceMatcher(None, x, y).ratio() > ratio for x, y in zip(a, b)], dtype=bool)

    shorter, both = F.least(F.length(golden), F.length(text)), F.length(golden) + F.length(text)
    open_pair = some & ~contained & (2 * shorter > ratio * both)
    return rows.withColumn("hit", contained | similar(F.when(open_pair, golden), F.when(open_pair, text)))


def rank_metrics(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """hit1, hit3, hit5 and the reciprocal rank of the first hit for every item; failed retrievals count as 0."""
    first = ranked.groupBy("item_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("_r"))
    joined = items.select("item_id", "scene").join(first, "item_id", "left")
    within = lambda k: F.coalesce((F.col("_r") <= k).cast("int"), F.lit(0)).alias(f"hit{k}")
    return joined.select("item_id", "scene", within(1), within(3), within(5), F.coalesce(F.round(1 / F.col("_r"), 6), F.lit(0.0)).alias("rr"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over all items (scene null) and by scene."""
    mean = lambda c, name=None: F.round(F.avg(c), 4).alias(name or c)
    return metrics.rollup("scene").agg(F.count(F.lit(1)).alias("n"), mean("hit1"), mean("hit3"), mean("hit5"), mean("rr", "mrr"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs over the same items and the difference of their reciprocal ranks."""
    left, right = a.select("item_id", F.col("rr").alias("rr_a")), b.select("item_id", F.col("rr").alias("rr_b"))
    return left.join(right, "item_id").withColumn("delta", F.round(F.col("rr_b") - F.col("rr_a"), 6))


def judge_summary(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each externally given score without nulls; 0 if there are only nulls."""
    return scores.agg(*[F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in columns])
