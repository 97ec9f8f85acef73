"""Hyperedges: entities of texts and edges, one-hop matching, and the wording of an edge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import terms
from skein.sources.snapshots import saved

SLOTS = ["equipment", "condition", "parameter", "fault", "sop_doc"]


def entities(edge_slots: list[str] = SLOTS) -> Column:
    """Distinct non-null slot values and extension values of an edge."""
    slots = F.array_compact(F.array(*[F.col(c) for c in edge_slots]))
    more = F.coalesce(F.transform("extended_entities", lambda e: e["value"]), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(slots, more), lambda x: x.isNotNull() & (F.trim(x) != "")))


def postings(edges: DataFrame) -> DataFrame:
    """(edge_id, entity) of every edge that has an entity."""
    return edges.select("edge_id", F.explode(entities()).alias("entity"))


def heads(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query_id, edge_id: the first k edges of each entity that a question asks for."""
    order = Window.partitionBy("entity").orderBy("edge_id")
    first = index.join(asked.select("entity").distinct(), "entity", "left_semi").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    return asked.join(first.drop("_k"), "entity").select("query_id", "edge_id").distinct()


def _best_of_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """In one block, the best k edges of each question that hold at least two of its entities."""

    def best(postings: pa.Table, asked: pa.Table) -> pa.Table:
        edges, place = np.unique(postings.column("edge_id").to_numpy(), return_inverse=True)
        coded = postings.column("entity").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.lexsort((place, codes))
        starts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        of = {e: place[order[starts[i] : starts[i + 1]]] for i, e in enumerate(coded.dictionary.to_pylist())}
        queries: dict[object, list[np.ndarray]] = {}
        for q, e in zip(asked.column("query_id").to_pylist(), asked.column("entity").to_pylist()):
            if e in of:
                queries.setdefault(q, []).append(of[e])
        out: list[tuple[object, np.ndarray, np.ndarray]] = []
        for q, lists in queries.items():
            # An edge with two of the entities holds one of all but the longest list: only those are gone through, the longest is looked up.
            lists.sort(key=len)
            found, hits = np.unique(np.concatenate(lists[:-1] or [place[:0]]), return_counts=True)
            longest = lists[-1]
            at = np.minimum(np.searchsorted(longest, found), len(longest) - 1)
            hits = hits + (longest[at] == found)
            found, hits = found[hits >= 2], hits[hits >= 2]
            first = np.lexsort((found, -hits))[:k]
            out.append((q, edges[found[first]], hits[first]))
        n = [len(x[1]) for x in out]
        kinds = [asked.schema.field("query_id").type, postings.schema.field("edge_id").type, pa.int64()]
        query = [q for (q, _, _), c in zip(out, n) for _ in range(c)]
        columns = [query, [e for _, es, _ in out for e in es.tolist()], [h for _, _, hs in out for h in hs.tolist()]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "edge_id", "hits"])

    return best


def blocks_to_look_into(asked: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, block: where at least two of a question's entities are held, by a table of entities and blocks; `index` has block."""
    present = index.join(asked.select("entity").distinct(), "entity", "left_semi").select("entity", "block").distinct()
    return asked.join(present, "entity").groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("bound")).where("bound >= 2").select("query_id", "block")


def match(asked: DataFrame, index: DataFrame, k: int, block_edges: int = 1 << 16, block_questions: int = 1 << 12) -> DataFrame:
    """The k edges with most of a question's entities, smaller ids first among equals; score is the share of the question's entities.

    An edge with one of the entities is among the best only if it is one of the first k of that entity, so k rows per entity stand for all of them. Edges are dealt to blocks of about `block_edges`;
    a block in which fewer than two of a question's entities occur cannot hold a better edge and is not looked into. In the others a task has the block's lists and up to about `block_questions`
    questions, goes through all lists of a question but the longest and gives its best k. No row is made for a question and each edge of an entity, however many hold it.
    """
    asked = asked.select("query_id", "entity").where(F.col("query_id").isNotNull() & F.col("entity").isNotNull()).distinct()
    index = index.select("edge_id", "entity").where(F.col("edge_id").isNotNull() & F.col("entity").isNotNull())
    n = index.agg(F.approx_count_distinct("edge_id")).first()[0]
    dealt = index.distinct().withColumn("block", F.pmod(F.xxhash64("edge_id"), F.lit(max(1, -(-n // block_edges)))).cast("int"))
    wanted = saved(blocks_to_look_into(asked, dealt))
    shares = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_questions).cast("int").alias("shares"))
    lists = dealt.join(asked.select("entity").distinct(), "entity", "left_semi").join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    questions = asked.join(wanted, "query_id").join(shares, "block").select(F.col("block").alias("_block"), F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int").alias("_share"), "query_id", "entity")
    kinds = {**dict(asked.dtypes), **dict(index.dtypes)}
    several = lists.groupBy("block", "share").cogroup(questions.groupBy("_block", "_share")).applyInArrow(_best_of_block(k), f"query_id {kinds['query_id']}, edge_id {kinds['edge_id']}, hits long")
    both = several.unionByName(heads(asked, index.distinct(), k).withColumn("hits", F.lit(1).cast("long"))).groupBy("query_id", "edge_id").agg(F.max("hits").alias("hits"))
    sized = both.join(asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked")), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "edge_id")
    best = sized.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= k)
    return best.select("query_id", "edge_id", "hits", F.round(F.col("hits") / F.col("asked"), 6).alias("score"), "pos")


def path(slots: list[str] = ("equipment", "condition", "parameter", "fault")) -> Column:
    return F.concat_ws(" → ", *[F.when(F.trim(c) != "", F.col(c)) for c in slots])


def described(edges: DataFrame) -> DataFrame:
    """Add the phrase of the non-null slots and the path of an edge."""
    named = [F.concat(F.lit(c.replace("sop_doc", "SOP") + " "), F.col(c)) for c in SLOTS]
    more = F.transform("extended_entities", lambda e: F.concat(e["label"], F.lit(" "), e["value"]))
    return edges.withColumn("said", F.concat_ws("; ", *named, more)).withColumn("path", path())


def extract_entities(texts: DataFrame, text_col: str, patterns: list[str], words: list[str]) -> DataFrame:
    """Distinct entities of each text, one row each: matches of the patterns and the words it contains, all of which are looked for in one pass."""
    text = F.col(text_col)
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    known = terms.held(text, words) if words else F.array().cast("array<string>")
    return texts.withColumn("entity", F.explode(F.array_distinct(reduce(lambda a, b: F.concat(a, b), [*found, known]))))
