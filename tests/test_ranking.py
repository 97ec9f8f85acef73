"""Ranking by BM25 and by shared words, against scoring every pair."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import evaluate, ranking


def brute(docs, items, k, bm25=True):
    df = Counter(w for _, ws in docs for w in set(ws))
    mean = sum(len(ws) for _, ws in docs) / max(1, len(docs))
    out = []
    for q, asked in items:
        scored = []
        for d, ws in docs:
            tf = Counter(ws)
            score = 0.0
            for w in set(asked) & set(tf):
                gain = tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                score += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * gain if bm25 else 1
            if set(asked) & set(tf):
                scored.append((-round(score, 6), d))
        out += [(q, d, round(-s, 6), i + 1) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    return [(i, [f"w{min(r.randrange(60), r.randrange(60), r.randrange(60))}" for _ in range(r.randint(0, 60))]) for i in range(n)]


def run(spark, docs, items, k, parts=3, **kw):
    kind = "array<string>"
    index = ranking.inverted(spark.createDataFrame(docs, f"doc_id long, ws {kind}").repartition(parts), "doc_id", F.col("ws"))
    found = ranking.search(index, spark.createDataFrame(items, f"item_id long, ws {kind}"), k, "item_id", F.col("ws"), **kw)
    return sorted((r.item_id, r.doc_id, r.score, r["rank"]) for r in found.collect())


@pytest.mark.parametrize("bm25", [True, False])
def test_best_documents(spark, bm25):
    docs, items = texts(1, 300), [(i, w[:9] + ["absent"]) for i, w in texts(2, 40)]
    for k in (1, 5, 400):
        assert run(spark, docs, items, k, bm25=bm25) == brute(docs, items, k, bm25)
    assert run(spark, docs, items, 5, bm25=bm25, wave_words=20) == brute(docs, items, 5, bm25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert run(spark, docs, items, 3, bm25=bm25) == brute(docs, items, 3, bm25)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_and_frequent_words(spark):
    """A third of all documents are one text, and one word is in every document: ties by id, and few postings read."""
    docs = [(i, ["all", "copy", "of"] if i % 3 == 0 else ["all", *w]) for i, w in texts(4, 240)]
    items = [(1, ["all"]), (2, ["all", "copy"]), (3, ["all", "w7", "w31", "w50"])]
    assert run(spark, docs, items, 4) == brute(docs, items, 4)
    row = ranking.inverted(spark.createDataFrame(docs, "doc_id long, ws array<string>").coalesce(1), "doc_id", F.col("ws")).collect()
    words = pa.array(["all", "w50"])
    mean = sum(len(w) for _, w in docs) / len(docs)
    df = [sum(x in w for _, w in docs) for x in ("all", "w50")]
    weight = np.array([math.log(1 + (240 - d + 0.5) / (d + 0.5)) for d in df])
    for r in row:
        block = ranking._Block(r.asDict(), words)
        _, scores, read = ranking.best_of_block(block, np.array([0, 1]), weight, mean, 1, 0.0)
        assert len(scores) == 1 and read < 2 * df[1] + 5


def test_words_of_all_scripts(spark):
    rows = spark.createDataFrame([("Ünïted don't 漢字 ab漢c カナ हिन्दी 12x_y",), (None,), ("...",)], "t string")
    got = [r[0] for r in rows.select(ranking.words(F.col("t"))).collect()]
    assert got == [["ünïted", "don", "t", "漢", "字", "ab", "漢", "c", "カ", "ナ", "हिन्दी", "12x", "y"], [], []]


def test_null_ids_and_nothing(spark):
    docs, items = [(1, ["a"]), (None, ["a"]), (2, None), (1, ["a"])], [(1, ["a", None]), (None, ["a"]), (3, None), (4, [])]
    assert [(r[0], r[1], r[3]) for r in run(spark, docs, items, 5)] == [(1, 1, 1), (1, 1, 2)]
    assert run(spark, [], items, 5) == run(spark, docs, [], 5) == []
    golden = spark.createDataFrame([(1, "Something Longish")], "item_id long, golden string")
    held = spark.createDataFrame([(9, "something else longish"), (8, "something")], "doc_id long, text string")
    assert [tuple(r) for r in evaluate.rank_by_shared_words(golden, held, 3).orderBy("rank").collect()] == [(1, 9, 2, 1), (1, 8, 1, 2)]


def test_blocks_are_bounded_in_words(spark, monkeypatch):
    """A partition of many or long texts becomes several blocks, with the same result."""
    docs, items = texts(6, 2500) + [(9000, ["long"] * 500)], [(i, w[:9]) for i, w in texts(2, 20)] + [(77, ["long"])]
    expected = brute(docs, items, 5)
    assert run(spark, docs, items, 5, parts=1) == expected
    batch = pa.RecordBatch.from_pydict({"words": [["a"] * 3, [], ["a"] * 300, ["b"] * 2, ["c"] * 2, []]})
    monkeypatch.setattr(ranking, "BLOCK_WORDS", 5)
    assert [len(b) for b in ranking._parts(iter([batch, batch.slice(0, 0)]))] == [2, 1, 3]
    parts = list(ranking._parts(iter([batch])))
    assert [len(b) for b in ranking._parts(iter([batch.slice(0, 1), batch.slice(3, 1), batch.slice(1, 1), batch.slice(4)]))] == [3, 2]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
