"""The index as a data source: atomic commits, replacement, deletion, failure and repetition."""

import pytest
from pyspark.sql import functions as F

from skein.sources import index, jsonl

KIND = "doc_id long, chunk long, content string"


def rows(spark, *docs, mark=""):
    return spark.createDataFrame([(d, c, f"{d}.{c}{mark}") for d in docs for c in range(3)], KIND).repartition(4)


def held(spark, root):
    return sorted((r.doc_id, r.content) for r in index.read(spark, root, rows(spark, 1).schema).collect())


def said(*docs, mark=""):
    return [(d, f"{d}.{c}{mark}") for d in docs for c in range(3)]


def test_documents_are_replaced_and_deleted(spark, tmp_path):
    root = str(tmp_path / "index")
    assert held(spark, root) == []
    index.write(rows(spark, 1, 2, 3), root)
    index.write(rows(spark, 2, mark="new").where("chunk < 1"), root)
    assert held(spark, root) == sorted(said(1, 3) + [(2, "2.0new")])
    index.delete(spark.createDataFrame([(1,), (9,), (1,)], "doc_id long"), root, rows(spark, 1).schema)
    assert held(spark, root) == sorted(said(3) + [(2, "2.0new")])
    index.write(rows(spark, 1, mark="back"), root)
    assert held(spark, root) == sorted(said(1, mark="back") + said(3) + [(2, "2.0new")])
    index.write(rows(spark, 5), root, clear=True)
    assert held(spark, root) == said(5)


def test_a_failed_task_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path / "index")
    index.write(rows(spark, 1, 2), root)
    bad = rows(spark, 1, 2, 3, 4, 5, mark="bad").withColumn("content", F.when(F.col("doc_id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        index.write(bad, root, "bad")
    assert held(spark, root) == said(1, 2)
    index.write(rows(spark, 4), root, "bad")  # the same commit can be written once it works
    assert held(spark, root) == said(1, 2, 4)


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    index.write(rows(spark, 1), root, "b0")
    index.write(rows(spark, 1, mark="x"), root, "b1")
    index.write(rows(spark, 1, 7), root, "b0")
    assert held(spark, root) == said(1, mark="x")
    files = [p for p in (tmp_path / "index" / "parts").rglob("*.parquet")]
    assert {p.parent.name for p in files} == {"b0", "b1"} and len(list((tmp_path / "index" / "manifests").iterdir())) == 2
    with pytest.raises(Exception, match="commit"):
        index.write(rows(spark, 1), root, "a-b")


def test_empty_writes_and_null_keys(spark, tmp_path):
    root = str(tmp_path / "index")
    index.write(rows(spark, 1).limit(0), root)
    assert held(spark, root) == []
    null = spark.createDataFrame([(None, 0, "none")], KIND)
    index.write(null.unionByName(rows(spark, 1)), root)
    index.write(null.withColumn("content", F.lit("later")), root)
    got = index.read(spark, root, null.schema).collect()
    assert sorted((str(r.doc_id), r.content) for r in got) == [*[("1", f"1.{c}") for c in range(3)], ("None", "later")]


def test_streamed_batches_write_the_index(spark, tmp_path):
    """Each batch is a commit named by its number, so one that runs again does no harm."""
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    stream = lambda: spark.readStream.schema(KIND).parquet(source).writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
    step = lambda batch, n: (index.write(batch, root, f"b{n}"), index.write(batch, root, f"b{n}"))
    for docs in ((1, 2), (2, 3)):
        rows(spark, *docs, mark=str(docs[0])).write.mode("append").parquet(source)
        stream().foreachBatch(step).start().awaitTermination()
    assert held(spark, root) == sorted(said(1, mark="1") + said(2, 3, mark="2"))


def test_evaluation_files(spark, tmp_path):
    lines = tmp_path / "eval.jsonl"
    lines.write_text('{"query": "q", "golden_answer": "a", "scene": "s"}\nbroken\n{"query": "r"}\n')
    assert [tuple(r) for r in jsonl.evaluation_set(spark, str(lines)).collect()] == [("q", "a", "s"), ("r", None, None)]
    summary = spark.createDataFrame([("s", 1.0)], "scene string, mrr double")
    for _ in range(2):
        jsonl.write_report(summary, rows(spark, 1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).count() == 1 and spark.read.json(str(tmp_path / "report" / "rows")).count() == 3
