"""Metadata of any shape as VARIANT columns."""

import json

from pyspark.sql import functions as F

from skein.operators import incremental


def merged(spark, rows, fields):
    df = spark.createDataFrame(rows, "document string, chunk string").select(F.parse_json("document").alias("d"), F.parse_json("chunk").alias("c"))
    return [None if r[0] is None else json.loads(r[0]) for r in df.select(F.to_json(incremental.typed_metadata(F.col("d"), F.col("c"), fields))).collect()]


def test_typed_metadata_keeps_types_and_chunk_first(spark):
    rows = [
        ('{"a": 1, "b": {"x": [1, 2.5]}, "z": 0}', '{"a": "one", "c": true}'), ('{"a": 1}', '{"a": null}'), ('{"a": {"x": 1, "y": 2}}', '{"a": {"x": 3}}'),
        (None, '{"b": 2}'), ('{"c": false}', None), (None, None), ("[1]", '"text"'), ('{"a.b": 5, "it\'s": 6}', "{}"),
    ]
    want = [{"a": "one", "b": {"x": [1, 2.5]}, "c": True}, {"a": 1}, {"a": {"x": 3}}, {"b": 2}, {"c": False}, {}, {}, {"a.b": 5, "it's": 6}]
    assert merged(spark, rows, ["a", "b", "c", "a.b", "it's"]) == want


def test_fields_are_read_from_files_without_the_rest(spark, tmp_path):
    rows = spark.range(200).select("id", F.parse_json(F.to_json(F.struct(F.struct(F.col("id").alias("chars")).alias("size"), F.repeat(F.lit("x"), 500).alias("note")))).alias("m"))
    rows.write.parquet(str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m")).where(F.variant_get("m", "$.size.chars", "long") >= 150).select("id", F.variant_get("m", "$.size.chars", "long").alias("chars"))
    assert sorted((r["id"], r["chars"]) for r in got.collect()) == [(i, i) for i in range(150, 200)]
    assert "m:struct<0:bigint" in got._jdf.queryExecution().executedPlan().toString()
