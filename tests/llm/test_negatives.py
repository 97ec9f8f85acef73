"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import negatives as neg

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, positives=5, negatives=3):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for i, label, v in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            held = [(n, k) for n, k, m in scored if m != label and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(held)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if not kw:
        return sorted(tuple(r) for r in neg.negatives_query(df).collect())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in neg.hard_negatives(df, F.col("vec_id") % 50 == 0, label, **kw).collect())


def clustered(seed, n, dimension, centres=6):
    r = np.random.default_rng(seed)
    base = r.normal(size=(centres, dimension))
    return [(i, [float(x) for x in base[i % centres] + r.normal(scale=0.7, size=dimension)], int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("dimension", [1, 3, 10, 64])
def test_clustered_vectors(spark, dimension):
    rows = clustered(dimension, 420, dimension)
    assert run(spark, rows) == brute(rows)


def test_slabs_and_waves(spark, monkeypatch):
    """Many slabs in a task and many waves give what one of each gives."""
    rows = clustered(2, 600, 16)
    monkeypatch.setattr(neg, "SLAB_ROWS", 37)
    monkeypatch.setattr(neg, "FIRST", 4)
    assert run(spark, rows, wave_bytes=600) == brute(rows)
    assert run(spark, rows, positives=2, negatives=7) == brute(rows, 2, 7)


def test_ties_and_a_hot_vector(spark):
    """A third of all rows are one vector, over several labels."""
    rows = clustered(4, 300, 8)
    hot = rows[0][1]
    rows = [(i, hot if i % 3 == 0 else v, label) for i, v, label in rows]
    rows += [(i + 1000, [round(x) / 2 for x in v], label) for i, v, label in rows]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(5, 200, 4)
    rows += [(None, [1.0] * 4, 1), (1000, None, 1), (1050, [1.0, None, 0.0, 2.0], 1), (1001, [float("nan")] * 4, 1), (1100, [float("inf"), 1.0, 1.0, 1.0], 1), (1002, [1.0] * 4, None), (1003, [0.0] * 4, 1), (1150, [0.0] * 4, 9), (1200, [-1.0, -1.0, -1.0, -1.0], 8)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert not [r for r in got if r[0] in (1000, 1050, 1100)]
    assert run(spark, []) == []
    df = spark.createDataFrame(rows + [(1300, [1.0], 1)], SCHEMA)
    for name in ("id", "v", "anchor", "pair", "score", "number"):
        df = df.withColumn(name, F.lit("extra"))
    assert sorted(tuple(r) for r in neg.negatives_query(df).collect()) == got


def test_bounds_hold_and_narrow():
    """Each level's bounds enclose the scores, and the levels leave fewer and fewer rows."""
    r = np.random.default_rng(8)
    for dimension in (5, 16, 64, 100):
        v = np.floor(r.normal(size=(500, dimension)) * 256 + r.normal(size=(500, 1)) * 300).astype(np.int64)
        a = v[:1]
        widths = []
        for level in neg.levels(dimension):
            mean, deviation = (x.astype(np.float32) for x in neg.summaries(v, level))
            own = [x[0] for x in neg.summaries(a, level)]
            low, high = neg.bounds(tuple(own), mean, deviation)
            assert (low <= v @ a[0]).all() and (high >= v @ a[0]).all()
            widths.append(float((high - low).mean()))
        assert widths == sorted(widths, reverse=True)
    # Vectors that differ by segment are mostly ruled out without exact scores.
    parts = np.repeat(r.normal(size=(4000, 8)) * 300, 8, axis=1)
    v = np.floor(parts + r.normal(size=parts.shape) * 20).astype(np.int64)
    marks = b"".join(x.astype(np.float32).tobytes() for level in neg.levels(64) for x in neg.summaries(v, level))
    slab = neg.Slab({"n": 4000, "ids": np.arange(4000).tobytes(), "labels": np.zeros(4000, np.int64).tobytes(), "v": v.tobytes(), "marks": marks}, 64)
    scores = np.sort(v @ v[0])
    taken = [0, 0, 0]
    left = neg.survivors(slab, [tuple(x[0] for x in neg.summaries(v[:1], level)) for level in neg.levels(64)], np.arange(4000), float(scores[-6]), np.inf, taken)
    assert set(np.argsort(v @ v[0])[-6:]) <= set(left.tolist()) and len(left) < 200 and taken[0] >= taken[1] >= taken[2]
