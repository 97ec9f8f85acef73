"""Product-quantised search: recall and rescored rows against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import quantised, vectors
from skein.plans import retrieval
from skein.sources import tables


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_with_a_tenth_of_the_rows_rescored(spark, sf):
    rows, asked = tables.vectors(spark, f"/root/testdata/{sf}"), retrieval.questions(spark, f"/root/testdata/{sf}")
    exact = {(r.query_id, r.chunk_id): r.score for r in vectors.top_k(rows, asked, 10).collect()}
    n = rows.count()
    sizes = []
    keep = quantised.short_list
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quantised, "short_list", lambda *a: sizes.append(keep(*a)) or sizes[-1])
        found = {(r.query_id, r.chunk_id): r.score for r in quantised.quantised_top_k(rows, asked, 10).collect()}
    print(sf, n, sizes, len(exact.keys() & found.keys()) / len(exact))
    assert len(exact.keys() & found.keys()) / len(exact) >= 0.9 and sizes[0] <= 0.1 * n
    assert all(abs(found[x] - exact[x]) < 1e-5 for x in exact.keys() & found.keys())


def test_a_whole_short_list_is_the_exact_search(spark, sf_dir):
    rows, asked = tables.vectors(spark, sf_dir), retrieval.questions(spark, sf_dir)
    exact = [tuple(r) for r in vectors.top_k(rows, asked, 5).orderBy("query_id", "pos").collect()]
    for kw in ({}, {"wave_bytes": 2000}):
        found = [tuple(r) for r in quantised.quantised_top_k(rows, asked, 5, size=10_000, **kw).orderBy("query_id", "pos").collect()]
        assert [x[:2] for x in found] == [x[:2] for x in exact]


def test_codes_are_the_nearest_entries():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 10))
    books = quantised.learned(x, lists=4, subspaces=3)
    centre, codes = books.encoded(x[:50])
    for i in range(50):
        assert centre[i] == ((books.centres - x[i]) ** 2).sum(axis=1).argmin()
        rest = x[i] - books.centres[centre[i]]
        whole = books.centres[centre[i]].copy()
        for j, (a, b) in enumerate(zip(books.edges[:-1], books.edges[1:])):
            assert codes[j, i] == ((books.books[j] - rest[a:b]) ** 2).sum(axis=1).argmin()
            whole[a:b] += books.books[j][codes[j, i]]
        q = r.normal(size=10)
        assert np.isclose(quantised.looked_up(books.tables(q), centre[i : i + 1], codes[:, i : i + 1])[0], whole @ q)


def test_odd_rows(spark):
    kind = "vec_id long, v array<double>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])], kind)
    got = [tuple(r) for r in quantised.quantised_top_k(rows, rows.where("vec_id = 1"), 9).orderBy("pos").collect()]
    assert [(g[1], g[2]) for g in got] == [(4, 0.707107), (4, 0.707107), (2, 0.0)]
    assert quantised.quantised_top_k(rows.limit(0), rows, 3).count() == quantised.quantised_top_k(rows, rows.limit(0), 3).count() == 0
    assert quantised.quantised_top_k(rows.where(F.col("vec_id") == 1), rows.where("vec_id = 1"), 3).count() == 0


def test_a_long_short_list_is_not_held(spark, monkeypatch):
    """However long the short list, a task gives k rows of a question, and looks through its rows part by part."""
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(600)], "vec_id long, v array<double>").repartition(3)
    asked = rows.where("vec_id % 20 = 0")
    exact = [tuple(x) for x in vectors.top_k(rows, asked, 4).orderBy("query_id", "pos").collect()]
    monkeypatch.setattr(quantised, "LOOK_ROWS", 70)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    handed, keep = [], vectors.ranked
    monkeypatch.setattr(vectors, "ranked", lambda hits, *a: handed.append(hits.count()) or keep(hits, *a))
    try:
        found = [tuple(x) for x in quantised.quantised_top_k(rows, asked, 4, size=300).orderBy("query_id", "pos").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == exact
    assert handed and handed[-1] <= 30 * 4 * max(4, rows.rdd.getNumPartitions())
