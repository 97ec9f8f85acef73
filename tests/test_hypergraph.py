"""Best edges by blocks against counting all."""

import random
from collections import Counter

import pytest

from skein.operators import hypergraph


def brute(asked, index, k):
    of, questions = {}, {}
    for edge, entity in set(index):
        if edge is not None and entity is not None:
            of.setdefault(entity, set()).add(edge)
    for q, entity in set(asked):
        if q is not None and entity is not None:
            questions.setdefault(q, set()).add(entity)
    out = []
    for q, entities in questions.items():
        hits = Counter(e for x in entities for e in of.get(x, ()))
        best = sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, e, h, round(h / len(entities), 6), i + 1) for i, (e, h) in enumerate(best)]
    return sorted(out)


def run(spark, asked, index, k, **kw):
    a = spark.createDataFrame(asked, "query_id long, entity string").repartition(3)
    b = spark.createDataFrame(index, "edge_id long, entity string").repartition(3)
    return sorted(tuple(r) for r in hypergraph.match(a, b, k, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"block_edges": 20, "block_questions": 5}])
def test_random_edges(spark, kw):
    r = random.Random(2)
    index = [(e, f"x{min(r.randrange(40), r.randrange(40))}") for e in range(400) for _ in range(r.randint(1, 6))] + [(None, "x1"), (5, None), (5, "x1"), (5, "x1")]
    asked = [(q, f"x{r.randrange(45)}") for q in range(60) for _ in range(r.randint(1, 6))] + [(None, "x1"), (3, None), (77, "nowhere"), (4, "x2"), (4, "x2")]
    for k in (1, 4, 500):
        assert run(spark, asked, index, k, **kw) == brute(asked, index, k)


def test_an_entity_held_by_half_of_all_edges(spark):
    """Rows made for the questions follow k and the blocks, not the edges that hold the hot entity."""
    r = random.Random(7)
    index = [(e, "hot") for e in range(0, 20_000, 2)] + [(e, "warm") for e in range(0, 20_000, 3)] + [(e, f"rare{r.randrange(500)}") for e in range(20_000)]
    asked = [(q, x) for q in range(100) for x in ["hot", f"rare{q}", *["warm"] * (q % 2)]]
    assert run(spark, asked, index, 10, block_edges=4096) == brute(asked, index, 10)
    a, b = spark.createDataFrame(asked, "query_id long, entity string"), spark.createDataFrame(index, "edge_id long, entity string")
    assert hypergraph.heads(a, b, 10).count() <= 10 * len(set(asked))


def test_string_ids_and_nothing(spark):
    a = spark.createDataFrame([("q", "x"), ("q", "y")], "query_id string, entity string")
    b = spark.createDataFrame([("é", "x"), ("b", "x"), ("é", "y"), ("a", "y")], "edge_id string, entity string")
    assert [tuple(r) for r in hypergraph.match(a, b, 2).orderBy("pos").collect()] == [("q", "é", 2, 1.0, 1), ("q", "a", 1, 0.5, 2)]
    assert hypergraph.match(a.limit(0), b, 2).count() == hypergraph.match(a, b.limit(0), 2).count() == 0
