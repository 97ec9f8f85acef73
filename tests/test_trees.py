"""Closure, owners and paths of deep and odd trees, against walks from node to node."""

import random

import pytest

from skein.operators import understanding as u

KIND = "code string, parent string, name string, lvl int, enabled int"


def forest(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i == 0 or r.random() < 0.1 else "gone" if r.random() < 0.05 else str(r.randrange(max(0, i - 6), i))
        rows.append((str(i), parent, f"n{i % 9}", r.randrange(3), r.randrange(2)))
    r.shuffle(rows)
    return rows


def walks(rows):
    """Each node's line upwards, itself first."""
    of = {r[0]: r for r in rows}
    out = {}
    for code in of:
        line = [code]
        while of[line[-1]][1] in of:
            line.append(of[line[-1]][1])
        out[code] = line
    return of, out


def test_random_forests(spark):
    rows = forest(3, 300)
    of, lines = walks(rows)
    nodes = spark.createDataFrame(rows, KIND)
    pairs = {(a, c, s) for c, line in lines.items() for s, a in enumerate(line)}
    got = [tuple(r) for r in u.descendants(nodes).collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    some = spark.createDataFrame([("4",), ("17",), ("17",), ("missing",)], "code string")
    assert {tuple(r) for r in u.descendants(nodes, some).collect()} == {p for p in pairs if p[0] in ("4", "17")}
    assert {(r.code, r.path, r.depth) for r in u.paths(nodes).collect()} == {(c, " > ".join(of[a][2] for a in reversed(line)), len(line)) for c, line in lines.items()}
    end = lambda a: of[a][1] not in of or (of[a][3] == 1 and of[of[a][1]][3] == 0)
    assert {(r.code, r.system) for r in u.owning_system(nodes).collect()} == {(c, next(a for a in line if end(a))) for c, line in lines.items()}


def test_a_chain_of_ten_thousand_nodes(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth."""
    rounds = []
    keep = u.saved
    monkeypatch.setattr(u, "saved", lambda df: rounds.append(1) or keep(df))
    n = 10_000
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, "x", 0 if i == 0 else 2, 1) for i in range(n)], KIND)
    assert {r.system for r in u.owning_system(nodes).collect()} == {"0"}
    assert len(rounds) <= 15 + 2  # and its two tables to begin with
    rounds.clear()
    some = spark.createDataFrame([("0",), ("9000",)], "code string")
    assert u.descendants(nodes, some).count() == n + 1000
    assert len(rounds) <= 2 * 15


@pytest.mark.parametrize("rows", [[("a", "a")], [("a", "b"), ("b", "a")], [("r", None), ("a", "c"), ("b", "a"), ("c", "b"), ("d", "r")]])
def test_cycles_are_errors(spark, rows):
    nodes = spark.createDataFrame([(c, p, c, 2, 1) for c, p in rows], KIND)
    for f in (u.descendants, u.paths, u.owning_system):
        with pytest.raises(ValueError, match="cycle"):
            f(nodes)


def test_no_nodes(spark):
    none = spark.createDataFrame([], KIND)
    assert u.descendants(none).count() == u.paths(none).count() == u.owning_system(none).count() == 0
