"""Replacement and finding of many terms in one pass against one rule after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import terms
from skein.operators import understanding as u


def one_by_one(text, rules):
    for term, target in rules:
        standing = f"(?={re.escape(term)}){re.escape(target)}|" if target else ""
        text = re.sub(standing + re.escape(term), lambda _, x=target: x, text)
    return text


@pytest.mark.parametrize("letters,longest", [("ab", 3), ("abc", 4), ("abcdefgh é漢", 6)])
def test_random_rules(letters, longest):
    """Few letters, so that targets bring about terms, overlap with them and stand already."""
    r = random.Random(longest)
    word = lambda lo, hi: "".join(r.choice(letters) for _ in range(r.randint(lo, hi)))
    for _ in range(1500):
        rules = [(word(1, longest), word(0, longest + 1)) for _ in range(r.randint(0, 12))]
        t = terms.Terms(rules)
        for _ in range(4):
            text = word(0, 60)
            assert t.replaced(text) == one_by_one(text, rules), (rules, text)


def test_long_terms_and_chains():
    long = "x" * 200
    rules = [("a", "x"), (long, "done"), ("done", ""), ("yz", "q")]
    assert terms.Terms(rules).replaced("y" + "x" * 199 + "a" + "z") == "q"
    chain = [(f"<{i}>", f"<{i + 1}>") for i in range(3000)]
    assert terms.Terms(chain).replaced("so <0>!") == "so <3000>!"
    assert terms.Terms(chain[::-1]).replaced("so <0>!") == "so <1>!"


def test_five_thousand_rules_in_one_scan(spark, sf_dir):
    r = random.Random(1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = sorted({w for d in docs.collect() for w in (d.text or "").split()})
    rules = [(w, r.choice([w + " (term)", w[::-1], "the", r.choice(words)])) for w in r.sample(words, min(5000, len(words)))]
    rules += [(f"absent{i}", "x") for i in range(5000 - len(rules))]
    got = docs.withColumn("new", u.normalized_terms(F.col("text"), rules))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {d.doc_id: d for d in got.collect()}
    for i in list(rows)[::20]:
        assert rows[i].new == (None if rows[i].text is None else one_by_one(rows[i].text, rules))


def test_priorities_and_standing_targets(spark):
    kind = "source_term string, target_term string, match_type int, priority int, enabled int"
    rules = spark.createDataFrame([("AI", "AI platform", 1, 5, 1), ("platform", "Platform", 1, 1, 1), ("AI platform", "P", 1, 5, 1), ("x", "y", None, None, 1), ("y", "z", 1, 9, 1)], kind)
    rows = spark.createDataFrame([("AI and AI platform x",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(u.normalized_terms(F.col("t"), u.term_rules(rules))).collect()]
    assert got == [one_by_one("AI and AI platform x", u.term_rules(rules)), None, ""] and got[0] == "AI Platform and P z"


def test_held_words(spark):
    rows = spark.createDataFrame([("a bc b",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(terms.held(F.col("t"), ["c", "bc", "zz", "c", "b"])).collect()] == [["c", "bc", "b"], [], []]
    with pytest.raises(ValueError, match="characters"):
        terms.held(F.col("t"), ["x" * (terms.MOST_CHARACTERS + 1)])
