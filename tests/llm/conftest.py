import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = {
    "en": "the and of that with from was thing reading other water house under night every small".split(),
    "de": "der und nicht das über zwischen straße haus größe wasser jeder klein nacht gegen wurde".split(),
}


def prose(random_, lang, n):
    return " ".join(random_.choice(WORDS[lang]) + random_.choice(["", "s", "en"]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """Rows with prose of two languages, copies, edited copies, nulls, empty and very long texts, repeated rows and symbols."""
    r = random.Random(5)
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, prose(r, lang, r.randint(5, 120)), lang, "s", 0))
    base = prose(r, "en", 200)
    for i in range(60, 70):
        words = base.split()
        words[r.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words) if i > 61 else base, "en", "s", 0))
    rows += [(70, None, None, None, None), (71, "", "en", "s", 0), (72, "word", None, "s", 0), (73, "12 345 !!", "en", "s", 0), (74, "x" * 300_000, "en", "s", 0), (75, prose(r, "de", 20_000), "de", "s", 0), (0, rows[0][1], "de", "s", 0), (76, "é漢字😀 \x1c a b\n\n\n", "en", None, 3)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s, _ in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def odd_columns(docs):
    """The same rows with columns whose names an operator may use inside."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("node", "n", "score", "id", "bucket", "holder", "shard", "tokens", "lang_pred"):
        out = out.withColumn(name, F.lit("extra"))
    return out
