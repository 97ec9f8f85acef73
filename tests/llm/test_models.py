"""Language ID and quality: held-out accuracy, edge cases and the linear-time identity."""

import zlib

import numpy as np
import pytest

from skein.llm import language_id, quality


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_accuracy_and_edges(docs, corpus):
    got = language_id.language_query(docs).collect()
    assert len(got) == len(corpus)
    truth = {d: lang for d, _, lang, _, _ in corpus if d < 60}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[d]["lang_pred"] == "und" and by_id[d]["score"] == 0 and by_id[d]["rejected"] for d in (70, 71, 73))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_rows_or_labels(spark, docs, empty_docs):
    assert language_id.language_query(empty_docs).count() == 0
    from pyspark.sql import functions as F

    got = language_id.language_query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_language_keeps_extra_columns(odd_columns):
    model = language_id.fit(odd_columns)
    got = language_id.identify(odd_columns, model)
    assert got.columns.count("score") == got.columns.count("lang_pred") == 1 and {"node", "holder", "tokens", "rejected"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == odd_columns.count() and all(r["node"] == "extra" and isinstance(r["score"], float) for r in rows)


def test_window_table_equals_averaged_embeddings():
    random = np.random.default_rng(0)
    table, layer = random.normal(size=(language_id.BUCKETS, 4)), random.normal(size=(4, 3))
    model = language_id.LanguageModel(["a", "b", "c"], (table @ layer).astype(np.float32), np.zeros(3), 1.0, 0.0)
    text = "Some Words, über Straße 12 x"
    raw = b" " + language_id._normalised(text) + b" "
    buckets = np.concatenate([b for _, b in language_id._grams(np.frombuffer(raw, np.uint8))])
    z = table[buckets].mean(axis=0) @ layer
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(model.probabilities([text, None, ""])[0], want, atol=1e-4)


def test_factorisation_identity():
    random = np.random.default_rng(1)
    w, v = random.normal(size=50), random.normal(size=(50, 3))
    model = quality.FactorisationMachine(0.1, w, v, (v**2).sum(axis=1))
    at, x = np.array([3, 8, 20, 41]), np.array([0.5, -1.0, 0.2, 0.7])
    pairs = sum(v[at[i]] @ v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    want = 1 / (1 + np.exp(-(0.1 + w[at] @ x + pairs)))
    assert np.allclose(model.scores([(at, x), (at[:1], x[:1]), (at, x)]), [want, 1 / (1 + np.exp(-(0.1 + w[3] * 0.5))), want])


def test_quality_on_the_labelled_documents(spark, sf_dir):
    from skein.llm.common import documents

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.quality_query(documents(spark, sf_dir), labels).join(labels, "doc_id").collect()
    tested = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in tested]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_edges(spark, docs, empty_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(41, None), (42, 7)], "doc_id long, quality int")
    got = quality.quality_query(docs, labels)
    assert got.count() == docs.count() and got.where("score is null").count() == 0
    assert quality.quality_query(empty_docs, labels).count() == 0
    unlearned = [r["score"] for r in quality.quality_query(docs, labels.where("false")).collect()]
    assert len(unlearned) == docs.count() and all(abs(s - 0.5) < 0.1 for s in unlearned)


def test_rejection_level_is_bounded():
    """Rows of which the best probability is close to a half keep a level of MOST_LEVEL at most."""
    model = language_id.LanguageModel(["a", "b"], np.zeros((1, 2)), np.zeros(2), 1.0, 0.0)
    language_id._calibrate(model, np.array([[2.0, 0.0, 1.0], [0.0, 2.0, 1.0]] * 50), np.array([0, 1] * 50), np.zeros((4, 3)))
    assert model.coverage >= 1 - language_id.ALPHA and 0 <= model.false_acceptance <= 1
    assert 0 < model.least <= language_id.MOST_LEVEL


def test_calibration_equals_a_plain_one():
    random = np.random.default_rng(8)
    labels = random.integers(0, 3, 400)
    logits = random.normal(0, 1, (400, 4)) + 3 * (np.arange(4) == labels[:, None])
    nobody = random.normal(0, 1, (90, 4)) + 3 * (np.arange(4) == 3)
    model = language_id.LanguageModel(["a", "b", "c"], np.zeros((1, 4)), np.zeros(4), 1.0, 0.0)
    language_id._calibrate(model, logits, labels, nobody)

    def loss(t):
        return -sum(x[label] / t - np.log(sum(np.exp(v / t) for v in x[:3])) for x, label in zip(logits, labels))

    def chance(x):
        return sum(np.exp(x[:3])) / sum(np.exp(x))

    assert all(loss(model.temperature) <= loss(t) + 1e-6 for t in np.geomspace(0.05, 8, 60))
    right = sorted(chance(x) for x, label in zip(logits, labels) if max(range(3), key=lambda c: x[c]) == label)
    place = language_id.ALPHA * (len(right) - 1)
    level = right[int(place)] + (place - int(place)) * (right[int(place) + 1] - right[int(place)])
    assert np.isclose(model.least, min(level, language_id.MOST_LEVEL))
    assert np.isclose(model.coverage, np.mean([c >= model.least for c in right])) and np.isclose(model.false_acceptance, np.mean([chance(x) >= model.least for x in nobody]))


def test_descent_equals_plain_steps(monkeypatch):
    """Each step moves table, layer and bias against the gradient of one row's loss."""
    monkeypatch.setattr(language_id, "BUCKETS", 6)
    monkeypatch.setattr(language_id, "EPOCHS", 2)
    data = [(np.array([0, 2]), np.array([1, 3]), 0, False), (np.array([1, 2, 5]), np.array([2, 1, 1]), 1, False), (np.array([4]), np.array([7]), 2, False)]
    got = language_id._descend(data, 3, 5)
    random = np.random.default_rng(5)
    table, layer, bias = random.normal(0, 1 / language_id.DIMENSIONS, (6, language_id.DIMENSIONS)), np.zeros((language_id.DIMENSIONS, 3)), np.zeros(3)
    done = 0
    for _ in range(2):
        for i in random.permutation(3):
            bucket, n, label, _ = data[i]
            rate = 4.0 * (1 - done / 6)
            done += 1
            hidden = sum(table[b] * c for b, c in zip(bucket, n)) / n.sum()
            e = np.exp([hidden @ layer[:, c] + bias[c] for c in range(3)])
            gap = e / e.sum() - (np.arange(3) == label)
            moved = [rate * c / n.sum() * (layer @ gap) for c in n]
            layer = layer - rate * hidden[:, None] * gap[None]
            bias = bias - 0.01 * rate * gap
            for b, m in zip(bucket, moved):
                table[b] = table[b] - m
    assert all(np.allclose(a, b) for a, b in zip(got, (table, layer, bias)))


def test_texts_of_no_language_are_rejected(spark, sf_dir):
    """Held-out rows pass, the same rows with their letters in random order do not; whole long texts are learned."""
    from pyspark.sql import functions as F

    from skein.llm.common import bucket_of, documents

    rows = documents(spark, sf_dir.replace("sf0.001", "sf0.01")).where(F.length("text") > 100)
    held_out = bucket_of("doc_id", 4) == 2
    model = language_id.fit(rows.where(~held_out))
    assert model.coverage >= 0.99 and model.false_acceptance <= 0.15
    kept = rows.where(held_out & F.col("lang").isNotNull())
    assert language_id.identify(kept, model).where("rejected").count() <= 0.01 * kept.count()
    mixed = kept.withColumn("text", F.array_join(F.shuffle(F.split(F.substring("text", 1, 2000), ""), 3), ""))
    assert language_id.identify(mixed, model).where("not rejected").count() <= 0.1 * kept.count()


def test_fewer_rows_of_long_texts_are_drawn(spark, monkeypatch):
    """The bound on bytes lowers the number of rows; the texts that are drawn are read to their ends."""
    seen = []
    plain = language_id._descend
    monkeypatch.setattr(language_id, "_descend", lambda data, k, seed: seen.append(data) or plain(data, k, seed))
    texts = [(i, " ".join(f"word{chr(97 + (i * j) % 26)}{chr(97 + j % 23)}" for j in range(2000)), "ab"[i % 2]) for i in range(120)]
    rows = spark.createDataFrame([(i, t, lang) for i, t, lang in texts], "doc_id long, text string, lang string")
    language_id.fit(rows)
    monkeypatch.setattr(language_id, "TRAINING_BYTES", 60 * 3 * len(texts[0][1]) * language_id.ENTRY_BYTES)
    language_id.fit(rows)
    whole = [sum(1 for x in data if x[1].sum() > 10_000) for data in seen]
    assert 0 < whole[1] < 0.8 * whole[0]
    raw = b" " + language_id._normalised(texts[1][1]) + b" "
    windows = sum(len(at) for at, _ in language_id._grams(np.frombuffer(raw, np.uint8)))
    assert max(int(x[1].sum()) for x in seen[0]) >= windows


def test_more_languages_than_can_be_learned(spark):
    rows = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(language_id.MOST_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than"):
        language_id.fit(rows)
