"""Passages of benchmark items in documents against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontamination as dec


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, size=dec.WINDOW):
    windows = []
    for item, text in items:
        w = plain_words(text)
        n = min(size, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if w else []
    out = []
    for doc, text in docs:
        w = plain_words(text)
        at = {}
        for n in {len(x) for _, x in windows}:
            for i in range(len(w) - n + 1):
                at.setdefault(tuple(w[i : i + n]), []).append(i)
        hit, found = set(), set()
        for item, x in windows:
            for i in at.get(x, ()):
                hit |= set(range(i, i + len(x)))
                found |= {str(item)} - {"None"}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    if not kw:
        return sorted((tuple(r) for r in dec.decontamination_query(d, b).collect()), key=repr)
    found = dec.contamination(d, b, **kw).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.first for s in r.spans), len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), bool(r.spans)) for r in found), key=repr)


@pytest.fixture(scope="module")
def planted():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "größe", "7", "漢字"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 25, 60, 200, 30, 12])]
    items += [(100, items[7][1]), (7, items[7][1]), (101, None), (102, " ?! "), (None, " ".join(say(14))), (103, "the " * 15), (104, items[8][1].upper().replace(" ", " -- "))]
    docs = [(None, None), (0, ""), (1, "..."), (2, "the " * 40), (3, "the " * 9), (4, items[9][1] + " " + items[9][1])]
    for i in range(5, 60):
        words = say(r.randint(1, 200))
        for _ in range(r.randint(0, 3)):
            source = plain_words(r.choice(items)[1])
            if source:
                lo = r.randrange(len(source))
                at = r.randrange(len(words) + 1)
                words[at:at] = source[lo : lo + r.randint(1, 40)]
        docs.append((i, r.choice([" ", ", ", "\n", "\x00", "_"]).join(words).title()))
    docs += [docs[10], docs[10], (61, " ".join(say(30)) + " " + items[16][1])]
    return docs, items


def test_passages_of_random_documents(spark, planted):
    docs, items = planted
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("kw", [{"block_bytes": 700}, {"window": 4}, {"window": 2, "shingle": 3}, {"shingle": 1}])
def test_blocks_windows_and_shingles(spark, planted, kw):
    docs, items = planted
    assert run(spark, docs, items, **kw) == brute(docs, items, kw.get("window", dec.WINDOW))


def test_long_texts_and_pieces(spark, monkeypatch):
    """A text longer than a scanned piece, an item longer than a piece of items, and passages across their edges."""
    r = random.Random(9)
    words = [f"v{r.randrange(5000)}" for _ in range(260_000)]
    item = [f"i{r.randrange(900)}" for _ in range(5000)]
    edge = 1 << 20
    text = " ".join(words)
    at = text.rindex(" ", 0, edge)
    docs = [(1, text[: at - 20] + " " + " ".join(item[1985:2030]) + " " + text[at:]), (2, "x" * (2 << 20) + " " + " ".join(item[3990:4020])), (3, " ".join(item))]
    items = [(1, " ".join(item)), (2, "y" * 5000)]
    assert len(docs[0][1]) > edge
    assert run(spark, docs, items) == brute(docs, items)


def test_hot_passage(spark):
    """One passage in a third of all documents, and a word that fills documents."""
    r = random.Random(1)
    items = [(i, " ".join(f"t{r.randrange(60)}" for _ in range(40))) for i in range(20)]
    docs = [(i, (items[0][1] if i % 3 == 0 else "and " * 50) + " " + " ".join(f"t{r.randrange(60)}" for _ in range(20))) for i in range(300)]
    assert run(spark, docs, items) == brute(docs, items)


def test_equal_hashes_are_told_apart(spark, monkeypatch, planted):
    """With hashes that tell few words apart, the comparison of the words decides."""
    docs, items = planted
    whole = dec.spelled

    def coarse(data):
        hashes, begin, end = whole(data)
        return hashes % 7, begin, end

    monkeypatch.setattr(dec, "spelled", coarse)
    pieces = [(str(i), " ".join(plain_words(t)).encode()) for i, t in items[:12]]
    index = dec._windows(pieces, 10)
    for size in dec._key_sizes(index, 3):
        window, offset, s = dec._shingles_of(index, size, 3)
        order = [i for i in range(len(s)) if i == 0 or window[i] != window[i - 1]]
        order.sort(key=lambda i: int(s[i]))
        keys, first = np.unique(s[order], return_index=True)
        index.keys[size], index.first[size], index.entry[size], index.offset[size] = keys, np.append(first, len(order)), window[order], offset[order]
    seen = {k: dec._looked_for(v) for k, v in index.keys.items()}
    for _, text in docs[5:30]:
        data = (text or "").encode().translate(dec._LOWER)
        hashes, begin, end = coarse(data)
        n = len(begin)
        start, window = dec._standing(index, seen, data, hashes, begin, end, np.zeros(n, int), np.full(n, n))
        hit = {k for s, w in zip(start, window) for k in range(s, s + index.length[w])}
        assert len(hit) == brute([(0, text)], items[:12])[0][2]


def test_no_items_no_documents_and_other_columns(spark, planted):
    docs, items = planted
    none = [(d, n, 0, 0, hashlib.sha256(b"").hexdigest(), False) for d, n, *_ in brute(docs, items)]
    assert run(spark, docs, []) == sorted(none, key=repr)
    assert run(spark, [], items) == []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for name in ("id", "mark", "spans", "items", "n_words", "item"):
        d, b = d.withColumn(name, F.lit("extra")), b.withColumn(name, F.lit("extra"))
    assert sorted((tuple(r) for r in dec.decontamination_query(d, b).collect()), key=repr) == brute(docs, items)
