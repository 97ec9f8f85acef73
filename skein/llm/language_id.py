"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the windows of 2, 3 and 4 bytes of its lower-cased words (word edges included). Each window
is hashed to a row of an embedding table; the rows are averaged over the whole text and a linear layer with softmax
gives a probability for each learned language. Table and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows. Because the layer is linear, the average of embeddings followed by the layer
equals the average of per-window scores; scoring uses that table (buckets x languages).

One more class of the softmax, learned from rows whose letters are put in random order, stands for no language; it never is a prediction. What
the other classes have of the probability is the chance that a text is in a language at all, and rejection goes by that chance.

Calibration, on sampled rows that the fit does not see: a temperature for the softmax over the languages, and the rejection level, the chance
(at most MOST_LEVEL) that all but `ALPHA` of the rightly labelled rows reach. The model keeps what the level does: its coverage (share of
those rows that pass) and its false acceptance (share of shuffled rows that pass).

Edge cases: a text that is null, empty or without a letter is `und` with score 0 and rejected; very long texts are scored whole, in
blocks; rows without labels are scored but not learned; repeated rows and ties are scored alike (of equal probabilities the language first in
alphabetical order); a row with a null id is not held out; with no labelled row, or an empty table, every text is `und`. More than MOST_LANGUAGES labels
are an error. :func:`identify` keeps all columns of the input, but those named lang_pred, score or rejected give way to its results.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import beside, bucket_of, rows_with

BUCKETS = 1 << 16
DIMENSIONS = 16
TRAINING_ROWS = 2400  # bound on the labelled rows that reach the driver, shared evenly among the languages
TRAINING_BYTES = 128 << 20  # bound on the hashed counts that reach the driver: fewer rows of a language are drawn where they are long, texts are never cut
EXCERPTS = (60, 15)  # every sampled text is also learned as one excerpt of each of these lengths, so that short texts are known
SHUFFLED = (60, 240)  # lengths of the excerpts whose letters are put in random order, taken in turn
EPOCHS = 5
ALPHA = 0.0005
MOST_LANGUAGES = 200  # bound on the labels that the driver gets; more of them are an error
MOST_LEVEL = 0.4  # the rejection level is never above this, so that short clean texts stay
ENTRY_BYTES = 6  # of a bucket and its count
_BLOCK = 1 << 20

# Bytes that are no part of a word (ASCII other than letters) become blanks.
_TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _grams(buf: np.ndarray):
    """Start offsets and buckets of the 2-, 3- and 4-byte windows without a blank inside."""
    blank = buf == 32
    wide = buf.astype(np.uint32)
    n = len(buf)
    hashed, inner = wide, None
    for size in (2, 3, 4):
        if n < size:
            return
        hashed = (hashed[: n - size + 1] << np.uint32(8)) | wide[size - 1 :]
        if size == 2:
            keep = ~(blank[:-1] & blank[1:])
        else:
            inner = blank[1 : n - size + 2] if inner is None else inner[: n - size + 1] | blank[size - 2 : n - 1]
            keep = ~inner
        at = np.flatnonzero(keep)
        yield at, ((hashed[at] * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(16)).astype(np.int32)


def _blocks(texts: list[bytes]):
    """Blank-padded documents in blocks of about a megabyte: (document numbers, their starts, bytes)."""
    group, starts, at = [], [], 0
    part: list[bytes] = []
    for i, text in enumerate(texts):
        for begin in range(0, max(len(text), 1), _BLOCK):
            piece = b" " + text[begin : begin + _BLOCK] + b" "
            if part and at + len(piece) > _BLOCK:
                yield group, np.asarray(starts), np.frombuffer(b"".join(part), np.uint8)
                group, starts, at, part = [], [], 0, []
            group.append(i)
            starts.append(at)
            part.append(piece)
            at += len(piece)
    if part:
        yield group, np.asarray(starts), np.frombuffer(b"".join(part), np.uint8)


def _normalised(text: str | None) -> bytes:
    return b"" if text is None else text.lower().encode("utf-8", "replace").translate(_TO_BLANK)


@dataclass
class LanguageModel:
    languages: list[str]
    window_scores: np.ndarray  # (BUCKETS, languages and then no language): embedding rows times the layer
    bias: np.ndarray
    temperature: float
    least: float  # rejection level
    coverage: float = 1.0  # of rightly labelled rows that calibration has seen
    false_acceptance: float = 1.0  # of shuffled rows

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """One column for each column of window_scores."""
        k = len(self.bias)
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
        for owners, starts, buf in _blocks([_normalised(t) for t in texts]):
            for at, buckets in _grams(buf):
                edges = np.searchsorted(at, starts)
                ends = np.append(edges[1:], len(at))
                rows = np.asarray(owners)
                np.add.at(counts, rows, ends - edges)
                for c in range(k):
                    running = np.concatenate(([0.0], np.cumsum(self.window_scores[buckets, c], dtype=np.float64)))
                    np.add.at(sums[:, c], rows, running[ends] - running[edges])
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def of_languages(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits[:, : len(self.languages)] / self.temperature)

    def of_any(self, logits: np.ndarray) -> np.ndarray:
        """The chance that a text is in a language at all."""
        return _softmax(logits)[:, : len(self.languages)].sum(axis=1)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return self.of_languages(self.logits(texts))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(text: pd.Series, at: pd.Series) -> pd.Series:
    """Buckets and counts of each whole text, of its excerpts, and of one more excerpt with its letters in random order."""

    def counted(t: str) -> dict:
        raw = _normalised(t)
        found = np.concatenate([b for _, b in _grams(np.frombuffer(b" " + raw + b" ", np.uint8))] or [np.empty(0, np.int32)])
        bucket, n = np.unique(found, return_counts=True)
        return {"size": len(bucket), "packed": zlib.compress(bucket.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes(), 1)}

    def shuffled(t: str, seed: int) -> str:
        return "".join(np.random.default_rng(seed).permutation(list(t))) if t else ""

    def excerpt(t: str, o: int, size: int) -> str:
        return t[o % max(1, len(t) - size) :][:size]

    def variants(t: str, o: int) -> list[dict]:
        known = [t, *(excerpt(t, o, size) for size in EXCERPTS)]
        return [counted(x) for x in [*known, shuffled(excerpt(t, o, SHUFFLED[o % len(SHUFFLED)]), int(o))]]

    return pd.Series([variants(t, o) for t, o in zip(text, at)])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS, seed: int = 7) -> LanguageModel:
    """Learn from about `rows` rows, drawn by hash, with a text and a language; a quarter of them serve calibration only."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    entries = F.least(F.octet_length(text_col).cast("long") * 3, F.lit(BUCKETS))  # at most
    sizes = usable.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"), F.sum(entries * ENTRY_BYTES).alias("bytes"))
    counts = {r[0]: (r["n"], r["bytes"]) for r in sizes.orderBy(F.desc("n"), lang_col).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang_col}: some could not be learned")
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 1.0)
    share: Column = F.lit(0.0)
    each = max(1, rows // len(languages))
    for lang, (n, size) in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, each / n, TRAINING_BYTES / len(languages) / size)).otherwise(share)
    hashed = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    draw = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    features = F.pandas_udf(_features, "array<struct<size:int,packed:binary>>")
    sample = usable.where(draw < share).select(
        F.col(lang_col).alias("lang"), (F.pmod(F.xxhash64(id_col, text_col, F.lit(seed + 1)), F.lit(4)) == 0).alias("aside"),
        features(text_col, F.pmod(F.shiftright(hashed, 31), F.lit(1 << 20))).alias("f"),
    ).limit(2 * rows).toArrow()
    data, nobody = _unpacked(sample, {lang: i for i, lang in enumerate(languages)})
    del sample
    pa.default_memory_pool().release_unused()
    table, layer, bias = _descend([x for x in data + nobody if not x[3]], len(languages) + 1, seed)
    scores = (table @ layer).astype(np.float32)
    model = LanguageModel(languages, scores, bias, 1.0, 0.0)
    aside = [x for x in data if x[3]]
    if aside:
        logits = lambda found: np.array([n @ scores[b] / n.sum() + bias for b, n, _, _ in found]).reshape(-1, len(bias))
        _calibrate(model, logits(aside), np.array([x[2] for x in aside]), logits([x for x in nobody if x[3]]))
    return model


def _unpacked(sample: pa.Table, known: dict[str, int]) -> tuple[list, list]:
    """(bucket, count, label, aside) of the sampled texts and excerpts, as arrays of their own; and of the shuffled ones, whose label is one more than the last."""
    data, nobody, last = [], [], 1 + len(EXCERPTS)
    for batch in sample.to_batches():
        found = batch.column("f").flatten()
        sizes, packed = found.field(0).to_pylist(), found.field(1)
        for i, (lang, aside) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("aside").to_pylist())):
            for j in range(last + 1):
                at = (last + 1) * i + j
                if sizes[at]:
                    raw = zlib.decompress(packed[at].as_buffer())
                    bucket, n = np.frombuffer(raw, np.uint16, sizes[at]), np.frombuffer(raw, np.uint32, offset=2 * sizes[at])
                    (data if j < last else nobody).append((bucket, n, known[lang] if j < last else len(known), aside))
    for found in (data, nobody):  # the order in which tasks end must not matter
        found.sort(key=lambda x: (x[2], len(x[0]), x[0].tobytes()))
    return data, nobody


def _descend(data: list, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent, one document a step; the rate falls linearly to zero."""
    random = np.random.default_rng(seed)
    table = random.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    steps, done = EPOCHS * max(1, len(data)), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(data)):
            bucket, n, label, _ = data[i]
            weight = n / n.sum()
            rate = 4.0 * (1 - done / steps)
            done += 1
            hidden = weight @ table[bucket]
            gap = _softmax((hidden @ layer + bias)[None])[0]
            gap[label] -= 1
            back = layer @ gap
            layer -= rate * np.outer(hidden, gap)
            bias -= 0.01 * rate * gap
            table[bucket] -= rate * np.outer(weight, back)
    return table, layer, bias


def _calibrate(model: LanguageModel, logits: np.ndarray, labels: np.ndarray, nobody: np.ndarray) -> None:
    """Set temperature and rejection level from rows with labels, and measure the level on them and on rows of no language."""
    rows = np.arange(len(labels))
    temperatures = np.geomspace(0.05, 8, 60)
    alone = logits[:, : len(model.languages)]
    model.temperature = float(min(temperatures, key=lambda t: -np.log(_softmax(alone / t)[rows, labels] + 1e-12).mean()))
    right = model.of_any(logits)[alone.argmax(axis=1) == labels]
    if len(right):
        model.least = float(min(np.quantile(right, ALPHA), MOST_LEVEL))
        model.coverage = float((right >= model.least).mean())
    if len(nobody):
        model.false_acceptance = float((model.of_any(nobody) >= model.least).mean())


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to each row."""
    if not model.languages:
        return rows_with(beside(docs), docs.columns, lang_pred=F.lit("und"), score=F.lit(0.0), rejected=F.lit(True))

    @F.pandas_udf("lang_pred string, score double, any_language double")
    def predict(text: pd.Series) -> pd.DataFrame:
        logits = model.logits(text.tolist())
        p = model.of_languages(logits)
        return pd.DataFrame({"lang_pred": np.asarray(model.languages, object)[p.argmax(axis=1)], "score": p.max(axis=1), "any_language": model.of_any(logits)})

    text = F.col(f"`{text_col}`")
    scored = beside(docs, _p=predict(text), _l=F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return rows_with(
        scored, docs.columns, lang_pred=F.when(F.col("_l"), F.col("_p.lang_pred")).otherwise("und"), score=F.when(F.col("_l"), F.col("_p.score")).otherwise(0.0),
        rejected=~F.col("_l") | (F.col("_p.any_language") < model.least),
    )


def language_query(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))  # a null id has no checksum
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
