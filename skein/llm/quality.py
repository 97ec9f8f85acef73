"""Quality scores by a factorisation machine.

A document's features are its hashed words (relative frequencies), binned statistics of its structure (letter case,
symbols, digits, word and line lengths, repetition of words and lines) and binned metadata (its recorded length).
The machine scores a linear part and all pairwise interactions through low-rank factors; with the sum-of-squares
identity, sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i x_i v_i|^2 - sum_i x_i^2 |v_i|^2) / 2, the time is linear in the number
of features. It is learned on the driver by adaptive stochastic gradient descent from a bounded sample of labelled
rows; scoring runs in the tasks over every whole text.

Edge cases: null and empty texts have the bins of empty structure and are scored; very long texts are read whole; labels that are
null or neither 0 nor 1 are not learned; with no usable label every score is near 0.5; repeated rows and ties get equal scores; a row with a
null id has no label and is not held out; an empty table gives an empty result. :func:`score_documents` keeps all columns of the input, but
those named score or predicted give way to its results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import beside, bucket_of, rows_with, word_hashes

WORD_BUCKETS = 1 << 15
RANK = 8
TRAINING_ROWS = 4000  # bound on the labelled rows that reach the driver
EPOCHS = 6
THRESHOLD = 0.3

# Upper bin edges of each statistic; a value's bin is the number of edges at or below it.
_EDGES = {
    "log_bytes": [4, 6, 7, 8, 9, 10, 11, 12, 13, 14],
    "log_recorded_chars": [4, 6, 7, 8, 9, 10, 11, 12, 13, 14],
    "upper": [0.001, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6],
    "digit": [0.001, 0.005, 0.02, 0.05, 0.1, 0.3],
    "symbol": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "stop": [0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1],
    "non_ascii": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2],
    "blank": [0.05, 0.1, 0.14, 0.18, 0.22, 0.3],
    "word_bytes": [2, 3, 4, 5, 6, 7, 8, 12],
    "distinct_words": [0.05, 0.1, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 0.97],
    "top_word": [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.25, 0.5],
    "distinct_lines": [0.1, 0.3, 0.5, 0.7, 0.9, 0.99],
    "line_bytes": [8, 20, 40, 60, 80, 120, 200, 500],
    "words": [1, 3, 6, 12, 25, 50, 100, 250, 1000],
    "same_as_last": [0.001, 0.01, 0.03, 0.1, 0.3],
}
_STATISTICS = {name: np.asarray(edges, float) for name, edges in _EDGES.items()}
_STARTS = np.cumsum([WORD_BUCKETS, *[len(e) + 1 for e in _EDGES.values()]])
FEATURES = int(_STARTS[-1])

_CLASSES = np.zeros((256, 6))
for _c in range(256):
    _x = chr(_c)
    _CLASSES[_c] = [_x.isupper() and _c < 128, _x.isdigit() and _c < 128, 32 < _c < 127 and not _x.isalnum() and _x not in ".,", _x in ".,", _c >= 128, _c in b" \t\n\v\f\r"]


def features(texts: list[str | None], recorded: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each document."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    out = []
    for text, h, chars in zip(raw, word_hashes(raw), recorded):
        kinds, counts = np.unique(h, return_counts=True)
        n, size = len(h), len(text)
        mix = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / max(size, 1)
        lines = text.split(b"\n")
        values = (
            np.log2(size + 1), np.log2((chars if chars is not None and chars == chars else 0) + 1), *mix[:5], mix[5], size / max(n, 1) - 1,
            len(kinds) / max(n, 1), counts.max() / n if n else 0, len(set(lines)) / len(lines), size / len(lines), n,
            (h[1:] == h[:-1]).mean() if n > 1 else 0,
        )
        bins = [start + int(np.searchsorted(edges, v, side="right")) for start, edges, v in zip(_STARTS, _STATISTICS.values(), values)]
        x = np.concatenate((counts / max(float(np.sqrt((counts * counts).sum())), 1e-9), np.full(len(bins), len(bins) ** -0.5)))
        out.append((np.concatenate(((kinds >> np.uint64(49)).astype(np.int32), np.asarray(bins, np.int32))), x.astype(np.float32)))
    return out


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    squares: np.ndarray  # of each feature's factors, summed

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of documents by their features, all gathered at once."""
        at, x = np.concatenate([a for a, _ in found]), np.concatenate([x for _, x in found])[:, None]
        starts = np.concatenate(([0], np.cumsum([len(a) for a, _ in found])[:-1]))
        flat = np.hstack((x * self.factors[at], x * self.weight[at, None], x * x * self.squares[at, None]))
        summed = np.add.reduceat(flat, starts, axis=0)
        together = summed[:, : self.factors.shape[1]]
        z = self.bias + summed[:, -2] + 0.5 * ((together * together).sum(axis=1) - summed[:, -1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def _features(text: pd.Series, chars: pd.Series) -> pd.DataFrame:
    found = features(text.tolist(), chars.tolist())
    return pd.DataFrame({"at": [a.astype(np.uint16).tobytes() for a, _ in found], "x": [x.tobytes() for _, x in found]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str = "n_chars", rows: int = TRAINING_ROWS, seed: int = 11) -> FactorisationMachine:
    """Learn from at most `rows` labelled documents, drawn by a hash of their id."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("_y"))
    share = min(1.0, rows / max(1, usable.count()))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < share
    read = F.pandas_udf(_features, "at binary, x binary")
    sample = docs.where(draw).select(id_col, text_col, chars_col).join(usable.where(draw), id_col)
    got = sample.select(F.col("_y").cast("int"), read(text_col, F.col(chars_col).cast("double")).alias("f")).limit(2 * rows).toArrow()
    data = []
    for batch in got.to_batches():  # views of the Arrow buffers, not copies
        at, x = batch.column("f").field(0), batch.column("f").field(1)
        data += [(y, np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(v.as_buffer(), np.float32)) for y, a, v in zip(batch.column("_y").to_pylist(), at, x)]
    data.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the order in which tasks end must not matter
    return _descend(data, seed)


def _descend(data: list, seed: int) -> FactorisationMachine:
    random = np.random.default_rng(seed)
    weight, factors = np.zeros(FEATURES), random.normal(0, 0.05, (FEATURES, RANK))
    seen_w, seen_v, bias = np.full(FEATURES, 1e-2), np.full(FEATURES, 1e-1), 0.0
    for _ in range(EPOCHS):
        for i in random.permutation(len(data)):
            y, at, x = data[i]
            v = factors[at]
            together = x @ v
            z = bias + x @ weight[at] + 0.5 * (together @ together - ((x[:, None] * v) ** 2).sum())
            gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            bias -= 0.02 * gap
            step = gap * x
            seen_w[at] += step * step
            weight[at] -= 0.1 * step / np.sqrt(seen_w[at])
            pull = step[:, None] * (together - x[:, None] * v) + 1e-5 * v
            seen_v[at] += (pull * pull).sum(axis=1)
            factors[at] -= 0.05 * pull / np.sqrt(seen_v[at])[:, None]
    factors = factors.astype(np.float32)
    return FactorisationMachine(bias, weight.astype(np.float32), factors, (factors**2).sum(axis=1))


def score_documents(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Add score (0 to 1) and predicted (1 if the score reaches THRESHOLD) to each row."""

    @F.pandas_udf("double")
    def scored(text: pd.Series, chars: pd.Series) -> pd.Series:
        out = [np.empty(0)]
        for k in range(0, len(text), 256):
            out.append(model.scores(features(text[k : k + 256].tolist(), chars[k : k + 256].tolist())))
        return pd.Series(np.concatenate(out))

    rows = beside(docs, _score=scored(F.col(f"`{text_col}`"), F.col(f"`{chars_col}`").cast("double")))
    return rows_with(rows, docs.columns, score=F.col("_score"), predicted=(F.col("_score") >= THRESHOLD).cast("int"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))  # a null id has no checksum
    model = fit(docs, labels.where(~held_out))
    return score_documents(docs.select("doc_id", held_out.alias("held_out"), "text", "n_chars"), model).select("doc_id", "held_out", "score", "predicted")
