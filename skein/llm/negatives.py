"""Hard-negative mining by inner product, with summaries of vector segments that filter candidates.

Components become integers floor(SCALE * x). A vector is cut into segments; of each, the mean and the deviation are stored. With m components in a
segment, a's and x's inner product over it is m * (mean_a * mean_x) plus what is at most m * deviation_a * deviation_x on either side, so sums over
the segments bound a score from below and above. One segment, then 4, then 16 (as far as the dimension goes) give tighter bounds; pairs that
a level rules out are not looked at on the next, and pairs that all levels leave are scored exactly in integers.

Rows are packed into slabs with their summaries once and stay where they lie. Anchors are taken in waves of a bounded size; a wave is sent to all tasks and each
task goes over its slabs, keeping the best rows of each anchor so far, which raises the bound for the slabs that follow. A first pass finds the positives of
the wave, a second the negatives of every pair of anchor and positive, whose scores must lie in a band given by the positive's score.

Edge cases: a null id, label or vector, a vector of another length than most, or one with a null or non-finite component takes no part. Rows with the anchor's
id are no candidates for it. Repeated rows are candidates each; repeated anchors bring their rows each. Ties are ordered by the smaller id. An anchor without positives, or a
pair without negatives in its band, has no rows; a band of negative scores is empty. An empty table gives an empty result. Columns beside the three are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import saved

SCALE = 256
SLAB_ROWS = 8192
WAVE_BYTES = 8 << 20  # of the components of the anchors that are sent to tasks together
LEVELS = (1, 4, 16)  # segments; a number that does not divide the dimension leaves a shorter last segment
FIRST = 64  # pairs scored at once to have a bound to begin with


def quantised(vectors: DataFrame, id_col: str, label: Column, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """id, label and integer components v of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) == dimension) & finite)
    return usable.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def edges(dimension: int, segments: int) -> np.ndarray:
    """First components of the segments."""
    width = -(-dimension // segments)
    return np.arange(0, dimension, width)


def levels(dimension: int) -> list[int]:
    return [n for i, n in enumerate(LEVELS) if i == 0 or n < dimension]


def summaries(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each row's segments, both times the root of the segment's length, so that products add up to scores."""
    first = edges(v.shape[1], segments)
    length = np.diff(np.append(first, v.shape[1])).astype(np.float64)
    x = v.astype(np.float64)
    mean = np.add.reduceat(x, first, axis=1) / length
    apart = x - np.repeat(mean, length.astype(int), axis=1)
    return mean * np.sqrt(length), np.sqrt(np.add.reduceat(apart * apart, first, axis=1))


def packed(rows: DataFrame, dimension: int) -> DataFrame:
    """Consecutive rows of each partition as slabs: n, ids, labels, components and the summaries of every level, in binary."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def slab() -> pa.RecordBatch:
            nonlocal held, n
            ids, labels, v = (np.concatenate(x) for x in zip(*held))
            now, rest = slice(0, SLAB_ROWS), slice(SLAB_ROWS, None)
            held, n = ([(ids[rest], labels[rest], v[rest])] if len(ids) > SLAB_ROWS else []), max(0, n - SLAB_ROWS)
            ids, labels, v = ids[now], labels[now], v[now]
            marks = b"".join(x.astype(np.float32).tobytes() for level in levels(dimension) for x in summaries(v, level))
            return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "labels": [labels.tobytes()], "v": [v.tobytes()], "marks": [marks]})

        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((batch.column("id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False), v))
                n += batch.num_rows
                while n >= SLAB_ROWS:
                    yield slab()
        if n:
            yield slab()

    return rows.mapInArrow(pack, "n int, ids binary, labels binary, v binary, marks binary")


class Slab:
    """One slab in a task."""

    def __init__(self, row: dict, dimension: int):
        n = row["n"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.v = np.frombuffer(row["v"], np.int64).reshape(n, dimension)
        self.marks: list[tuple[np.ndarray, np.ndarray]] = []
        flat, at = np.frombuffer(row["marks"], np.float32), 0
        for level in levels(dimension):
            width = len(edges(dimension, level))
            both = flat[at : at + 2 * n * width].reshape(2, n, width)
            self.marks.append((both[0], both[1]))
            at += 2 * n * width

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.v[rows] @ anchor


def bounds(anchor: tuple[np.ndarray, np.ndarray], mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each row's score; the margin covers the rounding of the summaries to 32 bits."""
    middle = mean @ anchor[0].astype(np.float32)
    spread = deviation @ anchor[1].astype(np.float32)
    reach = np.abs(mean) @ np.abs(anchor[0]).astype(np.float32) + spread
    margin = reach * np.float32(1e-5) + 1
    return middle - spread - margin, middle + spread + margin


def survivors(slab: Slab, anchor: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, low: float, high: float, taken: list[int] | None = None) -> np.ndarray:
    """The rows whose score can lie from low to high, level by level."""
    for level, (mean, deviation) in enumerate(slab.marks):
        if not len(rows):
            break
        under, over = bounds(anchor[level], mean[rows], deviation[rows])
        rows = rows[~((over < low) | (under > high))]
        if taken is not None:
            taken[level] += len(rows)
    return rows


class Best:
    """The k best (score, id) so far, higher scores and then smaller ids first."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def _likeliest(slab: Slab, anchor: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """FIRST rows with the largest products of means on the last level."""
    if len(rows) <= FIRST:
        return rows
    middle = slab.marks[-1][0][rows] @ anchor[-1][0].astype(np.float32)
    return rows[np.argpartition(-middle, FIRST)[:FIRST]]


def positives_of_slab(slab: Slab, at: int, wave: dict, best: Best) -> None:
    """Put the slab's best rows of anchor `at`'s label into `best`."""
    rows = np.flatnonzero((slab.labels == wave["labels"][at]) & (slab.ids != wave["ids"][at]))
    if not len(rows):
        return
    anchor, v = [(m[at], d[at]) for m, d in wave["marks"]], wave["v"][at]
    low = best.least()
    if low == -np.inf:
        first = Best(best.k)
        some = _likeliest(slab, anchor, rows)
        first.add(slab.scores(some, v), slab.ids[some])
        low = first.least()
    rows = survivors(slab, anchor, rows, low, np.inf)
    best.add(slab.scores(rows, v), slab.ids[rows])


def negatives_of_slab(slab: Slab, at: int, wave: dict, pairs: list[tuple[int, int, Best]]) -> None:
    """Put the slab's best rows of other labels into each (low, high, best) of anchor `at`."""
    rows = np.flatnonzero((slab.labels != wave["labels"][at]) & (slab.ids != wave["ids"][at]))
    if not len(rows):
        return
    anchor, v = [(m[at], d[at]) for m, d in wave["marks"]], wave["v"][at]
    highest = max(high for _, high, _ in pairs)
    some = _likeliest(slab, anchor, rows)
    known, known_ids = slab.scores(some, v), slab.ids[some]
    lows = []
    for low, high, best in pairs:
        inside = (known >= low) & (known <= high)
        first = Best(best.k)
        first.add(known[inside], known_ids[inside])
        lows.append(max(low, best.least(), first.least()))
    rows = survivors(slab, anchor, rows, min(lows), highest)
    scores, ids = slab.scores(rows, v), slab.ids[rows]
    for (low, high, best), least in zip(pairs, lows):
        inside = (scores >= least) & (scores <= high)
        best.add(scores[inside], ids[inside])


def _wave(rows: pa.Table, dimension: int) -> dict:
    v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dimension)
    return {"ids": rows.column("id").to_numpy(), "labels": rows.column("label").to_numpy(), "v": v, "marks": [summaries(v, level) for level in levels(dimension)]}


def _positives(slabs: DataFrame, wave: dict, dimension: int, k: int) -> DataFrame:
    """anchor (its number in the wave), id, score: the best rows of every task."""
    sent = slabs.sparkSession.sparkContext.broadcast(wave)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        best = [Best(k) for _ in wave["ids"]]
        for batch in batches:
            for row in batch.to_pylist():
                slab = Slab(row, dimension)
                for at, b in enumerate(best):
                    positives_of_slab(slab, at, wave, b)
        yield pa.RecordBatch.from_pydict({"anchor": np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), "id": np.concatenate([b.ids for b in best]), "score": np.concatenate([b.scores for b in best])})

    return slabs.mapInArrow(search, "anchor long, id long, score long")


def _negatives(slabs: DataFrame, wave: dict, dimension: int, k: int, percent: tuple[int, int]) -> DataFrame:
    """pair (its place among the wave's positives), id, score: the best rows of every task."""
    sent = slabs.sparkSession.sparkContext.broadcast(wave)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        of: dict[int, list[tuple[int, int, Best]]] = {}
        every = []
        for at, score in zip(wave["pair_anchor"].tolist(), wave["pair_score"].tolist()):
            low, high = -(-percent[0] * score // 100), percent[1] * score // 100
            every.append(Best(k))
            if low <= high:
                of.setdefault(at, []).append((low, high, every[-1]))
        for batch in batches:
            for row in batch.to_pylist():
                slab = Slab(row, dimension)
                for at, pairs in of.items():
                    negatives_of_slab(slab, at, wave, pairs)
        if every:
            yield pa.RecordBatch.from_pydict({"pair": np.repeat(np.arange(len(every)), [len(b.ids) for b in every]), "id": np.concatenate([b.ids for b in every]), "score": np.concatenate([b.scores for b in every])})

    return slabs.mapInArrow(search, "pair long, id long, score long")


def _first(rows: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), scale: int = SCALE, wave_bytes: int = WAVE_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: for each anchor and positive, the first rows of other labels from percent[0] to percent[1] of the positive's score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    common = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or common["d"] <= 0:
        return empty
    dimension = common["d"]
    slabs = saved(packed(quantised(vectors, id_col, label, vector_col, dimension, scale), dimension))
    asked = saved(quantised(vectors.where(anchors), id_col, label, vector_col, dimension, scale).withColumn("number", F.monotonically_increasing_id()))
    n = asked.count()
    waves = -(-n * dimension * 8 // wave_bytes)
    parts = []
    for number in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(waves)) == number).toArrow()  # of about wave_bytes
        if not rows.num_rows:
            continue
        wave = _wave(rows, dimension)
        found = _first(_positives(slabs, wave, dimension, positives), "anchor", positives).select("anchor", "id", "score").toArrow()  # `positives` rows for each of the wave's anchors
        anchor, id_, score = (found.column(c).to_numpy() for c in ("anchor", "id", "score"))
        if not len(anchor):
            continue
        best = _first(_negatives(slabs, wave | {"pair_anchor": anchor, "pair_score": score}, dimension, negatives, percent), "pair", negatives)
        pairs = pa.table({"pair": np.arange(len(anchor)), "anchor_id": wave["ids"][anchor], "positive_id": id_, "positive_score": score})
        named = best.join(F.broadcast(spark.createDataFrame(pairs)), "pair")
        parts.append(saved(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def negatives_query(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", "embedding", "label"), F.col("vec_id") % 50 == 0, label)


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""
