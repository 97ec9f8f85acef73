"""Exact top-k search by inner product, with a pivot table that eliminates candidates.

Components become integers floor(1024 * x). Adding one coordinate, sqrt(M - |x|^2) with M the largest squared length, gives all
rows equal length and turns the largest inner product into the least distance: d(q, x)^2 = |q|^2 + M - 2 <q, x>. Distances from every row to the
pivots are computed once; by the triangle inequality |d(q, p) - d(x, p)| bounds d(q, x) from below, and the largest bound over all pivots
bounds the score from above. For each query, candidates are evaluated in the order of their bounds until the next bound
falls below the k-th best score; scores of a bounded sample give a first k-th score. Bounds have a margin for rounding and scores are
integers, so the result is exact, ties included.

Rows are gathered into slabs where they lie and are not shuffled. The stated query set is sent to the tasks in waves of a bounded size; a task keeps k rows
for each query of the wave, which raises the k-th score for its next slab, and the tasks' rows are merged by rank.

Edge cases: vectors that are null, of another length than most, or hold null or non-finite components take no part; an id that
is null takes no part; equal scores are ordered by the smaller id; repeated rows of one id are separate candidates, except the
query's own id; with fewer candidates than k all are returned; an empty table gives an empty result; texts play no part, and extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import saved

SLAB_ROWS = 8192
BLOCK_ROWS = 1024  # queries that are scored against the sample together
WAVE_BYTES = 32 << 20  # of query vectors that are sent together
PIVOTS = 32
SAMPLE_ROWS = 2048
STEP = 256  # candidates evaluated together
SCALE = 1024


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """Id and integer components of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dimension) & finite)
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Consecutive rows of each partition as (n, ids, components) in binary, at most `size` rows each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        held = 0

        def out(upto: int) -> pa.RecordBatch:
            nonlocal ids, vectors, held
            i, v = np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [i[upto:]], [v[upto:]], held - upto
            return pa.RecordBatch.from_pydict({"n": pa.array([upto], pa.int32()), "ids": [i[:upto].tobytes()], "vectors": [v[:upto].tobytes()]})

        for batch in batches:
            i = batch.column("id").to_numpy(zero_copy_only=False)
            if not len(i):
                continue
            ids.append(i)
            vectors.append(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1))
            held += len(i)
            while held >= size:
                yield out(size)
        if held:
            yield out(held)

    return rows.mapInArrow(pack, "n int, ids binary, vectors binary")


def farthest_first(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots far from each other, from a sample of (lengthened) vectors."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)):
        far = int(gap.argmax())
        if gap[far] <= 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, ((sample - sample[far]) ** 2).sum(axis=1))
    return sample[chosen]


def _lengthened(v: np.ndarray, most: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _kept(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Wave:
    """Queries of a wave with their k best rows so far; `least` is the score that a row must reach."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, pivots: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int):
        self.queries, self.ids, self.pivots, self.k = queries, ids, pivots, k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        self.square = np.empty(len(ids))
        self.to_pivots = np.empty((len(ids), len(pivots)))
        for at in range(0, len(ids), BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            q = np.hstack((queries[part].astype(np.float64), np.zeros((len(queries[part]), 1))))
            self.square[part], self.to_pivots[part] = (q * q).sum(axis=1), _distances(q, pivots)
            if len(sample) >= k:
                first = queries[part] @ sample.T
                first[ids[part][:, None] == sample_ids[None]] = np.iinfo(np.int64).min
                self.least[part] = np.partition(first, -k, axis=1)[:, -k]

    def search(self, rows: np.ndarray, row_ids: np.ndarray, most: float) -> None:
        """Take the slab's rows that are among the k best of a query, in the order of their bounds."""
        table = np.ascontiguousarray(_distances(_lengthened(rows, most), self.pivots).T)
        for n in range(len(self.ids)):
            bound = np.zeros(len(rows))
            for p, distance in enumerate(table):
                np.maximum(bound, np.abs(distance - self.to_pivots[n, p]), out=bound)
            upper = (self.square[n] + most - bound * bound) / 2
            upper += 1e-6 * (self.square[n] + most) + 1
            order = np.flatnonzero((upper >= self.least[n]) & (row_ids != self.ids[n]))
            order = order[np.argsort(-upper[order], kind="stable")]
            (best, best_ids), at = self.found[n], 0
            while at < len(order) and upper[order[at]] >= self.least[n]:
                some = order[at : at + STEP]
                at += STEP
                scores = rows[some] @ self.queries[n]
                good = scores >= self.least[n]
                best, best_ids = _kept(np.concatenate((best, scores[good])), np.concatenate((best_ids, row_ids[some][good])), self.k)
                if len(best) == self.k:
                    self.least[n] = max(self.least[n], best[-1])
            self.found[n] = best, best_ids

    def result(self) -> pa.RecordBatch:
        counts = [len(ids) for _, ids in self.found]
        return pa.RecordBatch.from_pydict({"query": np.repeat(np.arange(len(counts)), counts), "query_id": np.repeat(self.ids, counts), "vec_id": np.concatenate([i for _, i in self.found]), "score": np.concatenate([s for s, _ in self.found])})


def _search_wave(slabs: DataFrame, rows: pa.Table, dimension: int, fixed: tuple, most: float, k: int) -> DataFrame:
    """Saved query_id, rank, vec_id, score for one wave of queries; repeated rows of one query id are separate queries."""
    sent = slabs.sparkSession.sparkContext.broadcast((rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimension), rows.column("id").to_numpy(), *fixed))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = None
        for batch in batches:
            for row in batch.to_pylist():
                wave = wave or Wave(*sent.value, k)
                wave.search(np.frombuffer(row["vectors"], np.int64).reshape(row["n"], dimension), np.frombuffer(row["ids"], np.int64), most)
        if wave:
            yield wave.result()

    found = slabs.mapInArrow(search, "query long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    best = saved(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    sent.destroy()
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, id, score: the k rows of `vectors` with the largest integer inner product, for every row of `queries`."""
    spark = vectors.sparkSession
    kind = "query_id long, rank int, vec_id long, score long"
    common = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or common["d"] <= 0:
        return spark.createDataFrame([], kind)
    rows, asked = quantised(vectors, id_col, vector_col, common["d"]), quantised(queries, id_col, vector_col, common["d"])
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most")).first()
    if not facts["n"]:
        return spark.createDataFrame([], kind)
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / facts["n"]) * (1 << 30)) + 1
    drawn = rows.where(draw).orderBy("id").limit(2 * SAMPLE_ROWS).toArrow()
    if not drawn.num_rows:
        drawn = rows.orderBy("id").limit(1).toArrow()
    sample_ids = drawn.column("id").to_numpy()
    sample = drawn.column("v").combine_chunks().flatten().to_numpy().reshape(len(sample_ids), -1)
    most = float(facts["most"])
    pivots = farthest_first(_lengthened(sample, most), PIVOTS)
    # repeated ids in the sample would count one candidate twice
    _, single = np.unique(sample_ids, return_index=True)
    fixed = pivots, sample[single], sample_ids[single]  # at most 2 * SAMPLE_ROWS vectors

    dimension = common["d"]
    slabs = saved(_packed(rows, SLAB_ROWS))
    asked = saved(asked.withColumn("number", F.monotonically_increasing_id()))
    waves = -(-asked.count() * dimension * 8 // wave_bytes)
    out = spark.createDataFrame([], kind)
    for number in range(waves):
        wave = asked.where(F.pmod(F.xxhash64("number"), F.lit(waves)) == number).select("id", "v").toArrow()  # of about wave_bytes
        if wave.num_rows:
            out = out.unionByName(_search_wave(slabs, wave, dimension, fixed, most, k))
    return out


def topk_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings.select("vec_id", "embedding"), embeddings.where(F.col("vec_id") % 100 == 0).select("vec_id", "embedding"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
