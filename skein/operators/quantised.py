"""Approximate cosine search over product-quantised residuals: a few bytes per row are scanned, a short list is scored exactly.

A unit vector is its nearest coarse centre and a residual; the residual's sub-vectors are each replaced by the number of the nearest entry of that part's codebook. Centres and codebooks are learned
by k-means on a sample of at most about SAMPLE_ROWS rows; every row is encoded. For a question, the products with the centres and all codebook entries are tables, and a row's score is a
sum of look-ups. The best rows by that sum are scored exactly from their vectors. How long the short list must be for a wanted recall is measured on the
sample and grows with the rows. Questions are sent to the tasks in waves of a bounded size; a task makes the short lists of its own rows, scores them at once and keeps k rows of a question, so
no vector and no short list is shuffled, and a task's memory does not grow with the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import vectors as v
from skein.sources.snapshots import bounded_batches, saved, spread

SAMPLE_ROWS = 8_000
SUBSPACES = 16
ENTRIES = 256  # of a codebook, so that a number is a byte
SLAB_ROWS = 8192  # that are encoded together
LOOK_ROWS = 1 << 16  # that are looked through together
WAVE_BYTES = 8 << 20


class Codebooks(NamedTuple):
    centres: np.ndarray
    edges: np.ndarray  # first component of each part, and the end
    books: list[np.ndarray]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centre, and of the nearest entry for each part of the residual."""
        centre = _nearest(x, self.centres)
        rest = x - self.centres[centre]
        codes = [_nearest(rest[:, a:b], book) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books)]
        return centre.astype(np.uint16), np.stack(codes).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A question's product with every centre, and with every entry of each part."""
        own = np.zeros((len(self.books), ENTRIES))
        for j, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books)):
            own[j, : len(book)] = book @ q[a:b]
        return self.centres @ q, own


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points * points).sum(axis=1)[None] - 2 * x @ points.T).argmin(axis=1)


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    points = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(x, points)
        count = np.bincount(of, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, of, x)
        points = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], points)
    return points


def learned(sample: np.ndarray, lists: int = 16, subspaces: int = SUBSPACES) -> Codebooks:
    """Coarse centres and the codebooks of residuals."""
    centres = _means(sample, min(lists, len(sample)))
    rest = sample - centres[_nearest(sample, centres)]
    edges = np.unique(np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int))
    return Codebooks(centres, edges, [_means(rest[:, a:b], min(ENTRIES, len(rest))) for a, b in zip(edges[:-1], edges[1:])])


def looked_up(tables: tuple[np.ndarray, np.ndarray], centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The estimated score of every row."""
    out = tables[0][centre]
    for own, code in zip(tables[1], codes):
        out = out + own[code]
    return out


def short_list(books: Codebooks, sample: np.ndarray, rows: int, k: int, recall: float, questions: int = 200) -> int:
    """How many rows must be scored exactly to find this share of a question's k nearest, as for rows of the sample among each other.

    Entries learned from few rows fit those better than others, so with a sample of fewer than twice ENTRIES rows the list is twice as long.
    """
    if len(sample) <= k + 1:
        return rows
    centre, codes = books.encoded(sample)
    places = []
    for i, q in enumerate(sample[:questions]):
        exact, estimate = sample @ q, looked_up(books.tables(q), centre, codes)
        exact[i] = estimate[i] = -np.inf
        place = np.argsort(np.argsort(-estimate, kind="stable"), kind="stable")
        places.append(place[np.argpartition(-exact, k)[:k]])
    needed = np.sort(np.concatenate(places)) + 1
    at = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]
    return min(rows, int(np.ceil(at * max(1.0, rows / len(sample)))) * (2 if len(sample) < 2 * ENTRIES else 1))


def _likeliest(rows: DataFrame, books: Codebooks, asked: tuple[np.ndarray, np.ndarray], size: int, k: int, digits: int) -> DataFrame:
    """query_id, chunk_id, score: of each task the k best of unit vectors (id, v), where they lie, for every question; of each LOOK_ROWS rows the `size` likeliest are scored exactly.

    So whatever is among a question's `size` likeliest rows of all is scored, and nothing is held for a question but its k best.
    """
    sent = rows.sparkSession.sparkContext.broadcast((books, asked))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (asked_ids, q) = sent.value
        best = v.Best(asked_ids, k, digits)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def score() -> None:
            ids, x = (np.concatenate(c) for c in zip(*held))
            coded = [books.encoded(x[at : at + SLAB_ROWS]) for at in range(0, len(x), SLAB_ROWS)]
            centre, codes = np.concatenate([c for c, _ in coded]), np.concatenate([c for _, c in coded], axis=1)
            for i, one in enumerate(q):
                found, own = ids, x
                if len(ids) > size:
                    likely = np.argpartition(-looked_up(books.tables(one), centre, codes), size - 1)[:size]
                    found, own = ids[likely], x[likely]
                best.add_one(i, own @ one, found)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("id").to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)))
            if sum(len(ids) for ids, _ in held) >= LOOK_ROWS:
                score()
        if held:
            score()
        yield best.batch()

    return rows.mapInArrow(look, "query_id long, chunk_id long, score double")


def quantised_top_k(rows: DataFrame, questions: DataFrame, k: int, recall: float = 0.95, id_col: str = "vec_id", size: int | None = None, digits: int = 6, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, chunk_id, score, pos: nearest rows by cosine for each question, its own row left out; scores are exact, and about `recall` of the true k nearest are found.

    `size`, the length of the short list, is measured if it is not given. Null vectors take no part; all others have one length. With fewer rows than k all are returned.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    empty = spark.createDataFrame([], "query_id long, chunk_id long, score double, pos int")
    unit = lambda df: v.normalized(df.select(F.col(id_col).cast("long").alias("id"), "v").where("v is not null and id is not null"))
    known, asked = unit(rows), saved(unit(questions).dropDuplicates(["id"]))
    n = known.count()
    facts = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not n or not facts["n"]:
        return empty
    sample = v.centroids(known, 1, SAMPLE_ROWS, 0, "id")[1]
    books = learned(sample)
    size = max(k, size or short_list(books, sample, n, k, recall))
    lying = spread(known)
    waves = max(1, -(-facts["n"] * facts["d"] * 8 // wave_bytes))
    hits = empty.drop("pos")
    for wave in range(waves):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).select("id", "v").toArrow()  # of about wave_bytes
        if own.num_rows:
            q = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            hits = hits.unionByName(_likeliest(lying, books, (own.column("id").to_numpy(), q), size, k, digits))
    return v.ranked(hits, k)
