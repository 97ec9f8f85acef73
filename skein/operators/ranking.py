"""Ranked text retrieval: an inverted index in blocks, and the best k documents of each question by BM25 or by the number of shared words.

A block is the index of documents of a bounded number of words, built where they lie: its words with their postings (document, occurrences), the documents' lengths, and for each word the
most occurrences and the least length, which bound what the word can add to a score. Questions are sent to the tasks in waves of a bounded size. In a block a question is passed
over if its words' bounds do not reach the k-th best score so far; else words are added from the largest bound down, and once the words left cannot lift a new document
among the best k, they are looked up for the documents found already only. So lists of frequent words are hardly read, no posting is shuffled, and each task gives k rows per question.

Document ids are integers. Null texts have no words. Scores are rounded to 6 digits; of equal ones the smaller id goes first. Repeated documents count each; a document or question without an id takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.snapshots import bounded_batches, saved, spread

K1, B = 1.2, 0.75  # of BM25
WAVE_WORDS = 1 << 20  # of the questions that are sent to the tasks together
BLOCK_WORDS = 1 << 20  # of a block: fewer would make more blocks for each question to look into
CLOSE = 1e-6  # what rounding may change


def words(text: Column) -> Column:
    """The words of a text in lower case, in all scripts: runs of letters, marks and digits; Chinese and Japanese signs stand alone."""
    apart = F.regexp_replace(F.lower(text), r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")
    return F.coalesce(F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def inverted(docs: DataFrame, id_col: str, found: Column) -> DataFrame:
    """The index of documents in blocks, one row each; `found` is a document's array of words. Of `docs` only the columns needed should be given."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            lists = batch.column("words")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            spelling, code = np.array(coded.dictionary.to_pylist(), dtype=object), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), n)
            pair, tf = np.unique(code * batch.num_rows + doc, return_counts=True)
            code, doc = np.divmod(pair, batch.num_rows)
            starts = np.searchsorted(code, np.arange(len(spelling) + 1))
            some = len(spelling) > 0
            most = np.maximum.reduceat(tf, starts[:-1]) if some else tf
            least = np.minimum.reduceat(n[doc], starts[:-1]) if some else n[:0]
            one = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int32()), pa.array([int(n.sum())], pa.int64()), one(batch.column("id").to_numpy(zero_copy_only=False), np.int64), one(n, np.int32), pa.array([spelling.tolist()], pa.list_(pa.string())), one(starts, np.int32), one(doc, np.int32), one(tf, np.int32), one(most, np.int32), one(least, np.int32)],
                names=["n", "n_words", "ids", "lengths", "words", "starts", "docs", "tf", "most", "least"],
            )

    bounded_batches(docs.sparkSession)
    rows = spread(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _listed(found).alias("words"))
    return rows.mapInArrow(build, "n int, n_words long, ids binary, lengths binary, words array<string>, starts binary, docs binary, tf binary, most binary, least binary")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches cut anew, so that each but the last is filled up to BLOCK_WORDS words, or is one longer document."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        upto = np.append(0, np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, upto[start] + BLOCK_WORDS - n, "right")) - 1
            if stop <= start and held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            n += int(upto[stop] - upto[start])
            start = stop
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of an index one by one, their values left in Arrow's memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            cells = {name: batch.column(name)[i] for name in batch.schema.names}
            yield {name: x.values if name == "words" else x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for name, x in cells.items()}


def _listed(found: Column) -> Column:
    """No words for a null, and no null among words."""
    return F.coalesce(F.array_compact(found), F.array().cast("array<string>"))


class _Block:
    """One block in a task, with the questions' words found in it."""

    def __init__(self, row: dict, asked: pa.Array):
        read = lambda c, kind=np.int32: np.frombuffer(row[c], kind)
        self.ids, self.lengths, self.starts, self.docs, self.tf, self.most, self.least = read("ids", np.int64), *(read(c) for c in ("lengths", "starts", "docs", "tf", "most", "least"))
        at = pc.index_in(asked, row["words"] if isinstance(row["words"], pa.Array) else pa.array(row["words"], pa.string()))
        self.at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)

    def postings(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[word], self.starts[word + 1])
        return self.docs[own], self.tf[own]


def _gain(tf: np.ndarray | int, length: np.ndarray | int, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best_of_block(block: _Block, question: np.ndarray, weight: np.ndarray, mean: float | None, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the documents that can be among the best k, given that k others have `least`, and how many postings were read.

    With `mean` (length), a word adds its weight times BM25's part of occurrences and length, else its weight.
    """
    none = np.empty(0, np.int64), np.empty(0), 0
    place = block.at[question]
    question, place = question[place >= 0], place[place >= 0]
    bound = weight[question] * (_gain(block.most[place], block.least[place], mean) if mean else 1.0)
    if not len(place) or bound.sum() < least - CLOSE:
        return none
    order = np.argsort(-bound, kind="stable")
    left = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
    scores = np.zeros(len(block.ids))
    seen = np.zeros(len(block.ids), bool)
    kth, read = least, 0
    for i, o in enumerate(order):
        docs, tf = block.postings(place[o])
        found = None
        if left[i] < kth - CLOSE:
            # No new document can come in: only those that can still reach the k-th are looked up.
            found = np.flatnonzero(seen & (scores + left[i] >= kth - CLOSE))
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            held = docs[at] == found
            docs, tf = found[held], tf[at[held]]
        read += len(docs)
        scores[docs] += weight[question[o]] * (_gain(tf, block.lengths[docs], mean) if mean else 1.0)
        if found is None:
            seen[docs] = True
            if left[i + 1] > 0 and np.count_nonzero(seen) >= k:
                some = scores[seen]
                kth = max(kth, float(np.partition(some, len(some) - k)[len(some) - k]))
    good = np.flatnonzero(seen & (scores >= kth - CLOSE))
    rounded = np.round(scores[good], 6)
    first = np.lexsort((block.ids[good], -rounded))[:k]
    return block.ids[good][first], rounded[first], read


def search(index: DataFrame, questions: DataFrame, k: int, id_col: str, found: Column, bm25: bool = True, wave_words: int = WAVE_WORDS) -> DataFrame:
    """id_col, doc_id, score, rank: the best k documents of each question that share a word with it. `found` is a question's array of words; each distinct one counts once."""
    spark = index.sparkSession
    asked = saved(questions.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.array_distinct(_listed(found)).alias("words")).withColumn("number", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    waves = max(1, -(-size // wave_words))
    whole = index.agg(F.sum("n").alias("n"), F.sum("n_words").alias("words")).first()
    out = spark.createDataFrame([], f"{id_col} long, doc_id long, score double, rank int")
    if not whole["n"]:
        return out
    mean = max(whole["words"] / whole["n"], 1e-9) if bm25 else None
    for wave in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("number"), F.lit(waves)) == wave).toArrow()  # of about wave_words words
        if not rows.num_rows:
            continue
        coded = rows.column("words").combine_chunks().flatten().dictionary_encode()
        edges = np.append(0, np.cumsum(pc.list_value_length(rows.column("words")).to_numpy()))
        code = coded.indices.to_numpy(zero_copy_only=False)
        per_question = [code[a:b] for a, b in zip(edges[:-1], edges[1:])]
        words, ids = coded.dictionary, rows.column("q").to_numpy()
        weight = _rarity(index, words, whole["n"]) if bm25 else np.ones(len(words))
        sent = spark.sparkContext.broadcast((words, per_question, ids, weight))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            words, per_question, ids, weight = sent.value
            best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
            for row in _blocks(batches):
                block = _Block(row, words)
                for i, question in enumerate(per_question):
                    doc, score = best[i]
                    new, new_score, _ = best_of_block(block, question, weight, mean, k, score[-1] if len(score) == k else 0.0)
                    if len(new):
                        doc, score = np.concatenate((doc, new)), np.concatenate((score, new_score))
                        first = np.lexsort((doc, -score))[:k]
                        best[i] = doc[first], score[first]
            yield pa.RecordBatch.from_pydict({"question": np.repeat(np.arange(len(ids)), [len(d) for d, _ in best]), id_col: np.repeat(ids, [len(d) for d, _ in best]), "doc_id": np.concatenate([d for d, _ in best] or [ids]), "score": np.concatenate([s for _, s in best] or [np.empty(0)])})

        held = index.mapInArrow(look, f"question long, {id_col} long, doc_id long, score double")
        order = Window.partitionBy("question").orderBy(F.desc("score"), "doc_id")
        out = out.unionByName(held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("question"))
    return out


def _rarity(index: DataFrame, words: pa.Array, n: int) -> np.ndarray:
    """The inverse document frequency of the questions' words over all blocks."""
    sent = index.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for row in _blocks(batches):
            block = _Block(row, sent.value)
            here = np.flatnonzero(block.at >= 0)
            total[here] += block.starts[block.at[here] + 1] - block.starts[block.at[here]]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": at, "df": total[at]})

    counted = index.mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()  # at most a row per word of the wave
    df = np.zeros(len(words))
    df[counted.column("word").to_numpy()] = counted.column("df").to_numpy()
    return np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df])
