"""Context-triggered piecewise hashing: fingerprints of texts, and their likeness by edit distance.

A rolling hash over the last seven bytes closes a chunk wherever its low bits are all set, so boundaries depend on
nearby content alone and come back after an insertion. Each chunk gives one of 64 characters. The block size (the mean chunk
length) is the power of two that gives a text of its length about 48 chunks; it doubles while the signature is too long. Runs of one
character count as three. A
fingerprint is `block:signature:signature at twice the block`. Two fingerprints are compared at equal block sizes, or where one
is twice the other, by the edit distance of insertions and deletions, 1 - d / (length + length); signatures without a
common run of characters are unlike (0), so that chance matches of single characters don't count.

Edge cases: null is the empty text, whose fingerprint is `1::`; two empty texts are alike (1), an empty and another are not (0);
equal texts have equal fingerprints and likeness 1; documents with equal ids (ties) are ordered by a hash of the text, repeated
rows follow each other; an id that is null comes first; a lone document's next document is itself; very long texts are used whole; an empty table gives an
empty result. Extra columns are ignored by the query; :func:`add_fingerprints` and :func:`compare` keep them, but one of the result's name gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import mixed, shuffle_width

WINDOW = 7
LONGEST = 96
SAMPLED_PER_RANGE = 40  # rows of the sample that balances the ranges; it decides no result
COMMON_RUN = 4
_RUN = re.compile(r"(.)\1{3,}")
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _ODD, np.uint64))
_WEIGHTS = [np.uint32(pow(0x01000193, k + 1, 1 << 32)) for k in range(WINDOW)]


def _rolling(buf: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each position."""
    wide = buf.astype(np.uint32) + np.uint32(1)
    h = wide * _WEIGHTS[0]
    for k in range(1, WINDOW):
        h[k:] += wide[:-k] * _WEIGHTS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def _signature(buf: np.ndarray, ends: np.ndarray) -> bytes:
    """One letter per chunk; `ends` are the positions just after each boundary."""
    starts = np.concatenate(([0], ends))
    if len(ends) and ends[-1] == len(buf):
        starts = starts[:-1]
    length = np.diff(np.append(starts, len(buf)))
    at = np.arange(len(buf), dtype=np.int64) - np.repeat(starts, length)
    value = (buf.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 4095]
    if len(buf) > 4096:
        value *= (at >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return _LETTERS[(mixed(np.add.reduceat(value, starts)) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(raw: bytes) -> str:
    if not raw:
        return "1::"
    buf = np.frombuffer(raw, np.uint8)
    rolled = _rolling(buf)
    bits = max(0, (len(raw) // 48).bit_length())

    def signature(b: int) -> str:
        full = np.uint32((1 << b) - 1)
        return _RUN.sub(r"\1\1\1", _signature(buf, np.flatnonzero(rolled & full == full) + 1).decode())

    fine = signature(bits)
    while len(fine) > LONGEST and bits < 30:
        bits += 1
        fine = signature(bits)
    return f"{1 << bits}:{fine}:{signature(bits + 1)}"


def _common_run(a: str, b: str, size: int) -> bool:
    return size <= 0 or not {a[i : i + size] for i in range(len(a) - size + 1)}.isdisjoint(b[i : i + size] for i in range(len(b) - size + 1))


def _alike(a: str, b: str) -> float:
    """1 - d / (len + len), d the fewest insertions and deletions; by the bit-parallel longest common subsequence."""
    if a == b:
        return 1.0
    if not a or not b or not _common_run(a, b, min(COMMON_RUN, len(a), len(b))):
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 0 where their block sizes are not compatible."""
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    if x == y:
        return 1.0
    size_a, size_b = int(a), int(b)
    if size_a == size_b:
        return max(_alike(a1, b1), _alike(a2, b2))
    if size_a == 2 * size_b:
        return _alike(a1, b2)
    if size_b == 2 * size_a:
        return _alike(a2, b1)
    return 0.0


def add_fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add each whole text's fingerprint; other columns stay."""
    @F.pandas_udf("string")
    def printed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fingerprint((t or "").encode("utf-8", "replace")))

    return docs.withColumn(into, printed(text_col))


def compare(pairs: DataFrame, left: str, right: str, into: str = "likeness") -> DataFrame:
    """Add the likeness of two fingerprint columns; null where one is null."""
    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn(into, compared(left, right))


def edited_against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, and its edited text, whose last quarter is replaced by the start of the next document.

    Documents are dealt to ranges in the order of (id, hash of the text), so that rows of one id may lie in many ranges. A bounded sample of that
    order gives the ranges, a pass over ids and hashes their first rows (a table of ranges, not of documents); the first document of a
    range is sent to the range before as well, so each task sees whole neighbours in order and texts are shuffled once.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_width(spark)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(F.col(id_col), F.col(text_col).alias("text"), order.alias("_key"), F.xxhash64(text_col).alias("_hash"))
    part = min(1.0, SAMPLED_PER_RANGE * ranges / max(1, docs.count()))
    drawn = sorted(tuple(r) for r in keyed.where(F.pmod(F.xxhash64("_key", "_hash", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).select("_key", "_hash").limit(4 * SAMPLED_PER_RANGE * ranges).collect())
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if len(drawn) > ranges else []
    cut = _bounds_reached(bounds)
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in keyed.select("_key", "_hash", cut.alias("_range")).groupBy("_range").agg(F.min(F.struct("_key", "_hash"))).collect())
    previous, first = [-1] * (len(bounds) + 1), [(0, 0)] * (len(bounds) + 1)
    for i, (r, k, h) in enumerate(firsts):
        previous[r], first[r] = firsts[i - 1][0], (k, h)
    begins = (F.col("_key") == F.get(F.lit([k for k, _ in first]).cast("array<long>"), F.col("_range"))) & (F.col("_hash") == F.get(F.lit([h for _, h in first]).cast("array<long>"), F.col("_range")))
    dealt = keyed.withColumn("_range", cut).withColumn("_before", F.when(begins, F.get(F.lit(previous).cast("array<int>"), F.col("_range"))))
    own = F.struct(F.col("_range").alias("to"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_before").alias("to"), F.lit(1).alias("guest"))
    copies = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))
    placed = dealt.select(id_col, "text", "_key", "_hash", F.explode(copies).alias("_c")).select(id_col, "text", "_key", "_hash", "_c.to", "_c.guest")
    sorted_rows = placed.repartition(shuffle_width(spark), "to").sortWithinPartitions("to", "guest", "_key", "_hash", F.col("text").asc_nulls_first())
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        waiting = None  # (range, id, text, fingerprint): a document whose next one hasn't come yet
        for batch in batches:
            for to, doc, text, is_guest in zip(*(batch.column(k).to_pylist() for k in ("to", id_col, "text", "guest"))):
                text = text or ""
                known = fingerprint(text.encode("utf-8", "replace"))
                if waiting is not None and waiting[0] == to:
                    rows.append(_edited(*waiting[1:], text, known))
                waiting = None if is_guest else (to, doc, text, known)
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_rows.select("to", id_col, "text", "guest").mapInArrow(run, kind)


def _bounds_reached(bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are at or below (_key, _hash), by bisection."""
    if not bounds:
        return F.lit(0)
    keys, hashes = F.lit([k for k, _ in bounds]).cast("array<long>"), F.lit([h for _, h in bounds]).cast("array<long>")
    reached = lambda i: (F.col("_key") > F.get(keys, i)) | ((F.col("_key") == F.get(keys, i)) & (F.col("_hash") >= F.get(hashes, i)))
    steps = F.lit([1 << b for b in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(bounds)) & reached(n + step - 1), n + step).otherwise(n))


def _edited(doc: int, text: str, known: str, following: str, next_known: str) -> tuple:
    n = len(text)
    edited = (text[: n - n // 4] + following[: n // 4]).encode("utf-8", "replace")
    print_edited = fingerprint(edited)
    return doc, n, hashlib.sha256(edited).hexdigest(), known, print_edited, likeness(known, print_edited), likeness(known, next_known)
