"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 1 << 20  # bytes of text that the vectorised scanners look at together


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. Texts vary from a word to many pages, so Arrow batches are bounded in rows and bytes."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, and of the jobs it starts later, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: lineage is cut, lost executors cost nothing.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, **needed: Column) -> DataFrame:
    """Each input row as one struct `_row` beside the columns that an operator needs, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in needed.items()])


def rows_with(df: DataFrame, names: list[str], **results: Column) -> DataFrame:
    """The columns `names` of `_row`, and results; a result takes the place of an input column of its name."""
    return df.select(*[F.col(f"_row.`{c}`") for c in names if c not in results], *[c.alias(name) for name, c in results.items()])


LEAST_FILTER_BITS, MOST_FILTER_BITS = 23, 30  # of the positions in a bitmap of wanted keys: one to 128 megabytes


def filter_bits(keys: int) -> int:
    """So many that a bitmap of `keys` keys has eight to sixteen positions a key, within the bounds."""
    return min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, keys.bit_length() + 3))


def perhaps(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Add `_perhaps`: false for rows whose key (a hash) is surely not in the one column of `wanted`.

    The keys are folded into a bitmap that is sized by their count, so that about one row in nine or fewer is let through in vain. It never has more than
    2**MOST_FILTER_BITS positions, which bounds what is broadcast; above some 130 million keys more rows are let through in vain, and results stay exact.
    """
    bits = filter_bits(wanted.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)) + 1
    at = wanted.select(place(F.col(wanted.columns[0])).alias("at")).distinct()
    maps = saved(at.groupBy(F.expr("bitmap_bucket_number(at)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("_bits")))
    byte = F.expr("cast(conv(hex(substring(_bits, bitmap_bit_position(_at) div 8 + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(bitmap_bit_position(_at) % 8 as int)")
    joined = df.withColumn("_at", place(key)).withColumn("_bucket", F.expr("bitmap_bucket_number(_at)")).join(F.broadcast(maps), "_bucket", "left")
    return joined.withColumn("_perhaps", F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))).drop("_at", "_bucket", "_bits")


def row_hash(id_col: str, text_col: str) -> Column:
    """A hash of id and text, which names a row."""
    return F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(id_col).isNull())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def numbered(df: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in many tasks per group.

    A group is cut into slices by a hash of the order columns; a small table of slice sizes (groups x slices
    rows) gives each slice its first number, and rows are numbered inside their slice.
    """
    slices = max(8, shuffle_width(df.sparkSession))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order)
    ranked = cut.withColumn("_in", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, [group, "_slice"])
    return joined.withColumn(into, (F.col("_start") + F.col("_in")).cast("long")).drop("_slice", "_start", "_in")


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
_BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(docs: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Join documents into pieces of about PIECE bytes, each with its documents' numbers and starts; long ones are cut at separators."""
    parts: list[bytes] = []
    owners: list[int] = []
    starts: list[int] = []
    at = 0
    for i, doc in enumerate(docs):
        begin = 0
        while begin < len(doc) or begin == 0:
            end = len(doc)
            if end - begin > PIECE:
                end = begin + PIECE
                while end < len(doc) and not _SEPARATOR[doc[end]]:
                    end += 1
            part = doc[begin:end]
            if at and at + len(part) > PIECE:
                yield b"\n".join(parts), owners, starts
                parts, owners, starts, at = [], [], [], 0
            parts.append(part)
            owners.append(i)
            starts.append(at)
            at += len(part) + 1
            begin = max(end, begin + 1)
    if parts:
        yield b"\n".join(parts), owners, starts


def words(docs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document number, word hash, word length) of each run of bytes without ASCII white space, piece by piece."""
    for piece, owners, starts in _spans(docs):
        buf = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~_SEPARATOR[buf]
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(begin):
            continue
        length = end - begin
        where = np.arange(len(buf), dtype=np.int64)[inside[1:-1].astype(bool)]
        firsts = np.concatenate(([0], np.cumsum(length)[:-1]))
        in_word = np.arange(len(where)) - np.repeat(firsts, length)
        value = _BYTES[buf[where]] * _POWERS[in_word & 1023]
        if int(length.max()) > 1024:
            late = np.flatnonzero(in_word >> 10)
            value[late] = mixed(value[late] + (in_word[late] >> 10).astype(np.uint64))
        hashes = mixed(np.add.reduceat(value, firsts) + length.astype(np.uint64))
        owner = np.asarray(owners)[np.searchsorted(np.asarray(starts), begin, side="right") - 1]
        yield owner, hashes, length


def word_hashes(docs: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each document, in order."""
    parts: list[list[np.ndarray]] = [[] for _ in docs]
    for owner, h, _ in words(docs):
        edges = np.flatnonzero(np.diff(owner)) + 1
        for who, part in zip(owner[np.concatenate(([0], edges))], np.split(h, edges)):
            parts[who].append(part)
    none = np.empty(0, np.uint64)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else none for p in parts]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of an undirected edge list (a, b); the component is its smallest node.

    Alternating stars: every node's larger neighbours are tied to its least neighbour, then its smaller ones, until nothing
    changes. Each round is a grouping and a join by node, kept in the shared folder; edges never reach the driver.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = saved(small.select("e.a", "e.b").where("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
