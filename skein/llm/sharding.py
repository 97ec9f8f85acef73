"""Shards balanced jointly in bytes, tokens and rows, by vector bin packing over groups of equal texts.

Rows with equal texts form a group and go to one shard together. Groups are gathered by a hash of their text into a fixed
number of lots, so that what is packed does not grow with the input; a group heavier than a lot may be is packed on its own, and
one heavier than HEAVIEST of a shard is cut by a hash of its ids into pieces of about PIECE of a shard (rows stay whole). Each lot is a
vector (bytes, tokens, rows) in shares of the total; from the largest on, it is placed in the shard where the dot product of
its vector with the shard's residual capacity is highest, among the shards with bytes to spare. The law kept is `bytes`: sizes are near equal.

Edge cases: a null text counts no bytes and no tokens and is a group of its own; very long texts count whole; repeated rows are separate rows of their
group; of lots of equal weight the one with the smaller key is placed first, and of shards that tie the first is taken; fewer rows than shards leave
shards empty; an empty table gives an empty result; extra columns don't matter, whatever their names: the result has its own. A null id is a row like any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import numbered, saved
from skein.llm.packing import token_count

SHARDS = 24
LOTS_PER_SHARD = 128  # lots of ordinary groups, for each shard; the driver packs at most about four times as many items
HEAVIEST = 0.9  # of a shard: heavier groups are cut, as no shard could hold them
PIECE = 1 / 8  # of a shard: the pieces they are cut into
ROW_BYTES = 8
WEIGHTS = np.array([1.0, 0.3, 0.3])  # of bytes, tokens and rows in the dot product


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, size, checksum, tokens and the key of its group of equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        token_count(text).alias("tokens"),
        F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("group_key"),
    )


def pack(lots: list[tuple[float, float, float]], shards: int = SHARDS) -> np.ndarray:
    """Shard of each lot, given its (bytes, tokens, rows)."""
    if not lots:
        return np.empty(0, np.int64)
    share = np.asarray(lots, float)
    share = share / np.maximum(share.sum(axis=0), 1e-12)
    residual = np.full((shards, share.shape[1]), 1 / shards)
    out = np.zeros(len(lots), np.int64)
    for i in sorted(range(len(lots)), key=lambda i: (-share[i, 0], i)):
        fit = residual[:, 0] >= share[i, 0]
        score = (residual * WEIGHTS) @ share[i]
        if fit.any():
            score = np.where(fit, score, -np.inf)
        else:
            score = residual[:, 0]
        best = int(score.argmax())
        out[i] = best
        residual[best] -= share[i]
    return out


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add the shard to rows with size, tokens and group_key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    lots = shards * LOTS_PER_SHARD
    lot_limit, piece = max(1, total // (2 * lots)), max(1.0, total * PIECE / shards)
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("_bytes"))
    # At most 2 * lots groups can be that heavy.
    heavy = groups.where(F.col("_bytes") > lot_limit).select("group_key", F.when(F.col("_bytes") > total * HEAVIEST / shards, F.ceil(F.col("_bytes") / piece)).otherwise(1).cast("long").alias("_pieces"))
    marked = rows.join(F.broadcast(heavy), "group_key", "left")
    lot = F.when(F.col("_pieces").isNull(), F.struct(F.pmod("group_key", F.lit(lots)).alias("key"), F.lit(-1).cast("long").alias("piece"))).otherwise(
        F.struct(F.col("group_key").alias("key"), F.when(F.col("_pieces") == 1, 0).otherwise(F.pmod(F.xxhash64("doc_id", F.col("size"), F.lit(3)), F.col("_pieces"))).cast("long").alias("piece"))
    )
    dealt = marked.withColumn("_lot", lot).drop("_pieces")
    items = dealt.groupBy("_lot").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).collect()  # bounded: lots, heavy groups and their pieces
    items.sort(key=lambda r: (r[0]["key"], r[0]["piece"]))
    placed = pack([(r[1], r[2], r[3]) for r in items], shards)
    table = rows.sparkSession.createDataFrame([(r[0]["key"], r[0]["piece"], int(s)) for r, s in zip(items, placed)], "key long, piece long, shard int")
    return dealt.join(F.broadcast(table), (F.col("_lot.key") == table.key) & (F.col("_lot.piece") == table.piece)).drop("_lot", "key", "piece")


def sharding_query(docs: DataFrame) -> DataFrame:
    rows = saved(measured(docs))
    out = numbered(assign(rows), "shard", ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
