"""Similarity join on word n-grams with adaptive multi-match prefixes, and the groups that its links form.

A document's set is its distinct shingles, as 64-bit hashes, in one order for all documents: by how often a shingle's bucket
occurs in the whole corpus (a counting sketch of fixed size), rare ones first. Sets of size x and y whose overlap reaches t share at
least l shingles among the first x - t + l of one and y - t + l of the other. Each document chooses its own l: a longer prefix costs index rows, but a
candidate then has to share l of its shingles, which the estimated frequencies say how many documents will; a pair must share the smaller of
its two l. Prefixes are joined by shingle, pairs counted, and whole sets compared last.

Equal sets are one node from the start. So that a large group of near copies does not bring all its pairs, links are found in
two rounds: first every node is compared with one partner, the holder of its prefix shingles that has them earliest (in a
group of edited copies, the least edited one); linked nodes are merged, and a node that did not link is compared once more, with the
centre of the other component it shares most with, which links it or tells how far it is from that component's nodes. Then the join runs over all shingles that nodes of different
components share, and only between such components, which loses no link that could join two of them.

Edge cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle
count as one shingle; very long texts are read whole; repeated rows, copies and ties share a node; rows are told apart by id and text, so rows of one
id, or of null ids, with different texts are separate; a null id names a component only if all its ids are null; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import components, mixed, perhaps, row_hash, saved, word_hashes

LEAST_BITS, MOST_BITS = 16, 22  # of the sketch's bucket numbers; it has about eight buckets a document, within these bounds
_BLOCK_BITS = 15
MOST_MATCHES = 8  # of shared prefix shingles that a document may ask for
HOT_TEXTS, LEAST_PAIRS = 1000, 256  # texts that are asked for by more pairs than others, at most; pairs of a text that one key of the join holds, at least
INDEX_COST, MEETING_COST, CANDIDATE_COST = 1.0, 1.0, 4.0  # of an index row, of a row that it meets in the join, of a candidate to verify


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]
    out = []
    for w in word_hashes([b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]):
        if len(w) >= size:
            rolled = w[: len(w) - size + 1] * factors[0]
            for k in range(1, size):
                rolled = rolled + w[k : len(w) - size + 1 + k] * factors[k]
            out.append(np.unique(mixed(rolled)))
        elif len(w):
            out.append(mixed((w * np.asarray(factors[: len(w)])).sum(keepdims=True) + np.uint64(len(w))))
        else:
            out.append(w)
    return out


def _sketch(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Documents per bucket of shingles, over all documents: 2**MOST_BITS counters at most.

    Every task sends its counters in compressed blocks; they are added in two steps whose fan-in is about the square root of the
    number of tasks each.
    """
    rows, last = docs.select(F.spark_partition_id().alias("part")).agg(F.count("part"), F.max("part")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, rows.bit_length() + 3))
    blocks = 1 << (bits - _BLOCK_BITS)
    fan = math.isqrt(last or 0) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for sets in _sets_of(batch.column(0), size):
                if sets:
                    total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if total.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "counts": [zlib.compress(b.tobytes(), 1) for b in total.reshape(blocks, -1)]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << _BLOCK_BITS, np.int64)
        for packed in frame["counts"]:
            total += np.frombuffer(zlib.decompress(packed), np.int64)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "block int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, kind).withColumn("part", F.spark_partition_id() % fan)
    some = parts.groupBy("block", "part").applyInPandas(add, kind)
    out = np.zeros((blocks, 1 << _BLOCK_BITS), np.int64)
    for row in some.groupBy("block").applyInPandas(add, kind).collect():
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def _sets_of(column: pa.Array, size: int, at_once: int = 512) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(column), at_once):
        yield shingle_sets(column.slice(i, at_once).to_pylist(), size)


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The smallest overlap with which sets of these sizes reach the similarity."""
    return F.ceil((a + b) * percent / (100 + percent))


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Per document, saved: id, holder (hash of id and text), set size, node (hash of the set, null if empty), matches it asks for, and its prefix in the corpus order."""
    spark = docs.sparkSession
    counts = _sketch(docs, text_col, size)
    load, bits = float(counts.mean()), len(counts).bit_length() - 1
    shared = spark.sparkContext.broadcast(counts)
    schema = pa.schema([("id", pa.int64()), ("holder", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64()))])
    asked = np.arange(1, MOST_MATCHES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            start = 0
            for sets in _sets_of(batch.column(1), size):
                ids, holders = batch.column(0).slice(start, len(sets)), batch.column(2).slice(start, len(sets))
                start += len(sets)
                n, nodes, matches, chosen = [], [], [], []
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        matches.append(0)
                        chosen.append(np.empty(0, np.int64))
                        continue
                    nodes.append(_node(s))
                    often = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.argsort(often, kind="stable")  # ties by hash: s is ascending
                    first = len(s) - -(-percent * len(s) // 100)
                    expected = np.cumsum(np.maximum(often[order[: first + MOST_MATCHES]] - load, 0))
                    reach = np.minimum(first + asked, len(s)) - 1
                    cost = INDEX_COST * asked + (MEETING_COST + CANDIDATE_COST / asked) * expected[reach]
                    best = min(int(cost.argmin()) + 1, len(s) - first)  # no link can share more than the least overlap for sure
                    matches.append(best)
                    chosen.append(s[order[: first + best]].view(np.int64))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in chosen]))), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, holders, pa.array(n, pa.int32()), pa.array(nodes, pa.int64()), pa.array(matches, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(chosen), pa.int64()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col), row_hash(id_col, text_col).alias("holder"))
    out = saved(rows.mapInArrow(run, "id long, holder long, n int, node long, matches int, prefix array<long>"))
    shared.destroy()
    return out


def _node(s: np.ndarray) -> int | None:
    """Hash of a whole set; none for the empty set."""
    if not len(s):
        return None
    return int(mixed(np.array([s.sum() ^ np.uint64(len(s)) ^ np.bitwise_xor.reduce(mixed(s))]))[0].astype(np.int64))


def _hot_texts(named: DataFrame) -> DataFrame:
    """Holders that more than an even share of the pairs ask for (centres of large groups), with the number of copies that are dealt out of their text; at most 2 * HOT_TEXTS rows."""
    share = max(LEAST_PAIRS, named.count() // HOT_TEXTS)
    asks = named.select(F.explode(F.array("holder_a", "holder_b")).alias("holder")).groupBy("holder").agg(F.count(F.lit(1)).alias("asks"))
    return saved(asks.where(F.col("asks") > share).select("holder", F.ceil(F.col("asks") / share).cast("int").alias("copies")))


def _dealt(named: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs with the copy (salt_a, salt_b) of either text that they are joined with: copy 0 but of hot texts."""
    for n, other in ("a", "b"), ("b", "a"):
        copies = F.broadcast(hot.select(F.col("holder").alias(f"holder_{n}"), "copies"))
        named = named.join(copies, f"holder_{n}", "left").withColumn(f"salt_{n}", F.pmod(F.xxhash64(f"holder_{other}"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    return named


def _verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes by their whole sets: whether they link, and their distance (1 - similarity); texts, which are smaller than their sets, go to the pairs."""
    held = lambda n: holders.select(F.col("node").alias(n), F.col("holder").alias(f"holder_{n}"))
    named = saved(pairs.join(held("a"), "a").join(held("b"), "b"))
    hot = _hot_texts(named)
    # Texts that nobody asks for are kept out of the shuffle; those that very many pairs ask for go to several keys.
    candidates = docs.select(row_hash(id_col, text_col).alias("holder"), F.col(text_col).alias("said")).where("said is not null")
    asked = perhaps(candidates, F.col("holder"), named.select(F.explode(F.array("holder_a", "holder_b")).alias("holder"))).where("_perhaps")
    copied = asked.join(F.broadcast(hot), "holder", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    texts = copied.groupBy("holder", "salt").agg(F.first("said").alias("said"))

    @F.pandas_udf("known boolean, link boolean, distance double")
    def compared(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for k in range(0, len(a), 256):
            part = slice(k, k + 256)
            for node_a, node_b, s, t in zip(a[part], b[part], shingle_sets(x[part].tolist(), size), shingle_sets(y[part].tolist(), size)):
                shared = len(np.intersect1d(s, t, assume_unique=True))
                union = len(s) + len(t) - shared
                out.append((_node(s) == node_a and _node(t) == node_b, 100 * shared >= percent * union, 1 - shared / max(union, 1)))
        return pd.DataFrame(out, columns=["known", "link", "distance"])

    side = lambda n: texts.select(F.col("holder").alias(f"holder_{n}"), F.col("salt").alias(f"salt_{n}"), F.col("said").alias(f"said_{n}"))
    both = _dealt(named, hot).join(side("a"), ["holder_a", "salt_a"]).join(side("b"), ["holder_b", "salt_b"])
    seen = both.select("a", "b", compared("a", "b", "said_a", "said_b").alias("c"))
    return seen.where("c.known").select("a", "b", "c.link", "c.distance").distinct()


def _common_items(nodes: DataFrame, percent: int) -> DataFrame:
    """Saved rows of the index, one per node and prefix shingle that another node's prefix holds too: its place, how many such ones go before it, and the node that has the shingle earliest."""
    index = saved(nodes.select("node", "n", "matches", F.posexplode("prefix").alias("at", "item")))
    held = index.groupBy("item").agg(F.count(F.lit(1)).alias("holders"), F.min_by("node", "at").alias("first"), F.min_by("n", "at").alias("first_n"), F.min("at").alias("first_at")).where("holders > 1").drop("holders")
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    # `rank` is how many held ones go before it, so it is at most the (rank + 1)-th common one; the k-th has t - k others behind it.
    # The at - rank others before it are in no overlap with a node that has it in its prefix, as that prefix would hold them too. Of those
    # behind it nothing is known: a partner may have them beyond its own prefix.
    rank = F.row_number().over(Window.partitionBy("node").orderBy("at")) - 1
    return saved(index.join(held, "item").withColumn("rank", rank).where(F.col("at") - F.col("rank") <= spare))


def _first_partners(common: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Saved: (node, first, k), how many shingles a node shares with each node that has some of them earliest; and per node the one with most, as (node, pivot, a, b)."""
    overlap = _least_overlap(F.col("n"), F.col("first_n"), percent)
    hopeful = (F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * percent) & (F.col("at") <= F.col("n") - overlap) & (F.col("first_at") <= F.col("first_n") - overlap)
    tally = saved(common.where("node <> first").where(hopeful).groupBy("node", "first").agg(F.count(F.lit(1)).alias("k")))
    return tally, saved(tally.groupBy("node").agg(F.max_by("first", "k").alias("pivot")).select("node", "pivot", F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")))


def _second_partners(tally: DataFrame, compared: DataFrame, merged: DataFrame) -> DataFrame:
    """Saved (node, pivot, a, b) for nodes that did not link: the centre (what most of its nodes have linked with) of the other component they share most with."""
    centres = compared.where("link").join(merged, "node").groupBy("component", "pivot").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.max_by("pivot", "k").alias("centre"))
    part_of = lambda n: merged.select(F.col("node").alias(n), F.col("component").alias(f"{n}_component"))
    apart = tally.join(compared.where("not link").select("node", "pivot"), "node").join(part_of("node"), "node", "left").join(part_of("first"), "first", "left")
    shared = apart.withColumn("component", F.coalesce("first_component", "first")).where(F.col("component") != F.coalesce("node_component", "node")).groupBy("node", "pivot", "component").agg(F.sum("k").alias("k"))
    others = shared.join(centres, "component", "left").withColumn("centre", F.coalesce("centre", "component")).where("centre <> pivot").groupBy("node").agg(F.max_by("centre", "k").alias("pivot"))
    return saved(others.select("node", "pivot", F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")))


def _placed(chosen: DataFrame, compared: DataFrame) -> DataFrame:
    """Saved (node, pivot, distance): how far a node is from the one it was compared with first. The distance is a metric: two nodes that were compared with the same one link only if their distances to it are alike."""
    pivots = chosen.select(F.col("pivot").alias("node")).distinct()
    own = pivots.select("node", F.col("node").alias("pivot"), F.lit(0.0).alias("distance"))
    return saved(own.unionByName(compared.select("node", "pivot", "distance").join(pivots, "node", "left_anti")))


def _pairs_between(common: DataFrame, merged: DataFrame, placed: DataFrame, placed_again: DataFrame, percent: int) -> DataFrame:
    """Saved pairs (a, b) of nodes in different components that share as many shingles as they ask for, and that no bound tells apart."""
    rows = common.drop("first", "first_n", "first_at").join(merged, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component").join(placed, "node", "left").join(placed_again, "node", "left")
    mixed_items = rows.groupBy("item").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("item")
    rows = saved(rows.join(mixed_items, "item"))
    kinds = saved(rows.groupBy("item", "part").agg(F.count(F.lit(1)).alias("held"), F.max(F.col("n") - F.col("at") + F.col("rank")).alias("room"), F.min("n").alias("n"), F.min("matches").alias("matches"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.when((F.min("pivot") == F.max("pivot")) & (F.count("pivot") == F.count(F.lit(1))), F.min("pivot")).alias("pivot")))
    kind = lambda part: kinds.select("item", F.col("part").alias(part), *[F.col(c).alias(f"{part}_{c}") for c in ("held", "room", "n", "matches", "lo", "hi", "pivot")])
    possible = F.least("p_room", "q_room") >= _least_overlap(F.col("p_n"), F.col("q_n"), percent)
    # p is the component with fewer nodes at the shingle: its rows are joined first.
    fewer = (F.col("p_held") < F.col("q_held")) | ((F.col("p_held") == F.col("q_held")) & (F.col("p") < F.col("q")))
    meets = saved(kind("p").join(kind("q"), "item").where(fewer).where(possible).withColumn("one", F.least("p", "q")).withColumn("other", F.greatest("p", "q")))
    # Two components need as many common shingles as the least that any two of their nodes ask for.
    enough = meets.groupBy("one", "other").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("p_matches", "q_matches")).alias("asked")).where("k >= asked").select("one", "other")
    meets = meets.select("item", "p", "q", "q_room", "q_n", "q_lo", "q_hi", "q_pivot", "one", "other").join(enough, ["one", "other"]).drop("one", "other")
    side = lambda s, part: rows.select("item", F.col("part").alias(part), *[F.col(c).alias(s + c) for c in ("node", "n", "matches", "at", "rank", "pivot", "distance", "other_pivot", "other_distance")])
    asked, rank = F.least("x_matches", "y_matches"), F.least("x_rank", "y_rank")
    reach = 1 - percent / 100 + 1e-9
    overlap = _least_overlap(F.col("x_n"), F.col("y_n"), percent)
    alike = lambda x, y: F.coalesce((F.col(f"{x}pivot") != F.col(f"{y}pivot")) | (F.abs(F.col(f"{x}distance") - F.col(f"{y}distance")) <= reach), F.lit(True))
    near = (
        (F.col("x_n") * 100 >= F.col("y_n") * percent) & (F.col("y_n") * 100 >= F.col("x_n") * percent)
        & (F.col("x_at") <= F.col("x_n") - overlap + asked - 1) & (F.col("y_at") <= F.col("y_n") - overlap + asked - 1)
        & (F.col("x_at") - rank <= F.col("x_n") - overlap) & (F.col("y_at") - rank <= F.col("y_n") - overlap)
        & alike("x_", "y_") & alike("x_other_", "y_") & alike("x_", "y_other_") & alike("x_other_", "y_other_")
    )
    most = _least_overlap(F.col("x_n"), F.col("q_n"), percent)
    fits = (
        (F.col("q_room") >= most) & (F.col("x_at") <= F.col("x_n") - most + F.col("x_matches") - 1) & (F.col("x_at") - F.col("x_rank") <= F.col("x_n") - most)
        & F.coalesce((F.col("x_pivot") != F.col("q_pivot")) | ((F.col("x_distance") >= F.col("q_lo") - reach) & (F.col("x_distance") <= F.col("q_hi") + reach)), F.lit(True))
    )
    met = meets.join(side("x_", "p"), ["item", "p"]).where(fits).join(side("y_", "q"), ["item", "q"]).where(near)
    # Which of two components is p may change from shingle to shingle, so a pair of nodes is counted in one order.
    return saved(met.groupBy(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(asked).alias("asked")).where("k >= asked").select("a", "b"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of `docs`: id, holder (its row_hash), n (set size) and part, which the rows of a component have in common (null for empty sets)."""
    docs = docs.select(id_col, text_col)
    members = prefixes(docs, id_col, text_col, size, percent)
    nodes = members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("matches").alias("matches"), F.first("prefix").alias("prefix"))
    holders = members.where("n > 0").groupBy("node").agg(F.min("holder").alias("holder"))
    common = _common_items(nodes, percent)
    verified = lambda pairs: _verified(pairs, docs, holders, id_col, text_col, size, percent)
    joined = lambda merged, links: saved(components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.where("link").select("a", "b"))))

    # Round 1: each node with the one that holds most of its shingles earliest; nodes that did not link once more, with the centre of another component.
    tally, chosen = _first_partners(common, percent)
    measured = saved(verified(chosen.select("a", "b").distinct()))
    merged = saved(components(measured.where("link").select("a", "b")))
    compared = chosen.join(measured, ["a", "b"])
    again = _second_partners(tally, compared, merged)
    measured_again = saved(verified(again.select("a", "b").distinct()))
    merged = joined(merged, measured_again)
    placed_again = again.join(measured_again, ["a", "b"]).select("node", F.col("pivot").alias("other_pivot"), F.col("distance").alias("other_distance"))

    # Round 2: shingles that several components share, between different components alone.
    pairs = _pairs_between(common, merged, _placed(chosen, compared), placed_again, percent)
    groups = joined(merged, verified(pairs))

    return members.select("id", "holder", "n", "node").join(groups, "node", "left").select("id", "holder", "n", F.coalesce("component", "node").alias("part"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of `docs`: id, n_shingles (set size) and component_id (smallest id reachable by links, its own if there are none)."""
    grouped = near_rows(docs, id_col, text_col, size, percent)
    least = grouped.where("part is not null").groupBy("part").agg(F.min("id").alias("least"))
    return grouped.join(least, "part", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def jaccard_query(docs: DataFrame) -> DataFrame:
    return near_groups(docs, size=4, percent=85)
