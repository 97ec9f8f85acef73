"""Benchmark decontamination: where windows of benchmark items stand in documents, by a prefix-filtered set join.

A window is WINDOW consecutive words of an item, or the whole of an item with fewer. Its shingles are ordered by rarity, counted over all
documents. Containment must be whole, so the necessary prefix of a window is its one rarest shingle: a document without that shingle cannot hold
the window. Documents are looked up by these shingles alone; the place of the shingle in window and document gives the only place where the
window can stand, which must lie inside the document (positional and length bound); then the words of the item-sized window are compared,
by hash and at last byte by byte.

Items are cut into pieces of at most PIECE_WORDS words, overlapping by a window less one, and pieces are dealt to blocks of about BLOCK_BYTES bytes.
What is sent to the tasks is one block's index; every block is looked up in one pass over the documents, in the task that has read them. With several
blocks, the passages of each document that holds any are merged by document; no texts are shuffled.

Edge cases: a null text, an empty one or one without words has no words and no hits; so has every document if there are no items. An item without
words has no window. Equal windows of several items count for each of them; repeated rows of one item count once. An item whose id is null still marks words as hit but is
not among the items. Repeated documents get a row each. Very long texts are read whole, a piece at a time. Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import PIECE, mixed

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20  # of item text in one index
PIECE_WORDS = 2000
CANDIDATES = 1 << 16  # compared together
SEEN_BITS = 22  # of a table that tells most shingles of documents from those looked for

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_FACTORS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.full(max(n, PIECE + 4096), x, np.uint64)) for x in (_STEP, inverse)]
    return _powers[0], _powers[1]


def spelled(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of a lower-cased text, worked out a piece at a time."""
    parts = []
    at = 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        gap = _GAP.search(data, stop)
        stop = gap.start() if gap else len(data)
        buf = np.frombuffer(data, np.uint8, stop - at, at)
        power, inverse = _tables(len(buf))
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = _INSIDE[buf]
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * power[: len(buf)], out=sums[1:])
        hashes = mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        parts.append((hashes, begin + at, end + at))
        at = max(stop, at + 1)
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each word on."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = mixed((out ^ hashes[j : j + n]) * _FACTORS[j])
    return out


def _together(texts: list[bytes | None]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Lower-cased texts joined by line ends into stretches of about PIECE bytes, a long text alone, with their numbers and starts."""
    held: list[bytes] = []
    who: list[int] = []
    starts: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if held and size + len(text) > PIECE:
            yield b"\n".join(held), who, starts
            held, who, starts, size = [], [], [], 0
        held.append(text.translate(_LOWER))
        who.append(i)
        starts.append(size)
        size += len(text) + 1
    if held:
        yield b"\n".join(held), who, starts


class Index(NamedTuple):
    """The windows of one block of items. Windows are distinct; `window` is a window's first word in `text`."""

    text: bytes
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    window: np.ndarray
    length: np.ndarray
    owners: list[list[str]]
    keys: dict[int, np.ndarray]  # by shingle size: the shingles looked for, ascending
    first: dict[int, np.ndarray]  # entries of key k are first[k] to first[k + 1]
    entry: dict[int, np.ndarray]  # windows
    offset: dict[int, np.ndarray]  # of the key in its window


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): each item's words, joined by spaces, in overlapping pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[str | None] = []
            words: list[bytes] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                data = (text or b"").translate(_LOWER)
                _, begin, end = spelled(data)
                for at in range(0, max(1, len(begin) - window + 1), PIECE_WORDS):
                    part = slice(at, at + PIECE_WORDS + window - 1)
                    if len(begin):
                        ids.append(item)
                        words.append(b" ".join(data[b:e] for b, e in zip(begin[part].tolist(), end[part].tolist())))
            yield pa.RecordBatch.from_pydict({"item": pa.array(ids, pa.string()), "words": pa.array(words, pa.binary())})

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item string, words binary").distinct()


def _windows(pieces: list[tuple[str | None, bytes]], window: int) -> Index:
    """The distinct windows of a block's pieces, before their keys are chosen."""
    text = b"\n".join(p for _, p in pieces)
    hashes, begin, end = spelled(text)
    known: dict[bytes, int] = {}
    word = np.array([known.setdefault(text[b:e], len(known)) for b, e in zip(begin.tolist(), end.tolist())], np.int64)
    edges = np.searchsorted(begin, np.cumsum([0, *(len(p) + 1 for _, p in pieces)]))
    starts, lengths, owner = [], [], []
    for i, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        n = max(1, hi - lo - window + 1)
        starts.append(np.arange(lo, lo + n))
        lengths.append(np.full(n, min(window, hi - lo)))
        owner.append(np.full(n, i))
    start, length, owner = (np.concatenate(x) for x in (starts, lengths, owner))
    place = np.arange(window)
    inside = place[None] < length[:, None]
    spelling = np.where(inside, word[np.minimum(start[:, None] + place[None], len(word) - 1)], -1)
    _, at, number = np.unique(spelling, axis=0, return_index=True, return_inverse=True)
    owners: list[set[str]] = [set() for _ in at]
    for w, i in zip(number.reshape(-1).tolist(), owner.tolist()):
        if pieces[i][0] is not None:
            owners[w].add(pieces[i][0])
    return Index(text, begin, end, hashes, start[at], length[at], [sorted(x) for x in owners], {}, {}, {}, {})


def _key_sizes(index: Index, shingle: int) -> list[int]:
    return sorted(set(np.minimum(index.length, shingle).tolist()))


def _shingles_of(index: Index, size: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, shingle) of the windows whose shingles have this size."""
    own = np.flatnonzero(np.minimum(index.length, shingle) == size)
    every = shingles(index.hashes, size)
    counts = index.length[own] - size + 1
    window = np.repeat(own, counts)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
    return window, offset, every[index.window[window] + offset]


def _looked_for(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[(keys & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)] = True
    return seen


def _among(found: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `found` of the values that are among `keys`, and which key each is."""
    at = np.flatnonzero(seen[(found & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)])
    key = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
    good = keys[key] == found[at]
    return at[good], key[good]


def _occurrences(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle of `keys` occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value
        seen = {size: _looked_for(k) for size, k in keys.items()}
        counts = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
        for batch in batches:
            for data, _, starts in _together(batch.column("text").to_pylist()):
                hashes, begin, _ = spelled(data)
                owner = np.searchsorted(starts, begin, side="right")
                for size, k in keys.items():
                    at, key = _among(shingles(hashes, size), k, seen[size])
                    counts[size] += np.bincount(key[owner[at] == owner[at + size - 1]], minlength=len(k))
        for size, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"size": np.full(len(at), size, np.int32), "key": at, "n": c[at]})

    total = docs.mapInArrow(count, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each shingle of the block
    out = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
    size, key, n = (total.column(c).to_numpy() for c in ("size", "key", "n"))
    for s in out:
        out[s][key[size == s]] = n[size == s]
    sent.destroy()
    return out


def _with_keys(index: Index, docs: DataFrame, shingle: int) -> Index:
    """The index with the rarest shingle of each window, ties by hash, as its key."""
    own = {size: _shingles_of(index, size, shingle) for size in _key_sizes(index, shingle)}
    values = {size: np.unique(s) for size, (_, _, s) in own.items()}
    counts = _occurrences(docs, values)
    for size, (window, offset, s) in own.items():
        number = np.searchsorted(values[size], s)
        order = np.lexsort((offset, s, counts[size][number], window))
        rarest = order[np.concatenate(([True], np.diff(window[order]) != 0))]
        rarest = rarest[np.argsort(s[rarest], kind="stable")]
        keys, first = np.unique(s[rarest], return_index=True)
        index.keys[size], index.first[size] = keys, np.append(first, len(rarest))
        index.entry[size], index.offset[size] = window[rarest], offset[rarest]
    return index


def _standing(index: Index, seen: dict[int, np.ndarray], data: bytes, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence; low and high are the word bounds of each word's document."""
    places: list[np.ndarray] = []
    windows: list[np.ndarray] = []
    for size, keys in index.keys.items():
        at, key = _among(shingles(hashes, size), keys, seen[size])
        first = index.first[size]
        each = first[key + 1] - first[key]
        steps = np.searchsorted(np.cumsum(each), np.arange(CANDIDATES, each.sum() + CANDIDATES, CANDIDATES), side="left") + 1
        for some in np.split(np.arange(len(key)), steps[steps < len(key)]):
            n = each[some]
            entry = np.repeat(first[key[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(at[some], n)
            window = index.entry[size][entry]
            start = place - index.offset[size][entry]
            fits = (start >= low[place]) & (start + index.length[window] <= high[place])
            start, window = start[fits], window[fits]
            alike = np.ones(len(start), bool)
            for j in range(int(index.length[window].max(initial=0))):
                check = np.flatnonzero(alike & (index.length[window] > j))
                alike[check] = hashes[start[check] + j] == index.hashes[index.window[window[check]] + j]
            places.append(start[alike])
            windows.append(window[alike])
    start = np.concatenate(places) if places else np.empty(0, np.int64)
    window = np.concatenate(windows) if windows else np.empty(0, np.int64)
    n = index.length[window]
    which = np.repeat(np.arange(len(start)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = (start[which] + step) * np.int64(len(index.hashes)) + index.window[window[which]] + step
    distinct, back = np.unique(pair, return_inverse=True)
    word, own = np.divmod(distinct, np.int64(max(1, len(index.hashes))))
    spans = zip(begin[word].tolist(), end[word].tolist(), index.begin[own].tolist(), index.end[own].tolist())
    equal = np.fromiter((data[b:e] == index.text[x:y] for b, e, x, y in spans), bool, len(word))
    right = np.ones(len(start), bool)
    right[which[~equal[back]]] = False
    return start[right], window[right]


def _passages(docs: DataFrame, index: Index) -> DataFrame:
    """_id, _mark, n_words, spans and items of each document for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        seen = {size: _looked_for(k) for size, k in index.keys.items()}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words = np.zeros(len(texts), np.int64)
            spans: list[list[dict]] = [[] for _ in texts]
            items: list[list[str]] = [[] for _ in texts]
            for data, who, starts in _together(texts):
                hashes, begin, end = spelled(data)
                edges = np.append(np.searchsorted(begin, starts), len(begin))
                n_words[who] = np.diff(edges)
                owner = np.repeat(np.arange(len(who)), np.diff(edges))
                start, window = _standing(index, seen, data, hashes, begin, end, edges[owner], edges[owner + 1])
                if not len(start):
                    continue
                cover = np.zeros(len(begin) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + index.length[window], -1)
                hit = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
                # A passage ends where its document ends, even if the next one goes on.
                change = np.flatnonzero(hit[1:-1] & (~hit[:-2] | (np.append(-1, owner[:-1]) != owner)))
                close = np.flatnonzero(hit[1:-1] & (~hit[2:] | (np.append(owner[1:], -1) != owner))) + 1
                for a, b in zip(change.tolist(), close.tolist()):
                    o = owner[a]
                    spans[who[o]].append({"first": a - int(edges[o]), "end": b - int(edges[o])})
                for pair in np.unique(owner[start] * np.int64(len(index.window)) + window).tolist():
                    o, w = divmod(pair, len(index.window))
                    items[who[o]].extend(index.owners[w])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                names=["_id", "_mark", "n_words", "spans", "items"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(look, f"_id {kind}, _mark long, n_words long, spans array<struct<first:long,end:long>>, items array<string>")


def merged(spans: Column) -> Column:
    """Disjoint spans in order that cover the same words."""
    sorted_spans = F.array_sort(spans)

    def join(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < x["first"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(sorted_spans, F.array().cast("array<struct<first:bigint,end:bigint>>"), join)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, spans (first word and end of each passage of hit words) and items (sorted) of every document."""
    pieces = _pieces(items, item_col, item_text, window)
    size = pieces.agg(F.sum(F.length("words") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = []
    for block in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).toArrow()  # of about block_bytes, a piece more at most
        index = Index(b"", *[np.empty(0, np.int64)] * 2, np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2, [], {}, {}, {}, {})
        if own.num_rows:
            index = _with_keys(_windows(list(zip(own.column("item").to_pylist(), own.column("words").to_pylist())), window), rows, shingle)
        parts.append(_passages(rows, index))
    out = parts[0]
    if len(parts) > 1:
        held = parts[0].where("size(spans) > 0")
        for p in parts[1:]:
            held = held.unionByName(p.where("size(spans) > 0"))
        # Equal rows of a document have equal passages, so collected sets hold each block's once.
        whole = held.groupBy("_id", "_mark").agg(F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("items")).alias("_items"))
        narrow = parts[0].select(F.col("_id").alias("_a"), F.col("_mark").alias("_b"), "n_words")
        met = narrow.join(whole, F.col("_a").eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_mark")), "left")
        none = F.array().cast("array<string>")
        out = met.select(F.col("_a").alias("_id"), "n_words", merged(F.coalesce("_spans", F.array().cast("array<struct<first:bigint,end:bigint>>"))).alias("spans"), F.array_sort(F.array_distinct(F.coalesce("_items", none))).alias("items"))
    return out.select(F.col("_id").alias(id_col), "n_words", "spans", "items")


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


DECONTAMINATION_SQL = r"""
WITH lower_items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t
         FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM lower_items WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
found AS (SELECT p.r, p.i, p.n, wins.item_id FROM places p JOIN wins ON wins.n = p.n AND wins.t = p.t),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
