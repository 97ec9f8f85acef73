"""Byte-level BPE encoding and decoding by merge replay over a corpus of distinct pieces.

A text is split by the tokenizer's pattern; each distinct piece of a batch is held once, as a row of symbols in one long
array. An inverted index leads from a token pair (by the rank of its merged token) to the positions where it stands.
Merges are replayed in rank order over all pieces together: each merge visits just the positions under its rank and updates
just the two neighbouring pairs. (A piece in which a merge makes one of an earlier rank possible is merged on its own.) Texts are then put together from their pieces, and decoding maps ids back to bytes.

Each task works batch by batch and remembers a bounded number of pieces, so memory doesn't grow with the input.

Edge cases: null and empty texts have no ids and decode to no bytes; special-token strings are ordinary text; repeated rows
encode alike, whatever their ids, null ones included; there are no ties, as every merge has its rank and equal ranks go from the left; an empty table gives an empty result.
Texts are never cut; a single long piece is merged whole. :func:`encode` and :func:`decode` keep all columns of the input, but one of the result's name gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED_PIECES = 200_000
CHARS_AT_ONCE = 2_000_000  # characters of text whose pieces are held together
REMEMBERED_BYTES = 64  # longer pieces are merged anew in each batch


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def pairs_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens whose bytes together are a token, as sorted keys (left << 32 | right), and that token."""
    ranks = ranks_of(path)
    found = sorted((ranks[a] << 32 | ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks)
    return np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int64)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    chars = 0
    for text in texts:
        part.append(text)
        chars += len(text or "")
        if chars >= CHARS_AT_ONCE:
            yield part
            part, chars = [], 0
    if part:
        yield part


class MergeReplay:
    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pairs, self.pair_tokens = pairs_of(path)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, tuple[int, ...]]]:
        """The pieces of each text, and the ids of every piece among them."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED_PIECES:
            self.known = {}
        fresh = list(set().union(*split) - self.known.keys())
        ids = self.replay([p.encode("utf-8", "replace") for p in fresh])
        found = dict(zip(fresh, ids))
        large = {p: found.pop(p) for p in fresh if len(p) > REMEMBERED_BYTES}
        self.known |= found
        return split, self.known | large if large else self.known

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece: all merges in rank order, over all pieces at once."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = [p for p, rank in zip(pieces, whole) if rank is None]
        merged = iter(self._merged(rest) if rest else [])
        return [next(merged) if rank is None else (rank,) for rank in whole]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each two neighbours make together; -1 if none (a negative symbol is no token)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.pair_tokens[at], -1)

    def _merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(length + 1) - 1
        symbol = self.of_byte[np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)]
        symbol[ends] = -1  # no pair crosses the end of a piece
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank_at = np.full(n, -1, np.int64)
        rank_at[:-1] = self._pair_ranks(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()  # pieces in which a merge has made an earlier one possible

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heappush(heap, rank)

        found = np.flatnonzero(rank_at >= 0)
        if len(found):
            enter(found, rank_at[found])
        while heap:
            rank = heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank_at[at] == rank]
            if len(at) > 1:
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if chained.any():  # overlapping places: every second one of a chain, from its left end
                    begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            symbol[at], symbol[gone], rank_at[gone] = rank, -2, -1
            after[at], before[far] = far, at
            rank_at[at] = self._pair_ranks(symbol[at], symbol[far])
            left = before[at]
            left = left[left >= 0]
            rank_at[left] = self._pair_ranks(symbol[left], symbol[after[left]])
            touched = np.concatenate((at, left))
            ranks = rank_at[touched]
            if (early := touched[(ranks >= 0) & (ranks < rank)]).size:
                odd.update(np.searchsorted(ends, early).tolist())
            if (ranks >= 0).any():
                enter(touched[ranks >= 0], ranks[ranks >= 0])
        kept = symbol >= 0
        ids, stops = symbol[kept].tolist(), np.cumsum(kept)[ends].tolist()
        out = [tuple(ids[a:b]) for a, b in zip([0, *stops], stops)]
        for i in odd:
            out[i] = self._one_by_one(pieces[i])
        return out

    def _one_by_one(self, piece: bytes) -> tuple[int, ...]:
        """Merges of a single piece, always the leftmost of the lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(parts) and (new := self.ranks.get(parts[left] + parts[after[left]])) is not None:
                    heappush(queue, (new, left))
        return tuple(self.ranks[p] for p in parts if p)

    def decoded(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Add the array of token ids of each whole text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = MergeReplay(path, pattern)
        for batch in batches:
            out = []
            for texts in _slices(batch.tolist()):
                split, known = codec.pieces(texts)
                out += [[i for p in ps for i in known[p]] for ps in split]
            yield pd.Series(out, dtype=object)

    return docs.withColumn(into, ids(text_col))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that an array of token ids stands for; null stays null, an unknown id is an error."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = {rank: token for token, rank in ranks_of(path).items()}
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else b"".join(table[int(i)] for i in ids))

    return tokens.withColumn(into, decoded(ids_col))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return the number of ids and digests of ids and decoded bytes.

    Ids stay inside the task: written ids and decoded bytes are kept for each distinct piece.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = MergeReplay(path, pattern)
        written: dict[str, bytes] = {}
        decoded: dict[str, bytes] = {}
        for batch in batches:
            rows = []
            for texts in _slices(batch.tolist()):
                split, known = codec.pieces(texts)
                if len(written) > REMEMBERED_PIECES:
                    written, decoded = {}, {}
                for p in set().union(*split) - written.keys():
                    ids = known[p]
                    written[p] = b" ".join(b"%d" % i for i in ids)
                    decoded[p] = codec.decoded(ids)
                for ps in split:
                    line = b" ".join(map(written.__getitem__, ps))
                    rows.append((line.count(b" ") + 1 if line else 0, hashlib.sha256(line).hexdigest(), hashlib.sha256(b"".join(map(decoded.__getitem__, ps))).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, digest(text_col).alias("_d")).select(id_col, "_d.*")
