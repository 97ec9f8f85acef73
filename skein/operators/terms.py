"""Many terms at once: an automaton over all of them reads a text once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skein.sources.snapshots import bounded_batches

LONGEST_CHECKED = 64  # characters of a term whose beginnings and ends are listed
MOST_CHARACTERS = 4 << 20  # of all terms and targets together, which are sent to the tasks


class Terms:
    """Rules (term, target) in the order of their use, applied as if one after the other to the whole text.

    The automaton tells which terms a text holds; only their rules are used, in order. A target can bring about the term of a later rule only where it was put, so just its
    surroundings are read again, and not even those if no later term overlaps with the target in any way.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        of: dict[str, list[int]] = {}
        for i, (term, _) in enumerate(rules):
            of.setdefault(term, []).append(i)
        self.longest = max(map(len, of), default=1)
        self.automaton = _automaton((term, tuple(numbers)) for term, numbers in of.items())
        self.last_brought = self._last_brought()

    def _last_brought(self) -> list[int]:
        """For each rule, the last rule whose term its target can be part of, hold or overlap with."""
        begins: dict[str, int] = {}
        ends: dict[str, int] = {}
        last_long = -1
        for i, (term, _) in enumerate(self.rules):
            if len(term) > LONGEST_CHECKED:
                last_long = i
            else:
                begins.update((term[:n], i) for n in range(1, len(term)))
                ends.update((term[-n:], i) for n in range(1, len(term)))
        out = []
        of: dict[str, list[int]] = {}
        for i, (_, target) in enumerate(self.rules):
            if target:
                of.setdefault(target, []).append(i)
            lengths = range(1, min(len(target), LONGEST_CHECKED) + 1)
            overlaps = [begins.get(target[-n:], -1) for n in lengths] + [ends.get(target[:n], -1) for n in lengths]
            out.append(max([last_long, *overlaps, *self.present(target)], default=-1) if target else len(self.rules))
        if of:
            targets = _automaton((target, tuple(numbers)) for target, numbers in of.items())
            for j, (term, _) in enumerate(self.rules):
                for _, numbers in targets.iter(term):
                    for i in numbers:
                        out[i] = max(out[i], j)
        return out

    def present(self, text: str, *within: int) -> set[int]:
        """The rules whose terms stand in the text, or in a part of it."""
        if not self.rules:
            return set()
        return {i for numbers in {found for _, found in self.automaton.iter(text, *within)} for i in numbers}

    def _used(self, i: int, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The text after rule i, and where its target was put. Where the target already stands it is passed over whole."""
        term, target = self.rules[i]
        if target and (target.startswith(term) or term.startswith(target)):
            parts, at = [], 0
            for m in re.finditer(f"(?={re.escape(term)}){re.escape(target)}|{re.escape(term)}", text):
                parts.append(text[at : m.start()])
                at = m.end()
            parts.append(text[at:])
        else:
            parts = text.split(term)
        spans, at = [], 0
        if self.last_brought[i] > i:
            for part in parts[:-1]:
                at += len(part)
                spans.append((at, at + len(target)))
                at += len(target)
        return target.join(parts), spans

    def replaced(self, text: str) -> str:
        waiting = list(self.present(text))
        heapify(waiting)
        last = -1
        while waiting:
            i = heappop(waiting)
            if i == last:
                continue
            last = i
            text, spans = self._used(i, text)
            around: list[list[int]] = []
            for lo, hi in spans:
                begin, end = max(0, lo - self.longest + 1), min(len(text), hi + self.longest - 1)
                if around and begin <= around[-1][1]:
                    around[-1][1] = end
                else:
                    around.append([begin, end])
            for j in {j for part in around for j in self.present(text, *part) if j > i}:
                heappush(waiting, j)
        return text


def _automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, value in words:
        out.add_word(word, value)
    out.make_automaton()
    return out


def _checked(words: Iterable[str]) -> None:
    size = sum(map(len, words))
    if size > MOST_CHARACTERS:
        raise ValueError(f"terms of {size} characters, more than {MOST_CHARACTERS}")


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after all rules; null stays null."""
    bounded_batches(SparkSession.active())
    _checked(x for rule in rules for x in rule)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(rules)
        for batch in batches:
            yield pd.Series([None if x is None else terms.replaced(x) for x in batch], dtype=object)

    return run(text)


def held(text: Column, words: list[str]) -> Column:
    """Those of the words that stand in the text, in their order; none for a null text. An empty word stands in every text."""
    bounded_batches(SparkSession.active())
    _checked(words)
    listed = list(dict.fromkeys(words))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms([(w, w) for w in listed if w])
        empty = [""] if "" in listed else []
        for batch in batches:
            yield pd.Series([[] if x is None else empty + [terms.rules[i][0] for i in sorted(terms.present(x))] for x in batch], dtype=object)

    return run(text)
