"""Substring dedup on words through suffix automata of reference shards.

A reference shard holds the stretches of text around one or more shared anchor grams (`passages`), at most
``SHARD_ROWS`` stretches of a gram, so its automaton has a bound. Each stretch is streamed through the automaton of
its own shard for its matching statistics: the longest word sequence ending at each word that occurs twice or more
in the shard. Ends where it reaches the window length give the repeated windows.

Null, empty or blank text: no words. Fewer words than a window: all kept. Repeated rows of at least a window repeat
each other. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .common import texts
from .passages import Kind, covered, unpack, with_spans

WINDOW = 35
FIRST = 8
SHARD_ROWS = 1000


class SuffixAutomaton:
    """Suffix automaton of several sequences, with the number of occurrences of each state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                self.count[last] += 1
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A state for the strings of `target` that are no longer than `state` allows."""
        clone = self._add(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._add(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
        return new

    def repeated_ends(self, sequence: list[int], at_least: int) -> list[int]:
        """Ends (exclusive) at which a string of that length occurs twice or more in the shard."""
        moves, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        ends = []
        for k, symbol in enumerate(sequence, 1):
            while True:
                target = moves[state].get(symbol)
                if target is not None and count[target] > 1:
                    state = target
                    matched += 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            if matched >= at_least:
                ends.append(k)
        return ends


def matched(stretches: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated window start within each stretch, or -1."""
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in s.split()] for s in stretches]
    automaton = SuffixAutomaton(sequences)
    low = np.full(len(sequences), -1, np.int64)
    high = low.copy()
    for k, sequence in enumerate(sequences):
        ends = automaton.repeated_ends(sequence, size)
        if ends:
            low[k], high[k] = ends[0] - size, ends[-1] - size
    return low, high


_hashes: dict[bytes, int] = {}


def _codes(text: str):
    words = text.encode("utf-8", "surrogateescape").split()
    if len(_hashes) > 100_000:
        _hashes.clear()
    codes = []
    for w in words:
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(h)
    return np.array(codes, np.uint64), lambda a, b: b" ".join(words[a:b])


def kind(window: int = WINDOW, first: int = FIRST, shard_rows: int = SHARD_ROWS) -> Kind:
    return Kind(_codes, window, first, matched, shard_rows)


def removals(docs: DataFrame, how: Kind | None = None, **columns: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for z, packed in zip(batch.z, batch.spans):
                words = unpack(z).encode().split()
                b, e = covered([] if packed is None else packed, len(words))
                kept, at = [], 0
                for i, j in zip(b.tolist(), e.tolist()):
                    kept += words[at:i]
                    at = j
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", batch.doc_id.astype("Int64"))
            yield out

    joined = with_spans(texts(docs, **columns), how or kind())
    return joined.select("doc_id", "z", "spans").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
