"""Substring removal with suffix automata of reference shards.

A shard's automaton has every segment that was routed to it; each state knows how often its strings occur in the
corpus, since a segment counts as often as it was found. Streaming a segment through it keeps the longest match that
ends at each word, cut to the window length, and a state that occurs twice there marks a repeated window.

Sending the automata of the whole corpus to every document would be quadratic. Routing by anchor sends a segment only
to the automaton that holds all its possible matches, so no automaton is broadcast and every one has a bounded size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from chatledger.llm.repeats import Kind, remove, repeated_spans

#: Words of segments to a shard. An automaton takes up to about half a kilobyte for each.
PER_SHARD = 100_000


class Automaton:
    """A suffix automaton of several sequences with counted occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        """Take in one sequence that occurs ``weight`` times."""
        follow, link, size, count = self.next, self.link, self.size, self.count
        last = 0
        for c in sequence:
            p, made = last, -1
            if c not in follow[p]:
                made = len(size)
                follow.append({})
                link.append(0)
                size.append(size[p] + 1)
                count.append(0)
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = made
                    p = link[p]
            if p >= 0:
                q = follow[p][c]
                if size[q] != size[p] + 1:
                    q = self._split(p, c, q)
                if made >= 0:
                    link[made] = q
                else:
                    made = q
            last = made
            count[last] += weight

    def _split(self, p: int, c: int, q: int) -> int:
        follow, link = self.next, self.link
        clone = len(self.size)
        follow.append(follow[q].copy())
        link.append(link[q])
        self.size.append(self.size[p] + 1)
        self.count.append(0)
        link[q] = clone
        while p >= 0 and follow[p].get(c) == q:
            follow[p][c] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        """Add up the occurrences of every state."""
        for state in np.argsort(-np.array(self.size), kind="stable")[:-1].tolist():
            self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], length: int) -> list[tuple[int, int]]:
        """Ranges of starts of windows of ``length`` that occur twice or more; matching statistics on the way."""
        follow, link, size, count = self.next, self.link, self.size, self.count
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(sequence):
            while state and c not in follow[state]:
                state = link[state]
                matched = size[state]
            if c in follow[state]:
                state = follow[state][c]
                matched += 1
            while size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            if matched >= length and count[state] > 1:
                start = i - length + 1
                if out and out[-1][1] == start:
                    out[-1] = (out[-1][0], start + 1)
                else:
                    out.append((start, start + 1))
        return out


def search(bodies: list[bytes], weights: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """The repeated windows of a shard's segments, by one automaton of them all."""
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in body.split()] for body in bodies]
    automaton = Automaton()
    for sequence, weight in zip(coded, weights.tolist(), strict=True):
        automaton.add(sequence, weight)
    automaton.finish()
    return [automaton.repeated(sequence, length) for sequence in coded]


def remove_repeats(documents: DataFrame, *, length: int = 35, gram: int = 10, per_shard: int = PER_SHARD,
                   **settings: int) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 and kept (bytes) for every row: each word is removed that a
    window of ``length`` words covers whose sequence also starts elsewhere, in any document or the same one.

    Null and empty texts have no words. Repeated rows, with or without doc_id, are documents of their own, so both
    copies lose what they share. An empty table gives an empty result; only doc_id and text are read.
    """
    kind = Kind(True, length, gram)
    spans = repeated_spans(documents, kind, search, per_shard=per_shard, **settings)
    return remove(documents, spans, kind).withColumnRenamed("n_units", "n_words")
