"""Periodic runs of words, found by internal pattern matching inside each document.

A run is a stretch of words whose smallest period q fits into it at least four times, and that neither neighbour extends.
For periods from L = 2**k up to 2L the dyadic blocks of L words, begun every L/2 words, are looked up in the window of
the next L to 2L words: how often and where first and second a block occurs there is a range successor in a wavelet tree
over the suffix array. Occurrences in so short a window form an arithmetic progression, and its members are the candidate
periods. One of the blocks of every run has no period up to L/4 itself (else neighbouring blocks, which share half their
words, would have one period in common, and so would the run), so progressions of more than four members can be left
out. Candidates are extended in both directions by the names of dyadic blocks, words compared with words, not hashes.

Texts are handled whole, many short ones or one long one at a time; nothing is shuffled. A text of n words takes about
8 n log2(n) bytes and n log2(n)**2 steps. Null and empty texts have no words and no runs; rows with equal ids are judged
each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import flat_text, slices
from chatledger.llm.hashing import find_words

#: A run has at least so many words, and its period fits into it at least so often.
LEAST, TIMES = 6, 4

#: Bytes of text handled at a time; a longer text is handled by itself.
SLICE = 1 << 20

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


class Blocks:
    """Names of all blocks of 1, 2, 4, ... words of a sequence, and its suffix array.

    The name of a block is the number of suffixes that begin with a smaller one, so equal blocks have equal names and
    the suffixes that begin with a block are the range [name, name + count) of the suffix array."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        n = len(words)
        self.order = order = np.argsort(words, kind="stable").astype(np.int32)
        name, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.names, self.counts = [name], [count]
        fresh = np.concatenate([[True], words[order[1:]] != words[order[:-1]]]) if n else np.zeros(0, bool)
        self._settle(order, np.arange(n), fresh, name, count)
        size = 1
        while 2 * size <= longest:
            # Blocks that occur once keep their names; the others are told apart by their second halves.
            name, count = self.names[-1].copy(), self.counts[-1].copy()
            open_ = np.flatnonzero(count[order] > 1)
            at = order[open_]
            second = np.where(at + size < n, self.names[-1][np.minimum(at + size, n - 1)].astype(np.int64), -1)
            first = self.names[-1][at].astype(np.int64)
            rank = np.argsort(first * (n + 1) + second, kind="stable")
            at, first, second = at[rank], first[rank], second[rank]
            order[open_] = at
            fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])[: len(at)]
            self._settle(at, open_, fresh, name, count)
            self.names.append(name)
            self.counts.append(count)
            size *= 2

    @staticmethod
    def _settle(at: np.ndarray, places: np.ndarray, fresh: np.ndarray, name: np.ndarray, count: np.ndarray) -> None:
        starts = np.flatnonzero(fresh)
        sizes = np.diff([*starts, len(at)])
        name[at] = np.repeat(places[starts], sizes)
        count[at] = np.repeat(sizes, sizes)

    def extend(self, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, ``room`` at most."""
        n, done = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i + done, j + done
            fits = done + (1 << k) <= room
            equal = self.names[k][np.minimum(a, n - 1)] == self.names[k][np.minimum(b, n - 1)]
            done += np.where(fits & equal, 1 << k, 0)
        return done

    def extend_back(self, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, ``room`` at most."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - done - (1 << k), j - done - (1 << k)
            fits = done + (1 << k) <= room
            equal = self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)]
            done += np.where(fits & equal, 1 << k, 0)
        return done


class WaveletTree:
    """A sequence of the numbers 0 .. n-1, by their bits from the highest on; many ranges are asked at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []  # per bit: how many of the first i have a zero there
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            values = np.concatenate([values[~ones], values[ones]])

    def smaller(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values in [left, right) are smaller than ``bound``."""
        found = np.where(bound >> self.bits > 0, right - left, 0)
        active = bound >> self.bits == 0
        for level, zeros in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[left], zeros[right]
            found += np.where(active & one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return found

    def ranked(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value with so many smaller ones in [left, right)."""
        out = np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[left], zeros[right]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
            out += np.where(one, 1 << (self.bits - 1 - level), 0)
        return out


def candidates(blocks: Blocks, tree: WaveletTree, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods that may belong to a run: s, q with equal blocks at s and s + q."""
    sizes = np.diff(before)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(before[-1]) - before[doc]
    for k in range(len(blocks.names)):
        length, step = 1 << k, max(1, (1 << k) // 2)
        s = np.flatnonzero((inside % step == 0) & (blocks.counts[k] > 1) & (sizes[doc] >= max(LEAST, TIMES * length)))
        if not len(s):
            continue
        left = blocks.names[k][s].astype(np.int64)
        right = left + blocks.counts[k][s]
        upto = np.minimum(s + 2 * length, before[doc[s] + 1])
        low = tree.smaller(left, right, s + length)
        count = tree.smaller(left, right, upto) - low
        some = (count > 0) & (count <= TIMES)
        s, left, right, low, count = s[some], left[some], right[some], low[some], count[some]
        if not len(s):
            continue
        first = tree.ranked(left, right, low)
        gap = np.where(count > 1, tree.ranked(left, right, np.minimum(low + 1, right - left - 1)) - first, 0)
        for i in range(TIMES):
            more = count > i
            yield s[more], first[more] + i * gap[more] - s[more]


def find_runs(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of documents that lie one after the other, by start, then period. Words are
    small numbers; ``before`` counts the words before each document, and all."""
    sizes = np.diff(before)
    none = np.zeros(0, np.int64)
    if not len(words) or sizes.max() < LEAST:
        return none, none, none
    blocks = Blocks(words, int(sizes.max()))
    found = list(candidates(blocks, WaveletTree(blocks.order), before))
    if not found:
        return none, none, none
    s, q = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(before, s, "right") - 1
    right = blocks.extend(s, s + q, before[doc + 1] - s - q)
    left = blocks.extend_back(s, s + q, s - before[doc])
    start, end = s - left, s + q + right
    good = end - start >= np.maximum(LEAST, TIMES * q)
    start, end, q = start[good], end[good], q[good]
    # A run is found again at its multiples, with the same borders; the smallest period is its own.
    rank = np.lexsort((q, end, start))
    start, end, q = start[rank], end[rank], q[rank]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, q = start[new], end[new], q[new]
    rank = np.lexsort((q, start))
    return start[rank], end[rank], q[rank]


def stretched(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of the documents that are made periodic from some word on: those whose number's
    CRC ends in 0. A null doc_id leaves a document as it is."""
    if doc_id is None or not n:
        return None
    crc = zlib.crc32(str(doc_id).encode())
    if crc % 10:
        return None
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _slice(ids: list[int | None], part: np.ndarray, offsets: np.ndarray) -> list[list]:
    starts, ends, before = find_words(part, offsets)
    sizes = ends - starts
    edges = np.zeros(len(part) + 1, np.int32)
    edges[starts] += 1
    edges[ends] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(part[inside])])
    coded = array.dictionary_encode()
    words, names = np.array(coded.indices), coded.dictionary.to_pylist()
    before = before.astype(np.int64)
    for d, doc_id in enumerate(ids):
        a, b = before[d], before[d + 1]
        at = stretched(doc_id, int(b - a))
        if at is not None:
            words[a:b] = words[a:b][at]
    start, end, period = find_runs(words, before)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    gone = np.cumsum(drop[:-1]) > 0
    of = np.searchsorted(start, before)
    out: list[list] = []
    for d, doc_id in enumerate(ids):
        a, b = before[d], before[d + 1]
        lo, hi = of[d], of[d + 1]
        s, length, q = start[lo:hi] - a, (end - start)[lo:hi], period[lo:hi]
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), length.tolist(), q.tolist(), strict=True))
        kept = b" ".join([names[w] for w in words[a:b][~gone[a:b]].tolist()])
        best = [None] * 4
        if hi > lo:
            i = int(np.lexsort((q, s, -length))[0])
            best = [int(s[i]), int(length[i]), int(q[i]), 1000 * int(length[i]) // int(q[i])]
        out.append([doc_id, int(hi - lo), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()])
    return out


def runs(documents: DataFrame) -> DataFrame:
    """One row for every row of ``documents``: number of runs, the longest one, digests of all runs and of the words that
    stay when each run keeps its first period only."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            flat, offsets = flat_text(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                part = flat[offsets[first] : offsets[last]]
                rows = _slice(ids[first:last], part, offsets[first : last + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)
