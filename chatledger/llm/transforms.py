"""Byte-exact removal of repeats with merged Burrows-Wheeler transforms.

The segments of a shard are cut into chunks whose borders depend on nearby bytes only, so equal stretches are cut
alike; a chunk is one symbol. The shard's segments are dealt to a few parts, and only a part's own suffixes are ever
sorted. The parts' transforms are then merged by refining their interleave: each round puts the entries in order of one
more symbol by a stable pass over the transforms, and where two neighbours part is their common prefix. Groups that
stay together for enough bytes are the repeated intervals; the windows around them are compared byte for byte (by a
64-bit hash of the whole window).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from chatledger.llm.hashing import byte_codes, grams, run_hash, sums
from chatledger.llm.repeats import Kind, remove, repeated_spans, sliding_min

#: Bytes of segments to a shard, and parts of a shard whose transforms are merged.
PER_SHARD, PARTS = 2_000_000, 4
#: Segments of one anchor that still go to a shard: about as many as fill it.
HOT = 8192
#: Borders are the smallest of any ``WIDTH`` neighbouring hashes of ``GRAM`` bytes.
GRAM, WIDTH = 4, 13
#: A border is fixed by so many bytes before and after it.
BEFORE, AFTER = WIDTH - 1, WIDTH - 1 + GRAM


def borders(running: np.ndarray) -> np.ndarray:
    """Where chunks start: at least once in any ``WIDTH`` neighbouring bytes with room for a hash."""
    runs = grams(running, GRAM)
    if len(runs) < WIDTH:
        return np.zeros(0, np.int64)
    low = sliding_min(runs, WIDTH)
    edge = np.zeros(WIDTH - 1, np.uint64)
    high = ~sliding_min(~np.concatenate([edge, low, edge]), WIDTH)  # the largest minimum a position lies under
    return np.flatnonzero(runs == high)


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct ones, and an order of the values."""
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    ordered = values[order]
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return rank, order


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a part, by doubling. Every end mark must be a symbol of its own."""
    rank, step = ranks(symbols)[0], 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank, order = ranks(rank * (len(symbols) + 1) + after + 1)
        if rank[order[-1]] == len(order) - 1 or step * 2 >= len(symbols):
            return order
        step *= 2


def stable_order(values: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers, by 16 bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint32 if values.max() >> 32 else np.uint16), kind="stable")]
    return order


def merge(orders: list[np.ndarray], symbols: np.ndarray, ends: int, reach: np.ndarray, least: int) -> np.ndarray:
    """Merge the parts' transforms and return which suffixes share their first ``least`` bytes with another.

    A part is its suffix array (places in the shard); its transform is the symbol before each of them. The interleave
    starts as one part after the other. Each round moves every entry to the suffix that is one symbol longer, in the
    order of that symbol and else of the interleave, so after round h the entries are in order of h symbols, and where
    neighbours part, h - 1 is their common prefix. An entry that is alone stays alone however it is extended, so only
    unsettled entries are carried on. Symbols under ``ends`` are end marks, equal to nothing. ``reach`` has the byte at
    which each place starts.
    """
    place = np.concatenate(orders)
    group = np.zeros(len(place), np.int64)
    flagged = np.zeros(len(reach), bool)
    for depth in range(1, least + 1):
        place = place - 1
        symbol = symbols[place]
        order = np.flatnonzero(symbol >= ends)
        order = order[stable_order(symbol[order])]
        symbol, was, place = symbol[order], group[order], place[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        group, place = np.cumsum(fresh)[~alone], place[~alone]
        if not len(place):
            break
        enough = reach[np.minimum(place + depth, len(reach) - 1)] - reach[place] >= least
        flagged[place[enough]] = True
        if enough.all():
            break
    return flagged


def search(bodies: list[bytes], weights: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """The repeated windows of a shard's segments."""
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    tops = np.concatenate([[0], np.cumsum(sizes)])
    running = sums(byte_codes(flat))
    starts = np.zeros(len(flat), bool)
    starts[borders(running)] = starts[tops[:-1]] = True
    cuts = np.flatnonzero(starts)
    owner = np.searchsorted(tops, cuts, "right") - 1
    chunk_ends = np.minimum(np.concatenate([cuts[1:], tops[-1:]]), tops[owner + 1])
    rank, _ = ranks(run_hash(running, cuts, chunk_ends))
    # A place for every chunk and, after the last of each segment, one for its end mark.
    count = np.bincount(owner, minlength=len(bodies))
    place = np.arange(len(cuts)) + owner
    symbols = np.empty(len(cuts) + len(bodies), np.int64)
    mark = np.cumsum(count) + np.arange(len(bodies))
    symbols[place] = rank + len(bodies)
    symbols[mark] = np.arange(len(bodies))
    reach = np.empty(len(symbols), np.int64)
    reach[place], reach[mark] = cuts, tops[1:]
    least = max(1, length - BEFORE - AFTER - 2 * WIDTH)
    # Parts are runs of whole segments.
    bounds = np.unique(np.concatenate([[0], mark[np.linspace(0, len(bodies) - 1, PARTS + 1).astype(int)[1:]] + 1]))
    orders = [suffix_order(symbols[lo:hi]) + lo for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    flagged = merge(orders, symbols, len(bodies), reach, least)
    heavy = weights > 1
    # Windows that could hold a flagged interval, and all windows of segments that occur twice.
    windows = np.zeros(len(flat) + 1, np.int64)
    start = reach[np.flatnonzero(flagged)]
    np.add.at(windows, np.maximum(start - BEFORE - WIDTH, 0), 1)
    np.add.at(windows, np.maximum(start - BEFORE + 1, 0), -1)
    tried = np.cumsum(windows)[:-1] > 0
    whole = np.repeat(heavy, sizes)
    inside = np.arange(len(flat)) + length <= np.repeat(tops[1:], sizes)
    s = np.flatnonzero((tried | whole) & inside)
    hashes = run_hash(running, s, s + length)
    which, _ = ranks(hashes) if len(s) else (s, s)
    of = np.searchsorted(tops, s, "right") - 1
    hit = s[np.bincount(which, weights[of])[which] > 1]
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    if len(hit):
        of = np.searchsorted(tops, hit, "right") - 1
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(of) != 0)]))
        for i, j in zip(fresh, np.append(fresh[1:], len(hit)), strict=True):
            base = tops[of[i]]
            out[of[i]].append((int(hit[i] - base), int(hit[j - 1] + 1 - base)))
    return out


def remove_repeats(documents: DataFrame, *, length: int = 200, gram: int = 50, per_shard: int = PER_SHARD,
                   hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept for every row: each byte is removed that a string of
    ``length`` bytes covers which also starts elsewhere, in any document or the same one.

    Null and empty texts have no bytes. Repeated rows, with or without doc_id, are documents of their own, so both
    copies lose what they share. What is left need not be valid UTF-8. An empty table gives an empty result; only
    doc_id and text are read.
    """
    kind = Kind(False, length, gram)
    spans = repeated_spans(documents, kind, search, per_shard=per_shard, hot=hot)
    return remove(documents, spans, kind).withColumnRenamed("n_units", "n_bytes")
