"""Packing documents into training sequences by lexical retrieval.

Documents are dealt to shards of bounded size by lexical closeness over the whole corpus: each looks up the leaders, a
sample of the corpus, that it is closest to by BM25 weights. Leaders that are close to each other have numbers close to
each other, and a shard is a range of the order by the closest leader, then the second and the third; a crowd around
the same leaders is split by hash. A shard has a BM25 inverted index of its documents; how common a word is comes from
all documents of the corpus. A window is opened by a seed document and filled with the seed's best unused neighbours,
best first; what does not fit opens the next window, so only the last sequence of a shard is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import flat_text, slices
from chatledger.llm.hashing import find_words, lower, word_codes
from chatledger.llm.tokens import encoder

WINDOW, END = 2048, 1
#: Words are hashed into so many terms, which bounds the table of document frequencies.
TERMS = 1 << 17
#: Bytes of text to a shard.
PER_SHARD = 8_000_000
#: BM25's settings, and the query's terms: the seed's best by weight.
K1, B, QUERY = 1.2, 0.75, 12
#: Leaders to a shard, and in all (13 bits of the order, and one number for documents close to none).
LEADERS, MOST_LEADERS = 8, 8191
#: Terms by which a document is dealt and of a leader that it may meet: the best by weight that other documents have.
DEALT_BY, LED_BY = 64, 256
#: Documents to a shard whose place in the order decides where shards are cut.
MARKS = 32


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text, its distinct terms and how often each occurs."""
    flat, offsets = flat_text(column)
    for first, last in slices(offsets, 1 << 20):
        part = lower(flat[offsets[first] : offsets[last]])
        starts, ends, before = find_words(part, offsets[first : last + 1] - offsets[first])
        codes = (word_codes(part, starts, ends) >> np.uint64(47)).astype(np.int64)
        for a, b in zip(before[:-1], before[1:], strict=True):
            yield np.unique(codes[a:b], return_counts=True)


def statistics(documents: DataFrame) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length in words, and in how many of them each term occurs, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, size = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            for terms, often in _terms(batch.column("text")):
                seen[terms] += 1
                docs += 1
                size += int(often.sum())
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, [-1, -2])), pa.array(np.append(seen[some], [docs, size]))], ["term", "n"])

    rows = documents.select("text").mapInArrow(count, "term long, n long")
    # TERMS + 2 rows at most.
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = np.asarray(got.column("term")), np.asarray(got.column("n"))
    frequency = np.zeros(TERMS, np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    docs, size = int(n[term == -1].sum()), int(n[term == -2].sum())
    return docs, size / max(docs, 1), frequency


def _idf(docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.log1p((docs - frequency + 0.5) / (frequency + 0.5))


def _best(column: pa.Array, most: int, mean: float, frequency: np.ndarray, idf: np.ndarray) -> Iterator[tuple]:
    """Per text, its ``most`` best terms that other documents have too, and their weights."""
    for terms, often in _terms(column):
        length, shared = often.sum(), frequency[terms] > 1
        terms, tf = terms[shared], often[shared].astype(float)
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))
        best = np.argsort(-weight, kind="stable")[:most]
        yield terms[best], weight[best]


class Leaders:
    """An inverted index of the leaders, numbered so that each is followed by the closest one not yet numbered."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self._index(terms, weights)
        left, order, at = np.ones(len(terms), bool), [], 0
        while len(order) < len(terms):
            left[at] = False
            order.append(at)
            score = np.where(left, self.scores(terms[at], weights[at]), -1)
            at = int(score.argmax())
        self._index([terms[i] for i in order], [weights[i] for i in order])

    def _index(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.count = len(terms)
        owner = np.repeat(np.arange(self.count), [len(t) for t in terms])
        every = np.concatenate([*terms, np.zeros(0, np.int64)])
        # Long leaders must not draw every document.
        norms = [np.full(len(w), max(float(np.sqrt((w * w).sum())), 1e-9)) for w in weights]
        impact = np.concatenate([*weights, np.zeros(0)]) / np.concatenate([*norms, np.zeros(0)])
        order = np.argsort(every, kind="stable")
        self.posted, self.impact = owner[order].astype(np.int32), impact[order]
        self.heads = np.searchsorted(every[order], np.arange(TERMS + 1))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The closeness of every leader to a document."""
        first, size = self.heads[terms], self.heads[terms + 1] - self.heads[terms]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(self.count)
        at = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        return np.bincount(self.posted[at], self.impact[at] * np.repeat(weights, size), self.count)

    def place(self, terms: np.ndarray, weights: np.ndarray) -> int:
        """The document's place in the order: its three closest leaders, in 13 bits each (ties by number)."""
        score, out = self.scores(terms, weights), 0
        for _ in range(3):
            best = int(score.argmax()) if self.count else 0
            found = self.count and score[best] > 0
            out = out << 13 | (best if found else MOST_LEADERS)
            if found:
                score[best] = 0
        return out


def lead(documents: DataFrame, count: int, docs: int, mean: float, frequency: np.ndarray) -> Leaders:
    """About ``count`` distinct texts, chosen by hash, as leaders. Their best terms reach the driver, not the texts."""
    idf = _idf(docs, frequency)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_best(batch.column("text"), LED_BY, mean, frequency, idf))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), pa.array([t for t, _ in found], pa.list_(pa.int64())),
                 pa.array([w for _, w in found], pa.list_(pa.float64()))], ["h", "terms", "weights"])

    hashed = documents.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    # Copies of one text leave fewer distinct ones, so more are drawn than needed.
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) < (1 << 30) * 4 * count // max(docs, 1))
    rows = drawn.mapInArrow(best, "h long, terms array<long>, weights array<double>").where("size(terms) > 0")
    got = rows.dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(count).toArrow()
    terms, weights = ([np.asarray(x.values) for x in got.column(c)] for c in ("terms", "weights"))
    return Leaders(terms, weights)


def deal(documents: DataFrame, shards: int, docs: int, mean: float, frequency: np.ndarray) -> DataFrame:
    """doc_id and text with the ``shard`` of each document, of about equal bytes."""
    hashed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    if shards == 1:
        return hashed.select("doc_id", "text", F.lit(0).cast("long").alias("shard"))
    leaders, idf = lead(documents, min(LEADERS * shards, MOST_LEADERS), docs, mean, frequency), _idf(docs, frequency)

    def places(batch: pa.RecordBatch) -> np.ndarray:
        found = [leaders.place(*b) for b in _best(batch.column("text"), DEALT_BY, mean, frequency, idf)]
        return np.array(found, np.int64) << 24 | batch.column("h").to_numpy() >> 40 & 0xFFFFFF

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(flat_text(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays([pa.array(places(batch)), pa.array(sizes)], ["place", "bytes"])

    some = F.pmod("h", F.lit(1 << 30)) < max(1, (1 << 30) * MARKS * shards // max(docs, 1))
    marks = hashed.where(some).mapInArrow(mark, "place long, bytes long").toArrow()
    at, sizes = (np.asarray(marks.column(c)) for c in ("place", "bytes"))
    order = np.argsort(at, kind="stable")
    upto = np.cumsum(sizes[order] + 1)
    goals = np.arange(1, shards) * (upto[-1] / shards) if len(upto) else np.zeros(0)
    cuts = at[order][np.minimum(np.searchsorted(upto, goals), len(upto) - 1)] if len(upto) else np.zeros(0, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.searchsorted(cuts, places(batch), "left")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(shard, pa.int64())], ["doc_id", "text", "shard"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(cut, f"doc_id {kind}, text string, shard long")


class Index:
    """The inverted index of a shard."""

    def __init__(self, column: pa.Array, docs: int, mean: float, frequency: np.ndarray) -> None:
        terms, often = zip(*_terms(column), strict=True)
        sizes = np.array([len(t) for t in terms])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, tf = np.concatenate(terms), np.concatenate(often).astype(float)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        length = np.array([o.sum() for o in often], float)[owner]
        idf = _idf(docs, frequency)
        self.weight = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))
        order = np.argsort(self.terms, kind="stable")
        self.posted, self.impact = owner[order], self.weight[order]
        self.heads = np.searchsorted(self.terms[order], np.arange(TERMS + 1))
        self.unused = np.ones(len(sizes), bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """The unused documents that share a query term with the seed, best first (ties by place)."""
        own = slice(self.starts[seed], self.starts[seed + 1])
        best = np.argsort(-self.weight[own], kind="stable")[:QUERY]
        ranges = [slice(self.heads[t], self.heads[t + 1]) for t in self.terms[own][best]]
        if not ranges:
            return np.zeros(0, np.int64)
        posted = np.concatenate([self.posted[r] for r in ranges])
        score = np.bincount(posted, np.concatenate([self.impact[r] for r in ranges]), len(self.unused))
        found = np.flatnonzero((score > 0) & self.unused)
        return found[np.argsort(-score[found], kind="stable")]


def arrange(sizes: np.ndarray, index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard, in order."""
    sequence = used = 0
    waiting = iter(range(len(sizes)))
    ranked: Iterator[int] = iter(())
    while True:
        doc = next((int(d) for d in ranked if index.unused[d]), None)
        if doc is None:
            doc = next((d for d in waiting if index.unused[d]), None)
            if doc is None:
                return
            index.unused[doc] = False
            ranked = iter(index.neighbours(doc))
        index.unused[doc] = False
        start = 0
        while start < sizes[doc]:
            length = int(min(sizes[doc] - start, window - used))
            yield doc, start, length, sequence, used
            start, used = start + length, used + length
            if used == window:
                sequence, used = sequence + 1, 0
                # What is left of this document opens the next window and is its seed.
                ranked = iter(index.neighbours(doc)) if start < sizes[doc] and sizes[doc] - start < window else ranked
                if start == sizes[doc]:
                    ranked = iter(())


def pack(documents: DataFrame, *, window: int = WINDOW, per_shard: int = PER_SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unsigned 16-bit,
    little-endian) if asked for. Sequences are gapless; the caller pads the last of a shard.

    A document's ids are those of its text, then ``END``; null and empty texts are that one id. Repeated rows are packed
    each for itself. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    docs, mean, frequency = statistics(documents)
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // per_shard))
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def fill(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        text = shard.column("text").combine_chunks()
        ids = [np.append(x, np.uint16(END)) for x in encoder().every(text)]
        sizes = np.array([len(x) for x in ids])
        index = Index(text, docs, mean, frequency)
        pieces = list(arrange(sizes, index, window))
        doc = np.array([p[0] for p in pieces])
        parts = [ids[d][s : s + n] for d, s, n, _, _ in pieces]
        base = shard.column("shard")[0].as_py() << 32
        columns = [
            shard.column("doc_id").take(pa.array(doc)), *[pa.array([p[i] for p in pieces], pa.int64()) for i in (1, 2)],
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()), pa.array(sizes[doc]),
            pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())]
        return pa.table(columns + [pa.array([x.tobytes() for x in parts], pa.binary())] * with_ids, fields)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{f} long" for f in fields[1:7]) + ", ids binary" * with_ids
    return deal(documents, shards, docs, mean, frequency).groupBy("shard").applyInArrow(fill, schema)
